"""Sources of model replies: a labelled mock, a table of earlier replies, and a callable."""

from __future__ import annotations

import json
import os
from abc import ABC, abstractmethod
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of a candidate's text that a model is shown.
SHOWN_TEXT = 4000


class ReplyProvider(ABC):
    """Turns candidates into rows of (key, raw); a key without a usable reply has none."""

    name: str
    is_mock = False

    @abstractmethod
    def replies(self, candidates: DataFrame, key: str) -> DataFrame:
        """``candidates`` has (key, business_name, username, website, text)."""


class MockReplies(ReplyProvider):
    """Repeats the name and scores nothing."""

    name, is_mock = "mock", True

    def replies(self, candidates: DataFrame, key: str) -> DataFrame:
        empty = F.array().cast("array<string>")
        reply = F.struct(
            F.col("business_name").alias("businessName"), F.lit("retail").alias("businessType"), F.lit(None).cast("string").alias("city"), empty.alias("reasons"),
            empty.alias("warnings"), F.lit(0).alias("shopBotFit"), F.lit(0).alias("credibility"), empty.alias("inventedClaims"))
        return candidates.select(key, F.to_json(reply, {"ignoreNullFields": "false"}).alias("raw"))


class TableReplies(ReplyProvider):
    """Earlier replies, by equal key."""

    name = "table"

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def replies(self, candidates: DataFrame, key: str) -> DataFrame:
        return self.table.join(candidates.select(key).distinct(), key, "left_semi").select(key, "raw")


class CallableReplies(ReplyProvider):
    """Calls ``ask(request)`` for each candidate, one after the other in each of a few partitions.

    A call that fails counts as no reply. The request is JSON with at most ``SHOWN_TEXT`` letters of
    the text, as a service would get it.
    """

    def __init__(self, ask: Callable[[str], str | None], name: str = "service", concurrency: int = 3) -> None:
        self.ask, self.name, self.concurrency = ask, name, concurrency

    def replies(self, candidates: DataFrame, key: str) -> DataFrame:
        ask = self.ask

        def run(batches):
            for batch in batches:
                keys, raws = [], []
                for row in batch.to_pylist():
                    shown = {"username": row["username"], "website": row["website"], "text": (row["text"] or "")[:SHOWN_TEXT]}
                    try:
                        reply = ask(json.dumps(shown, ensure_ascii=False))
                    except Exception:  # noqa: BLE001
                        continue
                    if reply:
                        keys.append(row[key])
                        raws.append(reply)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.array(raws, pa.string())], names=[key, "raw"])

        kind = candidates.schema[key].dataType.simpleString()
        return candidates.select(key, "username", "website", "text").repartition(self.concurrency).mapInArrow(run, f"`{key}` {kind}, raw string")


def chosen_replies(ask: Callable[[str], str | None] | None = None, environment: dict[str, str] | None = None) -> ReplyProvider:
    """The mock if it is named or nothing can be asked, else the callable; ``off`` means the mock."""
    env = os.environ if environment is None else environment
    named = env.get("AI_PROVIDER", "").strip().lower()
    return MockReplies() if ask is None or named in ("mock", "off") else CallableReplies(ask)
