"""Documents placed in containers of fixed capacity (problem 7).

Method: cost-balanced packing. The cost of a document of n tokens is linear plus quadratic (its
attention); documents in descending order go to the lowest-cost sequence that has room, unless one
closes a sequence almost exactly. Lengths are counted once and stored. Documents are dealt into shards of bounded size, each packed by one task,
so that the work is linear in the data and the space lost to sharding is under one container in a
shard of some thousands.
"""

from __future__ import annotations

import bisect
import heapq
import os
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import stored
from ..sources.tables import table
from .token_ids import TOKENIZERS, merger, slices

#: Documents in a shard: the memory and time of a packing task.
SHARD = 50_000
#: Attention cost of a token pair against the linear cost of a token.
QUADRATIC = 1 / 4096
#: Share of the capacity that may stay unused in a sequence that a document closes.
CLOSING = 1 / 256


@lru_cache(4)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(4)
def _words(path: str):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    return tool


def count_tokens(texts: list[str], folder: str, names: list[str]) -> dict[str, np.ndarray]:
    """Number of tokens of each text by each tokenizer; '' has none."""
    found, split = {}, None
    for name in names:
        base = os.path.join(folder, name)
        if os.path.exists(base + ".tiktoken"):
            split = slices(texts) if split is None else split
            tool = merger(base + ".tiktoken")
            cache, ids = tool.cache, tool.ids
            counts = [sum([len(cache.get(p) or ids(p)) for p in row]) for row in split]
        elif os.path.exists(base + ".model"):
            counts = [len(x) for x in _pieces(base + ".model").encode(texts, num_threads=1)]
        else:
            counts = [len(x.ids) for x in _words(base + ".json").encode_batch(texts, add_special_tokens=False)]
        found[name] = np.array(counts, np.int64)
    return found


def pack(lengths: np.ndarray, capacity: int, quadratic: float = QUADRATIC, closing: float = CLOSING) -> np.ndarray:
    """Container of each length (all at most ``capacity``).

    Lengths in descending order go to the sequence of lowest cost that has room; before that, to the
    tightest one if they close it, leaving at most ``closing`` of the capacity. As many sequences are
    open from the start as the total needs at least; another is opened only if nothing has room.
    """
    home = np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int(np.searchsorted(-lengths[order], -capacity, side="right"))
    home[order[:full]] = np.arange(full)
    rest = order[full:]
    opened = max(1, -(-int(lengths[rest].sum()) // capacity)) if len(rest) else 0
    room, cost, slack = [capacity] * opened, [0.0] * opened, closing * capacity
    by_room = [(capacity, k) for k in range(opened)]
    active = [(0.0, k) for k in range(opened)]  # by cost; entries whose cost has changed are passed over
    parked: list[tuple[int, int]] = []  # without room for the present length; by room, largest first
    for i in rest.tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(by_room, (n, -1))
        if at < len(by_room) and by_room[at][0] - n <= slack:
            k = by_room[at][1]
        else:
            while parked and -parked[0][0] >= n:
                k = heapq.heappop(parked)[1]
                heapq.heappush(active, (cost[k], k))
            while active and (active[0][0] != cost[active[0][1]] or room[active[0][1]] < n):
                old, k = heapq.heappop(active)
                if old == cost[k]:
                    heapq.heappush(parked, (-room[k], k))
            if active:
                k = active[0][1]
            else:
                k = len(room)
                room.append(capacity)
                cost.append(0.0)
                bisect.insort(by_room, (capacity, k))
        by_room.pop(bisect.bisect_left(by_room, (room[k], k)))
        room[k] -= n
        cost[k] += n + quadratic * n * n
        bisect.insort(by_room, (room[k], k))
        heapq.heappush(active, (cost[k], k))
        home[i] = full + k
    return home


_LENGTHS = "id long, salt long, spec int, capacity int, tokens long"


def document_lengths(df: DataFrame, id_col: str, text_col: str, specs: list[tuple[int, str, int]], folder: str = TOKENIZERS) -> DataFrame:
    """``id, salt, spec, capacity, tokens``: a row per document and spec. ``salt`` deals rows out evenly."""
    names = sorted({name for _, name, _ in specs})

    def run(batches):
        row = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts = count_tokens([t or "" for t in part.column(1).to_pylist()], folder, names)
                n = part.num_rows
                salt = np.arange(row, row + n)
                row += n
                for spec, name, capacity in specs:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(salt), pa.array(np.full(n, spec, np.int32)), pa.array(np.full(n, capacity, np.int32)), pa.array(counts[name])],
                        names=["id", "salt", "spec", "capacity", "tokens"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _LENGTHS)


_PACKED = "spec_id int, shard long, container long, id long, piece_no int, token_start long, n_tokens long"


def _pack_shard(key, rows: pd.DataFrame) -> pd.DataFrame:
    spec, shard, capacity = int(key[0]), int(key[1]), int(rows["capacity"].iloc[0])
    rows = rows.sort_values(["tokens", "id"], kind="stable")
    tokens, ids = rows["tokens"].to_numpy(), rows["id"].to_numpy()
    pieces = np.maximum(1, -(-tokens // capacity))
    owner = np.repeat(np.arange(len(rows)), pieces)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * capacity
    size = np.minimum(capacity, tokens[owner] - start)
    id_out = pd.array(ids[owner], "Int64") if rows["id"].isna().any() else ids[owner]
    return pd.DataFrame({
        "spec_id": np.int32(spec), "shard": shard, "container": pack(size, capacity), "id": id_out,
        "piece_no": piece.astype(np.int32), "token_start": start, "n_tokens": size})


def fill_containers(df: DataFrame, id_col: str, text_col: str, specs: list[tuple[int, str, int]], folder: str = TOKENIZERS, shard: int = SHARD) -> DataFrame:
    """Places every document: ``spec_id, container_id, id, piece_no, token_start, n_tokens``.

    A null or empty text has length 0 and lies in a container as a piece of 0 tokens. A text longer
    than the capacity is cut into full pieces and a rest; no other is divided. Repeated ids are
    documents of their own, a null id stays null; no spec or no document gives no row. ``specs``
    holds (spec id, tokenizer, capacity).
    """
    lengths = stored(document_lengths(df, id_col, text_col, specs, folder), "lengths")
    # One row per spec goes to the driver.
    sizes = {r["spec"]: r["n"] for r in lengths.groupBy("spec").agg(F.count("*").alias("n")).collect()}
    shards = max([1, *(-(-n // shard) for n in sizes.values())])
    placed = (
        lengths.withColumn("shard", F.pmod(F.xxhash64("id", "salt"), F.lit(shards)))
        .groupBy("spec", "shard").applyInPandas(_pack_shard, _PACKED)
    )
    return placed.select(
        "spec_id", F.concat_ws("-", "shard", "container").alias("container_id"), "id", "piece_no", "token_start", "n_tokens")


def p7_packed(spark: SparkSession, root: str) -> DataFrame:
    specs = [(r.spec_id, r.tokenizer, r.capacity) for r in table(spark, root, "pack_spec").collect()]
    folder = spark.conf.get("leadflow.tokenizers", TOKENIZERS)
    return fill_containers(table(spark, root, "documents"), "doc_id", "text", specs, folder).withColumnRenamed("id", "doc_id")


QUERIES = {"p7_packed": p7_packed}
