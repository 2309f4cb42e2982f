"""The anchored rate limit on a stream, with one small state for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class AnchoredWindow(StatefulProcessor):
    """Keeps the start of the window and the number of requests allowed in it."""

    def __init__(self, most: int = 8, window_us: int = 60_000_000) -> None:
        self.most, self.window_us = most, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "anchor long, count int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        current = self.state.get() if self.state.exists() else None
        anchor, count = (current[0], current[1]) if current else (None, 0)
        # Rows of a key come in the order of arrival; within a batch they go by time.
        batch = pd.concat(list(rows)).sort_values(["ts", "row_id"], kind="stable")
        allowed = []
        for now in batch["ts"].astype("datetime64[us]").astype("int64"):
            if anchor is None or now - anchor > self.window_us:
                anchor, count = int(now), 1
                allowed.append(True)
            elif count < self.most:
                count += 1
                allowed.append(True)
            else:
                allowed.append(False)
        if anchor is not None:
            self.state.update((anchor, count))
        yield pd.DataFrame({"row_id": batch["row_id"].to_numpy(), "key": key[0], "ts": batch["ts"].to_numpy(), "allowed": allowed})

    def close(self) -> None:
        pass


def limited_stream(stream: DataFrame, most: int = 8, window_us: int = 60_000_000) -> DataFrame:
    """``row_id, key, ts, allowed`` of a stream with (row_id long, key long, ts timestamp).

    Needs the RocksDB state store provider; state is a dozen bytes for each key seen.
    """
    return stream.groupBy("key").transformWithStateInPandas(
        AnchoredWindow(most, window_us), "row_id long, key long, ts timestamp, allowed boolean", outputMode="Append", timeMode="None")
