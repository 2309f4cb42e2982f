"""Rate limits with a window that is anchored at its first request."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import partitions_of


def limited(df: DataFrame, key: str, ts: str, row_id: str, most: int = 8, window_us: int = 60_000_000) -> DataFrame:
    """``row_id, key, ts, allowed``.

    A window begins with a request and ends when more than ``window_us`` has passed; within it the
    first ``most`` requests are allowed, and denied ones change nothing. Ties in time go by row id.
    The rule is sequential within a key: rows are sorted by key and time within partitions and
    scanned in batches, with one anchor and one count as the only state, whatever the size of a key.
    Null keys are a key of their own; rows without a time are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def scan(batches):
        key_now, anchor, count, started = None, 0, 0, False
        for batch in batches:
            keys, times = batch.column(1).to_pylist(), batch.column(2).cast(pa.int64()).to_numpy()
            allowed = np.zeros(batch.num_rows, bool)
            for i, k in enumerate(keys):
                now = int(times[i])
                if not started or k != key_now or now - anchor > window_us:
                    key_now, anchor, count, started = k, now, 1, True
                    allowed[i] = True
                elif count < most:
                    count += 1
                    allowed[i] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed)], names=[row_id, key, ts, "allowed"])

    rows = df.select(row_id, key, ts).where(F.col(ts).isNotNull())
    ordered = rows.repartition(partitions_of(df.sparkSession), F.col(key)).sortWithinPartitions(key, ts, row_id)
    return ordered.mapInArrow(scan, f"`{row_id}` {kinds[row_id]}, `{key}` {kinds[key]}, `{ts}` timestamp, allowed boolean")
