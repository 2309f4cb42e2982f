"""Server-sent event frames: writing rows as frames and reading frames as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_frame(event: Column | str, *fields: Column | str) -> Column:
    name = F.col(event) if isinstance(event, str) else event
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), F.to_json(F.struct(*fields)), F.lit("\n\n"))


def split_frames(df: DataFrame, text: str, payload: str) -> DataFrame:
    """A row for each complete frame in a text: ``pos, event, data``; a closing rest is left out.

    Frames without an event or data line are skipped. ``payload`` is the schema of the data.
    """
    parts = F.split(F.col(text), "\n\n")
    whole = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    rows = df.select(*[c for c in df.columns if c != text], F.posexplode(whole).alias("pos", "frame"))
    event, data = F.regexp_extract("frame", "(?m)^event: (.*)$", 1), F.regexp_extract("frame", "(?m)^data: (.*)$", 1)
    return rows.withColumns({"event": event, "data": F.from_json(data, payload)}).where((F.col("event") != "") & (data != "")).drop("frame")
