"""Evidence lists: one signal per source and type, sources, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import source_id


def evidence_item(kind: str, signal: Column | str, url: Column, strength: str) -> Column:
    """One item; its source is the host of the address, or ``unknown`` without one."""
    said = F.lit(signal) if isinstance(signal, str) else signal
    return F.struct(F.lit(kind).alias("type"), said.alias("signal"), url.alias("source_url"), source_id(url).alias("source_id"), F.lit(strength).alias("strength"))


def independent_signals(evidence: Column | str) -> Column:
    """The first item of each (source, type), in order; null-safe; null gives an empty list."""
    items = F.coalesce(F.col(evidence) if isinstance(evidence, str) else evidence, F.array().cast("array<struct<type:string,signal:string,source_url:string,source_id:string,strength:string>>"))
    key = lambda e: F.concat(F.coalesce(e.source_id, F.lit("null")), F.lit(":"), F.coalesce(e.type, F.lit("null")))
    keys = F.transform(items, key)
    return F.filter(items, lambda e, i: F.array_position(keys, key(e)) == i + 1)


def source_count(evidence: Column | str) -> Column:
    """Distinct sources of items that are not weak."""
    items = F.coalesce(F.col(evidence) if isinstance(evidence, str) else evidence, F.array().cast("array<struct<type:string,signal:string,source_url:string,source_id:string,strength:string>>"))
    strong = F.filter(items, lambda e: ~F.coalesce(e.strength == "weak", F.lit(False)))
    return F.size(F.array_distinct(F.transform(strong, lambda e: e.source_id)))


def evidence_quality(first: Column | str, second: Column | str, urls: Column | str) -> Column:
    """35 for each distinct source of either list and 10 if there is an address, at most 100."""
    empty = F.array().cast("array<struct<type:string,signal:string,source_url:string,source_id:string,strength:string>>")
    both = F.concat(*[F.coalesce(F.col(c) if isinstance(c, str) else c, empty) for c in (first, second)])
    sources = F.size(F.array_distinct(F.transform(both, lambda e: e.source_id)))
    any_url = F.when(F.size(F.coalesce(F.col(urls) if isinstance(urls, str) else urls, F.array().cast("array<string>"))) > 0, 10).otherwise(0)
    return F.least(F.lit(100), sources * 35 + any_url)
