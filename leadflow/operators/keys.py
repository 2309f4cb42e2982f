"""Rows by key: first of each, and those that another table has or lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PROFILE_HOST, business_key, host_of, norm_handle
from ..plans.durable import discard_tables, stored


def first_per_key(df: DataFrame, key: list[Column | str], order: list[Column | str], keep_null: bool = False) -> DataFrame:
    """The first row of each key in the given order, which must be total.

    Spark prunes to one row per key before the shuffle (window group limit), so a hot key moves one
    row per task. Rows whose key has a null or '' are dropped unless ``keep_null``.
    """
    columns = [k if isinstance(k, Column) else F.col(k) for k in key]
    names = [f"__k{i}" for i in range(len(columns))]
    keyed = df.withColumns(dict(zip(names, columns, strict=True)))
    if not keep_null:
        for name in names:
            keyed = keyed.where(F.col(name).cast("string") != "")
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    return keyed.withColumn("__rn", rank).where("__rn = 1").drop("__rn", *names)


def shop_keys(df: DataFrame, profile_host: str = PROFILE_HOST) -> DataFrame:
    """Adds the three keys by which two shops count as one; null where a shop has none."""
    city = F.nullif(F.trim(F.lower("city")), F.lit(""))
    host = host_of("website")
    return df.withColumns({
        "key_handle": norm_handle(F.coalesce("username", "instagram_url"), profile_host),
        "key_host": F.when(host != profile_host, host),
        "key_name": F.when(city.isNotNull(), F.concat_ws("\x1f", business_key("business_name"), city)).cast("string"),
    }).withColumn("key_name", F.when(business_key("business_name").isNotNull(), F.col("key_name")))


KEYS = ("key_handle", "key_host", "key_name")


def not_in(df: DataFrame, archive: DataFrame, profile_host: str = PROFILE_HOST) -> DataFrame:
    """Rows that are the same shop as no row of ``archive``.

    Not (A or B or C) is not A and not B and not C: three anti joins on equal keys, never a nested
    loop. A null key joins nothing, so its row passes.
    """
    rows, known = shop_keys(df, profile_host), shop_keys(archive, profile_host)
    for key in KEYS:
        rows = rows.join(known.select(key).where(f"{key} is not null").distinct(), key, "left_anti")
    return rows.select(*df.columns)


def also_in(df: DataFrame, archive: DataFrame, profile_host: str = PROFILE_HOST) -> DataFrame:
    """Rows that are the same shop as some row of ``archive``, once each."""
    rows, known = shop_keys(df, profile_host), shop_keys(archive, profile_host)
    for key in KEYS:
        seen = known.select(key).where(f"{key} is not null").distinct().withColumn(f"in_{key}", F.lit(True))
        rows = rows.join(seen, key, "left")
    return rows.where(" or ".join(f"in_{k}" for k in KEYS)).select(*df.columns)


def first_of_each_shop(df: DataFrame, order: list[str], scope: list[str] | None = None, profile_host: str = PROFILE_HOST) -> DataFrame:
    """The rows that stay if they are taken in ``order`` and one that is the same shop as a row taken before is left out.

    A row that was left out leaves nobody out itself, so a first row for each key is not enough. In
    rounds: a row that comes first for every key it has is taken, and rows that share a key with it
    are left out; then the rest is looked at again. Each round decides at least the first row of every
    connected set; rounds are as many as the longest chain of decisions that hang on each other. The
    columns of ``order`` and ``scope`` tell the rows apart; rows without a key stay. Nothing is gathered by
    key: a hot key is one minimum, combined before the shuffle.
    """
    scope = scope or []
    place = [*scope, *order]
    # Read several times below.
    df = stored(df, "shops")
    rows = shop_keys(df, profile_host)
    key = F.explode(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k))) for k in KEYS]))).alias("key")
    open_keys = stored(rows.select(*scope, F.struct(*order).alias("at"), key), "open-keys")
    taken = None
    while not open_keys.isEmpty():
        first = open_keys.groupBy(*scope, "key").agg(F.min("at").alias("first"))
        wins = stored(open_keys.join(first, [*scope, "key"]).groupBy(*scope, "at").agg(F.min(F.col("at") == F.col("first")).alias("wins")).where("wins").select(*scope, "at"), "taken")
        taken = wins if taken is None else taken.unionByName(wins)
        held = open_keys.join(wins, [*scope, "at"]).select(*scope, "key").distinct()
        out = open_keys.join(held, [*scope, "key"], "left_semi").select(*scope, "at").distinct()
        before, open_keys = open_keys, stored(open_keys.join(out, [*scope, "at"], "left_anti"), "open-keys")
        discard_tables(before)
    keyless = rows.where(" and ".join(f"{k} is null" for k in KEYS)).select(*df.columns)
    if taken is None:
        return keyless
    return df.join(taken.select(*scope, "at.*"), place, "left_semi").unionByName(keyless)


def same_shop_links(a: DataFrame, b: DataFrame, a_id: str, b_id: str, profile_host: str = PROFILE_HOST) -> DataFrame:
    """``a_id, b_id, shared``: for each row of ``a`` and each key the smallest row of ``b`` that has it.

    Copies in ``b`` are represented by their first row, so that a hot key gives one link a row.
    """
    left, right = shop_keys(a, profile_host), shop_keys(b, profile_host)
    parts = []
    for key in KEYS:
        first = right.where(f"{key} is not null").groupBy(key).agg(F.min(b_id).alias("__b"))
        parts.append(left.where(f"{key} is not null").join(first, key).select(F.col(a_id), F.col("__b").alias(b_id), F.lit(key[4:]).alias("shared")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
