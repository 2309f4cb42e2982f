"""Small reshapings: unpivoting a struct, defaults, first and last by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivoted(df: DataFrame, keys: list[str], struct: str) -> DataFrame:
    """A row for each field of a struct: ``keys, name, value``; a null struct gives null values."""
    names = [f.name for f in df.schema[struct].dataType.fields]
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{struct}.{n}").alias("value")) for n in names])
    return df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.name", "e.value")


def ends(df: DataFrame, scope: list[str], order: Column, value: str) -> DataFrame:
    """First and last value of each scope in a total order."""
    return df.groupBy(*scope).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.count("*").alias("rows"))


def counted(df: DataFrame, scope: list[str], **conditions: Column) -> DataFrame:
    """How many rows of each scope fulfil each condition."""
    return df.groupBy(*scope).agg(F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()])
