"""Orders, positions and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..plans.durable import stored


#: The largest limit that a valid request can have.
MOST_ROWS = 50


def lead_order(tie: str = "lead_id") -> list[Column]:
    """The eleven descending keys of a lead, nulls as 0, then the order of discovery."""
    rank = F.coalesce(*[F.when(F.col("iran_verification_status") == s, F.lit(n)) for s, n in lx.STATUS_RANK], F.lit(0))
    part = lambda c: F.coalesce(F.col(c), F.lit(0))
    keys = [
        part("overall_confidence"), rank, part("score_breakdown.business_authenticity"), part("score_breakdown.commercial_intent"),
        part("score_breakdown.online_shop_strength"), part("shop_bot_fit"), part("customer_message_potential"), part("evidence_quality_score"),
        part("score_breakdown.activity_recency"), part("score_breakdown.contactability"), part("score")]
    return [*[k.desc() for k in keys], F.col(tie).asc()]


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """The rows with their place, from 1, in a total order over the whole table.

    A global window would put all rows into one task. Instead the table is range-sorted and stored;
    a row's place is its place within its partition plus the sizes of the partitions before, of
    which there is one number per partition.
    """
    ordered = stored(df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "ordered")
    row = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    return ordered.join(F.broadcast(before), "__part").withColumn(name, row + F.col("__before") + 1).drop("__part", "__row", "__before")


def first_n(df: DataFrame, scope: list[str], order: list[Column | str], limit: Column | str, most: int = MOST_ROWS) -> DataFrame:
    """The first rows of each scope in order, as many as its limit column says.

    This is the early stop of a sequential loop: rows past the limit are never looked at, so a later
    sort ranks the first rows found and not the best of all. No limit exceeds ``most``, which is a literal
    so that Spark prunes to as many rows of each scope before the shuffle.
    """
    asked = F.col(limit) if isinstance(limit, str) else limit
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where((F.col("__rn") <= F.lit(most)) & (F.col("__rn") <= asked)).drop("__rn")


def weighted_score(struct: str, weights: tuple[tuple[str, float], ...] = lx.SCORE_WEIGHTS) -> Column:
    """Weighted sum of the clamped, rounded parts of a struct, rounded; nulls as 0."""
    total = F.lit(0.0)
    for name, weight in weights:
        part = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(F.coalesce(F.col(f"{struct}.{name}"), F.lit(0)).cast("double"))))
        total = total + part * F.lit(weight)
    return F.round(total).cast("int")


def banded(value: Column, bands: tuple[tuple[int, str], ...] = lx.TIERS, lowest: str = lx.LOWEST_TIER) -> Column:
    """The name of the highest band whose bound the value reaches."""
    return F.coalesce(*[F.when(value >= bound, F.lit(name)) for bound, name in bands], F.lit(lowest))
