"""The archive of leads: reading with defaults, writing, adding what is new."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import PROFILE_HOST
from ..operators.keys import first_of_each_shop, not_in
from ..plans.durable import stored
from ..schema import BREAKDOWN, LEAD, LEAD_COLUMNS


def _camel(name: str) -> str:
    return re.sub("_([a-z])", lambda m: m.group(1).upper(), name)


def with_defaults(df: DataFrame) -> DataFrame:
    """The columns of a lead, each with its default where the stored value is missing; others go."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    out = []
    for name, kind, default in LEAD_COLUMNS:
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if default == "now":
            value = F.coalesce(value, now)
        elif default == "zeros":
            value = F.coalesce(value, F.from_json(F.lit("{" + ",".join(f'"{f.split(":")[0]}":0' for f in BREAKDOWN[7:-1].split(",")) + "}"), BREAKDOWN))
        elif default is not None:
            value = F.coalesce(value, F.expr(default).cast(kind))
        out.append(value.alias(name))
    return df.select(*[c for c in df.columns if c not in {n for n, _, _ in LEAD_COLUMNS} and c == "lead_id"], *out)


def read_json_archive(spark: SparkSession, path: str) -> DataFrame:
    """Leads with camel-case names: a ``.json`` file with one array, or a folder of JSON lines.

    A missing file is an empty archive.
    A file that is there but broken raises: reading it as empty would let the next write destroy it.
    """
    schema = re.sub(r"\b([a-z]+(?:_[a-z]+)+)\b(?=[ :])", lambda m: _camel(m.group(1)), LEAD)
    try:
        raw = spark.read.schema(schema).option("multiLine", path.endswith(".json")).option("mode", "FAILFAST").json(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        raw = spark.createDataFrame([], schema)
    kinds = {name: kind for name, kind, _ in LEAD_COLUMNS}
    return with_defaults(raw.select(*[F.col(_camel(name)).cast(kind).alias(name) for name, kind in kinds.items()]))


def write_json_archive(leads: DataFrame, path: str) -> None:
    """The whole archive as JSON lines with camel-case names, in place of what is there.

    For exchange; an archive that grows is a Parquet table to which ``add_new`` appends.
    """
    names = {name: kind for name, kind, _ in LEAD_COLUMNS}
    camel = {name: re.sub(r"\b([a-z]+(?:_[a-z]+)+)\b(?=:)", lambda m: _camel(m.group(1)), kind) for name, kind in names.items()}
    leads.select(*[F.col(n).cast(k).alias(_camel(n)) for n, k in camel.items()]).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def listed(leads: DataFrame) -> tuple[DataFrame, int]:
    """The leads from the newest on, and their number."""
    return leads.orderBy(F.col("discovered_at").desc_nulls_last()), leads.count()


def add_new(archive_path: str, leads: DataFrame, order: str, profile_host: str = PROFILE_HOST) -> DataFrame:
    """Append the leads that the Parquet archive lacks, one of each shop; returns them.

    One append for a batch replaces a rewrite for every lead; which leads stay is as if they had been
    added one after the other in ``order``, which tells them apart.
    """
    spark = leads.sparkSession
    try:
        known = spark.read.parquet(archive_path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        known = leads.limit(0)
    # Written down, since what is known changes with the append.
    fresh = stored(first_of_each_shop(not_in(leads, known, profile_host), [order], profile_host=profile_host), "fresh-leads")
    fresh.write.mode("append").parquet(archive_path)
    return fresh
