"""Files of search results, grouped into shops and added to the archive batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import PROFILE_HOST
from ..operators.candidates import resolved
from ..operators.keys import first_per_key
from ..functions.text import canonical_url
from ..sources.archive import add_new


def new_shops(results: DataFrame, profile_host: str = PROFILE_HOST) -> DataFrame:
    """The shops of one batch of results, first row of each address."""
    distinct = first_per_key(results, ["request_id", canonical_url("url")], ["result_idx"])
    found = resolved(distinct, profile_host=profile_host)
    return found.select("request_id", "first_idx", "username", "instagram_url", "business_name", "bio", "website", "telegram", "whatsapp", F.lit(None).cast("string").alias("city"))


def ingest(spark: SparkSession, source: str, schema: str, archive: str, checkpoint: str, profile_host: str = PROFILE_HOST) -> StreamingQuery:
    """Start the job over all files there now. A batch that is run again adds nothing twice."""

    def batch(rows: DataFrame, _number: int) -> None:
        add_new(archive, new_shops(rows, profile_host), "first_idx", profile_host)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
