"""Search results grouped into candidate shops.

A result fans out to the keys it yields; rows of one key make a candidate, whose fields come from
its first row. Candidates of one site are then merged, in the order in which they first appear.

Why the merge needs no sequential fold: the greedy rule puts a candidate into the first cluster with
the same handle or the same site. Handles are grouping keys, so two candidates never share one; a
cluster's site, once set, never changes, and one without a site can match nothing. The greedy
clusters are therefore exactly the groups of one site, plus each candidate without a site by
itself: two aggregations with map-side combine.

Nothing is collected: the results of a candidate are a table of members, so a site with a third of
all results is many rows, not one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions.text import PROFILE_HOST, host_of, profile_url


def extracted(results: DataFrame, profile_host: str = PROFILE_HOST) -> DataFrame:
    """Results with ``blob, handles, websites, telegram, whatsapp, keys``."""
    return (
        results.withColumn("blob", ex.text_blob())
        .withColumns({"handles": ex.handles(profile_host=profile_host), "websites": ex.websites(profile_host=profile_host), "telegram": ex.telegram(), "whatsapp": ex.whatsapp()})
        .withColumn("keys", ex.candidate_keys()))


def members(results: DataFrame, scope: str = "request_id", order: str = "result_idx", profile_host: str = PROFILE_HOST) -> DataFrame:
    """A row per result and key, with the fields a candidate takes from it and its place in the order."""
    rows = extracted(results, profile_host)
    # Keys are never empty; the outer form keeps Spark from testing so by extracting them twice.
    return rows.select(
        scope, order, F.posexplode_outer("keys").alias("key_pos", "key"), "url", "blob", ex.name_in_title().alias("business_name"),
        F.nullif("snippet", F.lit("")).alias("bio"), ex.site_of(profile_host=profile_host).alias("website"),
        F.try_element_at("websites", F.lit(1)).alias("listed"), "telegram", "whatsapp"
    ).withColumn("at", F.struct(order, "key_pos"))


def grouped(rows: DataFrame, scope: str = "request_id", profile_host: str = PROFILE_HOST) -> DataFrame:
    """One candidate per scope and key."""
    first = lambda c: F.min_by(c, "at").alias(c)
    by_key = rows.groupBy(scope, "key").agg(
        F.min("at").alias("at"), first("business_name"), first("bio"), first("telegram"), first("whatsapp"),
        F.min_by("website", "at").alias("first_site"), F.min_by("listed", F.when(F.col("listed").isNotNull(), F.col("at"))).alias("next_site"),
        F.count("*").alias("results"))
    handle = F.when(~F.col("key").rlike("^(?:web|url):"), F.col("key"))
    return by_key.withColumns({"username": handle, "instagram_url": profile_url(handle, profile_host), "website": F.coalesce("first_site", "next_site")}).drop("first_site", "next_site")


def merged(candidates: DataFrame, scope: str = "request_id", profile_host: str = PROFILE_HOST) -> DataFrame:
    """Candidates of one site as one; missing fields are filled in order of appearance.

    Name and bio stay those of the first candidate, even if it has none.
    """
    host = host_of("website")
    cluster = F.coalesce(F.when(host != profile_host, F.concat(F.lit("site:"), host)), F.concat(F.lit("key:"), F.col("key")))
    filled = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return candidates.withColumn("cluster", cluster).groupBy(scope, "cluster").agg(
        F.min("at").alias("at"), filled("username"), filled("instagram_url"), F.min_by("business_name", "at").alias("business_name"),
        F.min_by("bio", "at").alias("bio"), filled("website"), filled("telegram"), filled("whatsapp"),
        F.count("*").alias("keys"), F.sum("results").alias("results"))


def resolved(results: DataFrame, scope: str = "request_id", order: str = "result_idx", profile_host: str = PROFILE_HOST) -> DataFrame:
    """Candidate shops of each scope, with ``first_idx`` and ``key_pos`` as their order."""
    found = merged(grouped(members(results, scope, order, profile_host), scope, profile_host), scope, profile_host)
    return found.select(scope, F.col(f"at.{order}").alias("first_idx"), "at.key_pos", *[c for c in found.columns if c not in (scope, "at")])


def cluster_members(results: DataFrame, scope: str = "request_id", order: str = "result_idx", profile_host: str = PROFILE_HOST) -> DataFrame:
    """Which results belong to which cluster: ``scope, cluster, result``, distinct."""
    rows = members(results, scope, order, profile_host)
    host = host_of("website")
    cluster = F.coalesce(F.when(host != profile_host, F.concat(F.lit("site:"), host)), F.concat(F.lit("key:"), F.col("key"))).alias("cluster")
    homes = grouped(rows, scope, profile_host).select(scope, "key", cluster)
    return rows.select(scope, "key", order).join(homes, [scope, "key"]).select(scope, "cluster", order).distinct()
