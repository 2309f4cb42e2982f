"""The chain from results to new shops, as one plan for all requests, and the two-phase fetch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions.text import PROFILE_HOST, canonical_url
from ..operators.candidates import cluster_members, resolved
from ..operators.keys import first_of_each_shop, first_per_key, not_in
from ..operators.ordering import first_n
from ..operators.querygen import further_queries, search_queries, shortfalls
from ..sources.search import SearchProvider, budgets


def new_leads(results: DataFrame, requests: DataFrame, archive: DataFrame, profile_host: str = PROFILE_HOST) -> DataFrame:
    """Shops that the archive lacks, the first ``max_leads`` found for each request, in order."""
    distinct = first_per_key(results, ["request_id", canonical_url("url")], ["result_idx"])
    found = resolved(distinct, profile_host=profile_host).join(requests.select("request_id", "category", "country", "city", "max_leads"), "request_id")
    # A shop counts once for a request, also where only its name and city repeat.
    fresh = first_of_each_shop(not_in(found, archive, profile_host), ["first_idx", "key_pos"], ["request_id"], profile_host)
    return first_n(fresh, ["request_id"], ["first_idx", "key_pos"], "max_leads")


def fetch(provider: SearchProvider, queries: list[str], budget: int, target: int, concurrency: int, on_query: Callable[[str, int, int], None] | None = None):
    """Send queries in chunks until enough rows are there; (results without repeats or None, used).

    The stop is looked at between chunks, on rows before repeats are dropped. Where a chunk fails, its
    queries are sent one by one, and those that fail are passed over; if nothing at all came, the last
    error is raised.
    """
    spark_rows: DataFrame | None = None
    used = collected = 0
    error: Exception | None = None
    selected = queries[:budget]
    for at in range(0, len(selected), concurrency):
        if collected >= target:
            break
        chunk = selected[at : at + concurrency]
        for query in chunk:
            used += 1
            if on_query:
                on_query(query, used, len(selected))
        placed = [(q, used - len(chunk) + i) for i, q in enumerate(chunk)]
        for some in (placed, *([row] for row in placed)):
            try:
                rows = provider.search(provider.session.createDataFrame(some, "query string, place int")).cache()
                collected += rows.count()
            except Exception as failure:  # noqa: BLE001
                error = failure
                continue
            spark_rows = rows if spark_rows is None else spark_rows.unionByName(rows)
            if some is placed:
                break
    if not collected and error:
        raise error
    return spark_rows, used


def two_phase(provider: SearchProvider, request: DataFrame, budget: str | None = None, profile_host: str = PROFILE_HOST) -> DataFrame:
    """Results of one request: a first fetch and, where candidates fall short, at most one more.

    The loop depends on the data, so it runs on the driver as a few bounded jobs; a request gathers
    some hundred rows.
    """
    row = request.select("request_id", "max_leads").first()
    most, target = budgets(row["max_leads"], budget)
    width = 6 if provider.is_mock else 3
    queries = [r.query for r in search_queries(request).orderBy("pos").collect()]
    first, used = fetch(provider, queries, most, target, width)
    kind = "request_id long, result_idx long, title string, url string, snippet string, query string, provider string"

    def numbered(rows: DataFrame | None, offset: int) -> DataFrame:
        if rows is None:
            return provider.session.createDataFrame([], kind)
        plain = rows.select("title", "url", "snippet", "query", "provider").toPandas()
        plain.insert(0, "result_idx", range(offset, offset + len(plain)))
        plain.insert(0, "request_id", row["request_id"])
        whole = provider.session.createDataFrame(plain, kind)
        return first_per_key(whole, [canonical_url("url")], ["result_idx"])

    results = numbered(first, 0)
    candidates = resolved(results, profile_host=profile_host)
    blobs = cluster_members(results, profile_host=profile_host).join(results.withColumn("blob", ex.text_blob()).select("request_id", "result_idx", "blob"), ["request_id", "result_idx"])
    short = shortfalls(candidates, blobs, requests=request)
    ways = short.select("request_id", F.posexplode("patterns").alias("rank", "pattern"))
    # In the order of the ways of falling short, each query once.
    found = further_queries(ways.join(request, "request_id")).join(ways, ["request_id", "pattern"]).orderBy("rank", "pos").collect()
    extra = [q for q in dict.fromkeys(r.query for r in found) if q not in queries]
    left = target - results.count()
    if extra and used < most and left > 0:
        second, _ = fetch(provider, extra, most - used, left, width)
        if second is not None:
            results = results.unionByName(numbered(second, 1_000_000))
    return results
