"""Search queries of a request, from templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import mentions_any


def tidy(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, "[\\s\\u00a0]+", " "))


def term_list(category: Column) -> Column:
    """The category and the terms of the first synonym rule that fits it, distinct, at most five."""
    extra = F.coalesce(*[F.when(category.rlike(p), F.array(*map(F.lit, t))) for p, t in lx.SYNONYMS], F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(F.array(category), extra)), 1, lx.MOST_TERMS)


def area_code(city: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(F.lower(city), F.lit(name)), F.lit(code)) for name, code in lx.AREA_CODES])


def _fill(template: str, values: dict[str, Column]) -> Column:
    """A template as one concatenation; null where a value is."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = rest.find("{")
        if at < 0:
            parts.append(F.lit(rest))
            break
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[rest[at + 1]])
        rest = rest[at + 3 :]
    return F.concat(*parts)


def _when(flag: str, home: Column, city: Column) -> Column:
    return {"a": F.lit(True), "c": city, "h": home, "hc": home & city, "n": ~home, "nc": ~home & city}[flag]


def search_queries(requests: DataFrame, extra: Column | None = None) -> DataFrame:
    """``request_id, pos, query``: the first 48 distinct queries of each request, in order.

    The templates are expressions over one row, so nothing is joined or shuffled. Blank queries are
    left out; a null city counts as none. ``extra`` (an array column) comes last.
    """
    category, country = tidy_ends("category"), tidy_ends("country")
    city = F.nullif(tidy_ends("city"), F.lit(""))
    home, has_city = F.coalesce(country.rlike(lx.HOME_COUNTRY), F.lit(False)), city.isNotNull()
    values = {"k": country, "c": city, "p": F.coalesce(city, F.lit(lx.HOME))}

    def lines(term: Column, templates) -> Column:
        return F.array(*[F.when(_when(flag, home, has_city), _fill(t, values | {"t": term})) for flag, t in templates])

    by_term = F.flatten(F.transform(term_list(category), lambda t: lines(t, lx.TERM_TEMPLATES)))
    every = F.concat(by_term, lines(category, lx.TAIL_TEMPLATES), *([extra] if extra is not None else []))
    kept = F.filter(F.transform(F.array_compact(every), tidy), lambda q: q != "")
    return requests.select("request_id", F.posexplode(F.slice(F.array_distinct(kept), 1, lx.MOST_QUERIES)).alias("pos", "query"))


def tidy_ends(name: str) -> Column:
    return F.regexp_replace(F.col(name), "^[\\s\\u00a0]+|[\\s\\u00a0]+\\z", "")


def further_queries(requests: DataFrame, pattern: str = "pattern") -> DataFrame:
    """``request_id, pattern, pos, query`` for rows of (request, way of falling short)."""
    city = F.coalesce("city", F.lit(""))
    filled = F.nullif(city, F.lit(""))
    values = {"t": F.col("category"), "c": city, "p": F.coalesce(filled, F.lit(lx.HOME)), "q": F.coalesce(filled, F.lit(lx.CAPITAL)), "d": area_code(city)}
    lines = F.array(*[F.when(F.col(pattern) == p, _fill(t, values)) for p, t in lx.FURTHER_TEMPLATES])
    kept = F.filter(F.transform(F.array_compact(lines), tidy), lambda q: q != "")
    return requests.select("request_id", F.col(pattern).alias("pattern"), F.posexplode(F.array_distinct(kept)).alias("pos", "query"))


def shortfalls(candidates: DataFrame, blobs: DataFrame, scope: str = "request_id", requests: DataFrame | None = None) -> DataFrame:
    """``scope, patterns``: in which ways the candidates of a scope fall short, in fixed order.

    ``blobs`` has (scope, cluster, blob); a candidate counts once however many of its texts match.
    A scope of ``requests`` that has no candidates falls short in the way ``duplicates``.
    """
    marks = blobs.groupBy(scope, "cluster").agg(F.max(mentions_any("blob", lx.INFLUENCER_WORDS)).alias("influencer"), F.max(mentions_any("blob", lx.FOREIGN_WORDS)).alias("foreign"))
    n = F.col("n")
    counts = candidates.join(marks, [scope, "cluster"], "left").groupBy(scope).agg(
        F.count("*").alias("n"), F.count_if("influencer").alias("influencers"), F.count_if("foreign").alias("abroad"),
        F.count_if(F.col("username").isNotNull() & F.col("website").isNull()).alias("bare"), F.countDistinct("username").alias("users"))
    found = F.array_compact(F.array(
        F.when(F.col("influencers") > n / 4, F.lit("influencers")), F.when(F.col("abroad") > n / 5, F.lit("foreign")),
        F.when(F.col("bare") > n / 2, F.lit("generic_instagram")), F.when((n > 8) & (F.col("users") < n / 3), F.lit("duplicates"))))
    counted = counts.select(scope, "n", "influencers", "abroad", "bare", "users", found.alias("patterns"))
    if requests is None:
        return counted
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return counted.join(requests.select(scope).distinct(), scope, "full").select(
        scope, *map(zero, ("n", "influencers", "abroad", "bare", "users")), F.coalesce("patterns", F.array(F.lit("duplicates"))).alias("patterns"))


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests within bounds: category 2 to 80 letters, country 2 to 40, city at most 40, limit 1 to 50."""
    size = lambda c: F.length(tidy_ends(c))
    ok = [size("category").between(2, 80), size("country").between(2, 40), F.col("city").isNull() | (size("city") <= 40), F.col("max_leads").between(1, 50)]
    return requests.where(reduce(lambda a, b: a & b, ok))
