"""Freely typed values mapped to a reference list (problem 4).

Method: token-level repair. Every distinct token (and every run of adjacent tokens written as one that
is not longer than the longest entry, which mends values split or joined by mistake) is joined to the reference vocabulary by edit
distance; the join is an equi-join on deletion neighbourhoods, followed by the exact distance. The
repaired tokens vote for complete entries by soft TF-IDF. All of it runs on distinct values, which
are joined back to the rows at the end.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import stored
from ..sources.tables import table
from .lookalikes import BLANKS, IGNORABLE, JOINER, by_table, language_of

#: Share of an entry's weight that repaired tokens must cover.
LEAST_COVER = 0.7
#: Edits allowed in a token of up to this many letters, and in a longer one.
SHORT_TOKEN, SHORT_EDITS, LONG_EDITS = 4, 1, 2

_WORD = regex.compile("[\\p{L}\\p{M}\\p{N}]+")
_UNIT = regex.compile(f"[\\p{{L}}\\p{{M}}\\p{{N}}{IGNORABLE}{JOINER}]+")
_CAMEL = regex.compile("(?<=\\p{Ll})(?=\\p{Lu})")


def tokens_of(value: str) -> list[str]:
    """Folded tokens: one form for look-alikes, lower case, compounds in one word split.

    The lists have Persian names, so the Arabic script is read as Persian.
    """
    language = language_of(value).replace("ar", "fa")
    kept = _UNIT.sub(lambda m: by_table(m.group(), language)[0], value)
    spaced = _CAMEL.sub(" ", kept.replace(JOINER, " ").replace("&", " and "))
    return [w.lower() for w in _WORD.findall(spaced)]


def runs_of(tokens: list[str], longest: int) -> list[tuple[str, int, int]]:
    """(text, first token, number of tokens) of each token, and of each run of up to ``longest`` letters."""
    found = []
    for i, token in enumerate(tokens):
        found.append((token, i, 1))
        text = token
        for n in range(2, len(tokens) - i + 1):
            text += tokens[i + n - 1]
            if len(text) > longest:
                break
            found.append((text, i, n))
    return found


def edits_allowed(token: str) -> int:
    return SHORT_EDITS if len(token) <= SHORT_TOKEN else LONG_EDITS


def neighbours(token: str) -> set[str]:
    """The token with up to the allowed number of letters left out."""
    found = {token}
    for n in range(1, edits_allowed(token) + 1):
        if n < len(token):
            found.update("".join(token[i] for i in range(len(token)) if i not in out) for out in map(set, combinations(range(len(token)), n)))
    return found


def edit_distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours; ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        earlier, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, earlier[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _tokenise(longest: int):
    def run(batches):
        for batch in batches:
            rows = [runs_of(tokens_of(v), longest) for v in batch.column("value").to_pylist()]
            kind = pa.list_(pa.struct([("gram", pa.string()), ("first", pa.int32()), ("width", pa.int32())]))
            grams = pa.array([[{"gram": g, "first": i, "width": n} for g, i, n in row] for row in rows], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, grams], names=[*batch.schema.names, "grams"])

    return run


def _spread(longest: int):
    """Each token with its deletion neighbourhood; one that no entry can be a few edits from has none."""

    def run(batches):
        for batch in batches:
            lists = [sorted(neighbours(token)) if len(token) <= longest else [] for token in batch.column("token").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.string()))], names=[*batch.schema.names, "near"])

    return run


def _measure(batches):
    for batch in batches:
        a, b = batch.column("token").to_pylist(), batch.column("ref").to_pylist()
        most = [min(edits_allowed(x), edits_allowed(y)) for x, y in zip(a, b, strict=True)]
        d = pa.array([edit_distance(x, y, m) for x, y, m in zip(a, b, most, strict=True)], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, d, pa.array(most, pa.int32())], names=[*batch.schema.names, "d", "most"])


def _near(tokens: DataFrame, longest: int) -> DataFrame:
    return tokens.mapInArrow(_spread(longest), "field string, token string, near array<string>").select("field", "token", F.explode("near").alias("near"))


def reference_entries(names: DataFrame) -> DataFrame:
    """``field, ref_id, entry, ref, idf, weight``: tokens of each name, and the name as one word."""
    runs = names.select("field", "ref_id", F.col("name").alias("value")).distinct().mapInArrow(
        _tokenise(0), "field string, ref_id long, value string, grams array<struct<gram:string,first:int,width:int>>")
    entries = runs.withColumn("n", F.size(F.filter("grams", lambda g: g.width == 1))).where("n > 0")
    words = entries.select("field", "ref_id", F.concat(F.lit("w:"), "value").alias("entry"), F.explode(F.array_distinct(F.transform(F.filter("grams", lambda g: g.width == 1), lambda g: g.gram))).alias("ref"))
    whole = entries.where("n > 1").select("field", "ref_id", F.concat(F.lit("c:"), "value").alias("entry"), F.array_join(F.transform(F.filter("grams", lambda g: g.width == 1), lambda g: g.gram), "").alias("ref"))
    both = words.unionByName(whole)
    total = words.groupBy("field").agg(F.countDistinct("entry").alias("entries"))
    idf = both.groupBy("field", "ref").agg(F.countDistinct("entry").alias("df")).join(total, "field").select(
        "field", "ref", F.log1p(F.col("entries") / F.col("df")).alias("idf"))
    weighted = both.join(idf, ["field", "ref"])
    norms = weighted.groupBy("field", "ref_id", "entry").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"), F.sum("idf").alias("total"))
    return weighted.join(norms, ["field", "ref_id", "entry"])


def match_values(values: DataFrame, names: DataFrame, least_cover: float = LEAST_COVER) -> DataFrame:
    """``field, value, ref_id, score``: one row per distinct value, ref_id 0 where no entry fits.

    ``values`` has (field, value), ``names`` (field, ref_id, name). Null values give no row; a value
    without letters or digits, and any value where a list is empty, comes out as 0. Ties between
    entries go to the smaller ref_id. Values of any length are read whole; repeated rows count once.
    """
    distinct = values.select("field", "value").where("value is not null").distinct()
    entries = stored(reference_entries(names), "entries")
    # One number: no longer token can be within the allowed edits of an entry.
    longest = (entries.agg(F.max(F.length("ref"))).first()[0] or 0) + LONG_EDITS
    grams = distinct.mapInArrow(_tokenise(longest), "field string, value string, grams array<struct<gram:string,first:int,width:int>>")
    flat = stored(grams.select("field", "value", F.explode("grams").alias("g")).select("field", "value", "g.*"), "grams")
    tokens = flat.groupBy("field", F.col("gram").alias("token")).agg(F.countDistinct("value").alias("df"))
    total = distinct.groupBy("field").agg(F.count("*").alias("n"))
    # The repair join: equal members of the deletion neighbourhoods, then the exact distance.
    vocabulary = _near(entries.select("field", F.col("ref").alias("token")).distinct(), longest).withColumnRenamed("token", "ref")
    pairs = _near(tokens.select("field", "token"), longest).join(vocabulary, ["field", "near"]).select("field", "token", "ref").distinct()
    # Two swaps are four edits without swaps: a bound inside the JVM before the exact distance.
    close = pairs.where(F.levenshtein("token", "ref", 2 * LONG_EDITS) >= 0)
    repaired = close.mapInArrow(_measure, "field string, token string, ref string, d int, most int").where("d <= most").select(
        "field", "token", "ref", (1 - F.col("d") / (F.length("ref") + 1)).alias("near"))
    repaired = stored(repaired, "repaired")
    weights = tokens.join(total, "field").select("field", "token", F.log1p(F.col("n") / F.col("df")).alias("idf"))
    weighed = flat.withColumnRenamed("gram", "token").join(weights, ["field", "token"])
    norms = weighed.where("width = 1").groupBy("field", "value").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm_v"))
    votes = (
        weighed.join(repaired, ["field", "token"]).join(norms, ["field", "value"]).join(entries.withColumnRenamed("idf", "idf_r"), ["field", "ref"])
        .groupBy("field", "value", "ref_id", "entry", "ref").agg(
            F.max(F.col("near") * F.least(F.lit(1.0), F.col("idf") / F.col("norm_v")) * F.col("idf_r") / F.col("norm")).alias("product"),
            F.max(F.col("near") * F.col("idf_r") / F.col("total")).alias("cover"))
        .groupBy("field", "value", "ref_id", "entry").agg(F.sum("product").alias("product"), F.sum("cover").alias("cover"))
        .where(F.col("cover") >= least_cover)
        .groupBy("field", "value", "ref_id").agg(F.max(F.col("product") + F.col("cover")).alias("score"))
        .groupBy("field", "value").agg(F.max_by("ref_id", F.struct(F.round("score", 6), -F.col("ref_id"))).alias("ref_id"), F.max("score").alias("score")))
    return distinct.join(votes, ["field", "value"], "left").select(
        "field", "value", F.coalesce("ref_id", F.lit(0)).cast("long").alias("ref_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _names(spark: SparkSession, root: str) -> DataFrame:
    city = table(spark, root, "city_ref").select(F.lit("city").alias("field"), F.col("city_id").cast("long").alias("ref_id"), F.explode(F.array("name_en", "name_fa")).alias("name"))
    category = table(spark, root, "category_ref").select(
        F.lit("category").alias("field"), F.col("category_id").cast("long").alias("ref_id"),
        F.explode(F.concat(F.array("name_en", "name_fa"), F.coalesce("also_called", F.array().cast("array<string>")))).alias("name"))
    return city.unionByName(category).where("name is not null")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    names = _names(spark, root)
    rows = table(spark, root, "lead").select("lead_id", F.explode(F.create_map(F.lit("city"), "city", F.lit("category"), "category")).alias("field", "value"))
    visible = F.regexp_replace("value", f"[\\s{BLANKS}{IGNORABLE}{JOINER}]+", "") != ""
    typed = rows.where(F.col("value").isNotNull() & visible)
    odd = typed.join(names.select("field", F.col("name").alias("value")).distinct(), ["field", "value"], "left_anti")
    matched = match_values(odd, names)
    return odd.join(matched, ["field", "value"]).select("lead_id", "field", "ref_id")


def p4_values(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct value of both fields with its entry; unmatched ones are reported with 0."""
    rows = table(spark, root, "lead").select(F.explode(F.create_map(F.lit("city"), "city", F.lit("category"), "category")).alias("field", "value"))
    return match_values(rows.where("value is not null"), _names(spark, root)).select("field", "value", "ref_id", F.round("score", 4).alias("score"))


QUERIES = {"p4_found": p4_found, "p4_values": p4_values}
