"""New batches checked against all history (problem 5).

Method: an index on disk holds, partitioned by a hash of the key, the exact keys of every shop record
(account, site) and, for every distinct account, minwise band keys with a sketch of its signature. A
batch finds out which partitions its own keys fall into, reads those only, verifies what it meets, and
appends the keys that the index lacks. History is read by key, never compared row by row, and it
stays where it lies: the keys of a batch travel to it, not the other way round.

Copies of a key are one node of the index, so that a key held by a third of all rows is one entry
and costs one comparison. Nodes that a later record shows to be the same shop are joined when the
result is asked for, over the links alone.

Accounts too short for shingles have, in place of bands, the keys of their deletion neighbourhood, by
which every slip is met; where both kinds end, an account has both.
"""

from __future__ import annotations

import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import discard, discard_tables, names_in, stored, stored_path, touch
from ..sources.tables import table
from .copies import canonical_address, canonical_handle
from .reference_match import edit_distance

#: Minwise bands and rows in a band; the README has their recall for slips of each kind.
BANDS, ROWS = 48, 2
#: Letters between the two parts of a shingle: at least so many that one shared word makes few equal
#: shingles, at most so many that the shingles of a text grow in proportion to it.
SPAN, FAR_SPAN = 5, 40
#: Accounts of up to this many letters are met by their deletion neighbourhood.
SHORT = 12
#: Partitions of a new index by hash of the key. A deployment gives each some hundred MB. From
#: ``PRUNED_FROM`` partitions on a batch first finds out which ones its keys fall into.
BUCKETS, PRUNED_FROM = 8, 64
#: Keys of a batch (8 bytes each, or a short text) that travel to the index as a broadcast; beyond it
#: both sides are shuffled.
SENT_KEYS = 1_000_000
#: Bits by which the 64-bit sketches of a slip and its account may differ: slips differ by 20 with a
#: deviation of 4, so that six deviations are left.
SKETCH_BITS = 44
#: Letters from which an account can hold a slip: every word of three is a slip away from many others.
LEAST_LETTERS = 4
#: A host is shared by many shops if so many of its paths are each the account of a record that names it.
OWN_PATHS = 2
#: Where records name no accounts: a host with so many paths that are no pages, each new on most records.
OTHER_PATHS, NEW_SHARE = 4, 0.75
# Paths that are pages of a site.
PAGES = """about cart catalog catalogue category categories contact en entry explore fa faq home index info item items list main menu news
 order orders page pages post posts prices product products profile sale search shop shops store stores tag tags terms""".split()

_PROFILE = "^(?:m\\.)?instagram\\.[a-z]+/([^/?#]+)"


def compact(account: Column) -> Column:
    """An account without separators."""
    return F.regexp_replace(account, "[^\\p{L}\\p{N}]", "")


def host_and_path(website: Column) -> tuple[Column, Column]:
    address = canonical_address(website)
    return F.regexp_extract(address, "^([^/?#]+\\.[^/?#]+)", 1), F.regexp_extract(address, "^[^/?#]+/([^/?#]+)", 1)


def record_fields(records: DataFrame, row_id: str = "lead_id", *also: Column) -> DataFrame:
    """``id, a1, a2, host, path`` and ``also``: accounts and site of each record; '' for blank and missing ones."""
    host, path = host_and_path(F.col("website"))
    return records.select(
        F.col(row_id).cast("long").alias("id"), compact(canonical_handle(F.col("username"))).alias("a1"),
        compact(F.regexp_extract(canonical_address(F.col("instagram_url")), _PROFILE, 1)).alias("a2"), host.alias("host"), path.alias("path"), *also,
    ).where("id is not null")


_SITE = "host string, path string, id long, n long, own boolean"


def sites_of(fields: DataFrame, *by: str) -> DataFrame:
    """``host, path, id, n, own``: how many records name a path of a host, the first of them, and
    whether it is the account of one; for each value of ``by``, if it is given."""
    own = (F.col("account") == F.col("a1")) | (F.col("account") == F.col("a2"))
    return fields.where("host <> '' and path <> ''").withColumn("account", compact(F.col("path"))).groupBy("host", "path", *by).agg(
        F.min("id").alias("id"), F.count("*").alias("n"), F.max(own).alias("own"))


def shared_among(sites: DataFrame) -> DataFrame:
    """``host``: the hosts that, by the evidence of their own records, are shared by many shops."""
    other = ~F.col("path").isin(PAGES)
    return sites.groupBy("host", "path").agg(F.sum("n").alias("n"), F.max("own").alias("own")).groupBy("host").agg(
        F.count_if("own").alias("owned"), F.count_if(other).alias("paths"), F.sum(F.when(other, F.col("n"))).alias("named")
    ).where((F.col("owned") >= OWN_PATHS) | ((F.col("paths") >= OTHER_PATHS) & (F.col("paths") >= NEW_SHARE * F.col("named")))).select("host")


def shared_at_a_batch(sites: DataFrame) -> DataFrame:
    """``host``: the hosts that ``shared_among`` finds after one of the batches, each with all before it.

    ``sites`` has the number of the batch besides. A host has one row for each batch that names it, so
    the windows hold few rows.
    """
    other, path = ~F.col("path").isin(PAGES), Window.partitionBy("host", "path")
    steps = sites.groupBy("host", "path", "batch").agg(F.sum("n").alias("n"), F.max("own").alias("own")).select(
        "host", "batch", F.when(other, F.col("n")).alias("n"), (other & (F.col("batch") == F.min("batch").over(path))).alias("met"),
        (F.col("own") & (F.col("batch") == F.min(F.when(F.col("own"), F.col("batch"))).over(path))).alias("owned"))
    so_far = Window.partitionBy("host").orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = steps.groupBy("host", "batch").agg(F.count_if("owned").alias("owned"), F.count_if("met").alias("paths"), F.sum("n").alias("named")).select(
        "host", *[F.sum(c).over(so_far).alias(c) for c in ("owned", "paths", "named")])
    return grown.where((F.col("owned") >= OWN_PATHS) | ((F.col("paths") >= OTHER_PATHS) & (F.col("paths") >= NEW_SHARE * F.col("named")))).select("host").distinct()


def shared_hosts(records: DataFrame) -> DataFrame:
    """The shared hosts of a whole table (``lead_id, username, instagram_url, website``)."""
    return shared_among(sites_of(record_fields(records)))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


@lru_cache(256)
def _spans(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bigrams and trigrams that make the shingles of a text with ``n`` trigrams."""
    least = SPAN if n > 2 * SPAN else 1
    i = np.concatenate([np.arange(n - d) for d in range(least, min(FAR_SPAN, n - 1) + 1)] or [np.zeros(1, int)])
    j = i + np.concatenate([np.full(n - d, d) for d in range(least, min(FAR_SPAN, n - 1) + 1)] or [np.zeros(1, int)])
    return i, j


def signatures(texts: list[str], size: int) -> np.ndarray:
    """Minwise signature of the shingles of each text, each a bigram and a trigram some letters on.

    Texts of one length are worked on together.
    """
    a, b = _multipliers(size)
    out = np.empty((len(texts), size), np.uint64)
    by_length: dict[int, list[int]] = {}
    for row, text in enumerate(texts):
        by_length.setdefault(len(text), []).append(row)
    for length, rows in by_length.items():
        i, j = _spans(length + 1)
        step = max(1, 60_000 // len(i))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            whole = "".join(f"\x02\x02{texts[r]}\x03" for r in some)
            points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(some), -1)
            grams = (points[:, :-2] << np.uint64(42)) ^ (points[:, 1:-1] << np.uint64(21)) ^ points[:, 2:]
            grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            grams ^= grams >> np.uint64(32)
            pairs = ((points[:, :-2] << np.uint64(21)) ^ points[:, 1:-1]) * np.uint64(0x9E3779B97F4A7C15)
            shingles = (pairs[:, i] * np.uint64(0x94D049BB133111EB)) ^ grams[:, j]
            shingles ^= shingles >> np.uint64(29)
            # 32 bits are enough for an order, and the processor multiplies eight of them at once.
            shingles = ((shingles * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)
            mixed = np.empty_like(shingles)
            for k in range(size):
                np.multiply(shingles, a[k], out=mixed)
                mixed += b[k]
                # The order follows the upper bits, which the product mixes best.
                out[some, k] = mixed.min(1)
    return out


_DIGITS = regex.compile("[^\\p{N}]+")


def hash_text(text: str) -> int:
    """A stable 64-bit hash."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def deletion_keys(text: str, digits: str) -> set[int]:
    """Keys of the text and of every form with one letter left out: two texts a slip apart share one."""
    return {hash_text(f"{digits}\x1f{form}") for form in (text, *(text[:i] + text[i + 1 :] for i in range(len(text))))}


def _bands(batches):
    """Band keys and sketch of each account; digits are part of the key, since they are no slip."""
    size = max(64, BANDS * ROWS)
    for batch in batches:
        texts, ids = batch.column("text").to_pylist(), batch.column("id")
        digits = [_DIGITS.sub("", t) for t in texts]
        marks = signatures(texts, size)
        sketch = np.zeros(len(texts), np.uint64)
        for bit in range(64):
            sketch |= ((marks[:, bit] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)) << np.uint64(bit)
        places: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        long = np.array([i for i, t in enumerate(texts) if len(t) > SHORT], int)
        if len(long):
            salt = np.array([hash_text(digits[i]) for i in long], np.uint64)
            banded = np.empty((len(long), BANDS), np.uint64)
            for band in range(BANDS):
                mixed = salt + np.uint64(band * 7919 + 1)
                for k in range(ROWS):
                    mixed = (mixed ^ marks[long, band * ROWS + k]) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(31)
                banded[:, band] = mixed
            places.append(np.repeat(long, BANDS))
            keys.append(banded.reshape(-1))
        for i, text in enumerate(texts):
            if len(text) <= SHORT + 1:
                found = np.array(sorted(deletion_keys(text, digits[i])), np.uint64)
                places.append(np.full(len(found), i))
                keys.append(found)
        each = pa.array(np.concatenate(places) if places else np.zeros(0, int))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(flat.view(np.int64)), ids.take(each), batch.column("text").take(each), pa.array(sketch.view(np.int64)).take(each)],
            names=["key", "id", "text", "sketch"])


def same_but_for_slip(a: str, b: str) -> bool:
    """One letter added, lost, changed or swapped with its neighbour; digits agree."""
    return _DIGITS.sub("", a) == _DIGITS.sub("", b) and edit_distance(a, b, 1) <= 1


def _verify(batches):
    for batch in batches:
        keep = [same_but_for_slip(a, b) for a, b in zip(batch.column("text").to_pylist(), batch.column("other").to_pylist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _node() -> Column:
    return F.concat_ws(":", "kind", "text")


def account_nodes(fields: DataFrame, shared: DataFrame) -> DataFrame:
    """``fields, kind, text``: the nodes of each record: accounts, and its host unless that is shared.

    On a shared host the path is an account. Blank fields give none.
    """
    # The hosts shared by many shops are few, but their number is not bounded: Spark picks the join by size.
    known = fields.join(shared.withColumn("many", F.lit(True)), "host", "left")
    node = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    nodes = F.array(
        node("a", F.col("a1")), node("a", F.col("a2")), node("a", F.when(F.col("many"), compact(F.col("path"))).otherwise("")),
        node("h", F.when(F.col("many").isNull(), F.col("host")).otherwise("")))
    return known.withColumn("n", F.explode(F.array_distinct(nodes))).select(*fields.columns, "n.kind", "n.text").where("text <> ''")


_EXACT = "node string, known long, part string"
_BAND = "key long, id long, text string, sketch long"
_BANDS = f"{_BAND}, part string"
_LINK = "a long, b long"
# Names of no part. Long lists are looked up in a set, and then Spark's generated code does not change
# with the list, so that it is compiled once and not for every batch; texts as values of columns likewise.
_NO_PARTS = [f"none-{i}" for i in range(20)]
_ROWS = "id long, a1 string, a2 string, host string, path string, batch string"
_SITES = f"{_SITE}, part string"
_SHARED = "host string"


class ShopIndex:
    """The index of one history, below ``path``; opened again if it is there already.

    ``exact`` (by node), ``bands`` (by band key) and ``sites`` (by host) are folders of one partition
    for each hash, ``shared`` (hosts shared by many shops), ``rows`` and ``links`` of one for each
    batch. A part counts once its name stands in ``done``: what a broken run left behind is never read.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path = spark, path
        held = [n for n in names_in(spark, f"{path}/meta") if n.startswith("buckets-")]
        self.buckets = int(held[0].split("-")[1]) if held else buckets
        self.parts = names_in(spark, f"{path}/done")
        if not held:
            touch(spark, f"{path}/meta/buckets-{buckets}")

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _append(self, rows: DataFrame, name: str, part: str, key: str) -> None:
        # Few files for a batch: one task writes a bucket, and small ones share a task.
        placed = rows.withColumns({"part": F.lit(part), "bucket": self._bucket(key)}).repartition("bucket")
        placed.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _keyed(self, name: str, schema: str, buckets: list[int] | None = None, also: str | None = None) -> DataFrame:
        """The rows of a partitioned folder in the given buckets, of parts that are done and of ``also``."""
        folders = names_in(self.spark, f"{self.path}/{name}")
        wanted = [n for n in folders if n.startswith("bucket=") and (buckets is None or int(n[7:]) in buckets)]
        parts = [*self.parts, *([also] if also else [])]
        if not wanted or not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{n}" for n in wanted]).where(F.col("part").isin([*parts, *_NO_PARTS]))

    def _listed(self, name: str, schema: str, also: str | None = None) -> DataFrame:
        """The rows of a folder of parts."""
        held = set(names_in(self.spark, f"{self.path}/{name}"))
        folders = [f"{self.path}/{name}/{p}" for p in dict.fromkeys([*self.parts, *([also] if also else [])]) if p in held]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _probe(self, name: str, schema: str, keys: DataFrame, key: str, n: int, also: str | None = None) -> DataFrame:
        """The rows of the index that hold one of the ``n`` keys, read from the buckets of these keys only."""
        buckets = None
        if self.buckets >= PRUNED_FROM:
            # At most one row for each bucket comes to the driver.
            buckets = [r.bucket for r in keys.select(self._bucket(key).alias("bucket")).distinct().collect()]
        asked = keys.select(key).distinct()
        return self._keyed(name, schema, buckets, also).drop("part").join(F.broadcast(asked) if n <= SENT_KEYS else asked, key, "left_semi")

    def shared(self, also: str | None = None) -> DataFrame:
        return self._listed("shared", _SHARED, also).distinct()

    def add(self, records: DataFrame, batch: int | Column, accepted: bool = False, row_id: str = "lead_id") -> None:
        """Probe with the records of one batch, then append what is new.

        ``batch``: its number, or a column of numbers if several batches wait. These are added in one pass,
        which reads the history once, with the result of one after the other in the order of their numbers:
        a slip links the same two accounts whichever of them comes first, and whether a host is shared is
        judged after each batch, by what came up to it.

        ``records`` has ``row_id, username, instagram_url, website``; other columns are ignored, rows
        without an id dropped. ``accepted``: these records are the history, one of each shop; they are
        indexed and joined by equal keys, but not searched for slips among themselves.
        """
        waiting = isinstance(batch, Column)
        part = f"{'waiting' if waiting else batch}-{uuid.uuid4().hex[:12]}"
        size = Observation()
        fields = record_fields(records, row_id, (batch if waiting else F.lit(batch)).cast("string").alias("batch"))
        fields.observe(size, F.count("*").alias("n")).write.parquet(f"{self.path}/rows/{part}")
        fields, n = self.spark.read.schema(_ROWS).parquet(f"{self.path}/rows/{part}"), size.get["n"]
        with ThreadPoolExecutor(1) as aside:
            earlier, sites = self._sites(fields, part, n, aside)
            keys = account_nodes(fields, self.shared(part)).select("id", "kind", "text")
            keys = keys if earlier is None else keys.unionByName(earlier)
            # A record has four keys at most.
            nodes = keys.groupBy(_node().alias("node")).agg(F.min("id").alias("known"))
            met = self._probe("exact", _EXACT, keys.select(_node().alias("node")), "node", 4 * n)
            self._append(nodes.join(met.select("node"), "node", "left_anti"), "exact", part, "node")
            fresh = self._keyed("exact", _EXACT, also=part).where(F.col("part") == part)
            text = F.substring("node", 3, 1 << 30)
            accounts = fresh.where(F.col("node").startswith("a:")).select(F.col("known").alias("id"), text.alias("text"))
            accounts = accounts.where(F.length(F.regexp_replace("text", "\\p{N}", "")) >= LEAST_LETTERS)
            self._append(accounts.mapInArrow(_bands, _BAND), "bands", part, "key")
            if not accepted:
                self._slips(part, 3 * n * BANDS).write.parquet(f"{self.path}/links/{part}")
            sites.result()
        touch(self.spark, f"{self.path}/done/{part}")
        self.parts.append(part)

    def _sites(self, fields: DataFrame, part: str, n: int, aside: ThreadPoolExecutor):
        """Learn which hosts are shared, from this batch and what came before.

        Gives the keys of earlier records that named a path of a host now found to be shared (as the
        host did not look shared then, their paths were not taken for accounts), and the job that
        appends the sites of this batch.
        """
        new = sites_of(fields, "batch").join(self.shared(), "host", "left_anti").withColumn("batch", F.col("batch").cast("long"))
        before = self._probe("sites", _SITES, fields.where("path <> ''").select("host"), "host", n)
        count = Observation()
        # What is in the index came before all of these batches, whatever their numbers.
        both = before.withColumn("batch", F.lit(-(1 << 63)).cast("long")).unionByName(new)
        shared_at_a_batch(both).observe(count, F.count("*").alias("n")).write.parquet(f"{self.path}/shared/{part}")
        job = aside.submit(lambda: self._append(new.drop("batch"), "sites", part, "host"))
        if not count.get["n"]:
            return None, job
        found = self._listed("shared", _SHARED, part)
        return before.join(found, "host", "left_semi").select("id", F.lit("a").alias("kind"), compact(F.col("path")).alias("text")).where("text <> ''"), job

    def _slips(self, part: str, n: int) -> DataFrame:
        """Links of a batch's new accounts to those one slip away, of history or of the batch."""
        own = self._keyed("bands", _BANDS, also=part).where(F.col("part") == part).drop("part")
        # Too many keys to be sent: the join itself leaves out what no key meets.
        met = self._probe("bands", _BANDS, own.select("key"), "key", n, part) if n <= SENT_KEYS or self.buckets >= PRUNED_FROM else self._keyed("bands", _BANDS, also=part).drop("part")
        met = met.select("key", F.col("id").alias("other_id"), F.col("text").alias("other"), F.col("sketch").alias("other_sketch"))
        pairs = met.join(own, "key").where(
            (F.col("text") != F.col("other")) & (F.col("id") != F.col("other_id")) & (F.abs(F.length("text") - F.length("other")) <= 1)
            & ((F.length("text") <= SHORT) | (F.length("other") <= SHORT) | (F.bit_count(F.col("sketch").bitwiseXOR(F.col("other_sketch"))) <= SKETCH_BITS))
            # A cheap bound inside the JVM; a swap of neighbours is two edits there.
            & (F.levenshtein("text", "other", 2) >= 0))
        found = pairs.select("text", "other", "id", "other_id").distinct().mapInArrow(_verify, "text string, other string, id long, other_id long")
        return found.select(F.col("id").alias("a"), F.col("other_id").alias("b"))

    def compact(self) -> None:
        """Rewrite the small files of many parts as those of one; the old files stay until they are deleted."""
        part = f"compact-{uuid.uuid4().hex[:12]}"
        for name, schema, key in (("exact", _EXACT, "node"), ("bands", _BANDS, "key"), ("sites", _SITES, "host")):
            self._append(stored(self._keyed(name, schema).drop("part"), f"compact-{name}"), name, part, key)
        for name, schema in (("rows", _ROWS), ("links", _LINK), ("shared", _SHARED)):
            self._listed(name, schema).write.parquet(f"{self.path}/{name}/{part}")
        before = self.parts
        touch(self.spark, f"{self.path}/done/{part}")
        for old in before:
            discard(self.spark, f"{self.path}/done/{old}")
        self.parts = [part]

    def known(self) -> DataFrame:
        """``id, batch, known_id``: every record with the smallest id of its shop.

        What a host is, one shop's or shared by many, is known best now; the nodes are those of now.
        """
        keys = account_nodes(self._listed("rows", _ROWS), self.shared()).select("id", "batch", _node().alias("node"))
        homes = keys.groupBy("node").agg(F.min("id").alias("home"))
        placed = stored(keys.join(homes, "node").groupBy("id", "batch").agg(F.array_sort(F.collect_set("home")).alias("nodes")), "placed")
        placed = placed.withColumn("node", F.col("nodes")[0])
        joined = placed.where(F.size("nodes") > 1).select(F.explode("nodes").alias("a"), F.col("node").alias("b")).where("a <> b")
        # The ends of a link are records; each stands for the shop of its smallest node.
        ends = joined.unionByName(self._listed("links", _LINK)).unionByName(placed.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b")))
        labels = components(ends.distinct())
        return placed.join(labels.withColumnRenamed("id", "node"), "node", "left").select(
            "id", F.col("batch").cast("long").alias("batch"), F.least("id", F.coalesce("label", "node")).alias("known_id"))


def components(links: DataFrame) -> DataFrame:
    """``id, label``: the smallest id that each end of the links is connected to.

    Least-label propagation with pointer jumping; each round is written to the shared folder, and
    only the number of changed labels comes to the driver.
    """
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        jumped = stored(moved.join(far, "label", "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        discard_tables(labels)
        labels = jumped.select("id", "label")
        if jumped.where("label <> old").isEmpty():
            return labels


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """The batches that wait, in one pass: each, in their order, against lead and all earlier rows.

    Records without account and site belong to no shop and give no row; ids are unique.
    """
    columns = ["lead_id", "username", "instagram_url", "website"]
    batches = table(spark, root, "lead_batch").select(*columns, "batch_id")
    index = ShopIndex(spark, stored_path(spark, "shops"))
    index.add(table(spark, root, "lead").select(*columns), 0, accepted=True)
    # Numbers from 1 on in the order of batch_id, rows without one first; 0 is the history.
    index.add(batches, F.coalesce(F.col("batch_id").cast("long") + (1 << 31) + 2, F.lit(1)))
    return index.known().where("batch > 0 and known_id < id").select("known_id", F.col("id").alias("new_id"))


QUERIES = {"p5_found": p5_found}
