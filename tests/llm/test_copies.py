import random

import pytest
from leadflow.llm import copies
from pyspark.sql import functions as F
from oracle import assert_same, connection

KIND = "import_id long, username string, instagram_url string, website string, raw string, feed string, key string"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "feed", "clash") for r in rows], KIND)


def found(spark, rows):
    members, records = copies.scan_runs(copies.canonical_records(table_of(spark, rows), "import_id"))
    size = records.collect()
    # A record has one row; several records may share a repeated id.
    many = {}
    for r in size:
        many.setdefault(r.keep_id, []).append(r.copies)
    return {r.id: (r.keep_id, many[r.keep_id][0]) for r in members.collect()}


def test_notations_of_one_record(spark):
    rows = [
        (5, "@ Foo.Bar ,", "HTTPS://www.Instagram.example//foo.bar/", "https://x.example/a?b=2&a=1", None),
        (2, None, None, None, '{ "website" : "(http://WWW.X.example/a/?a=1&b=2)", "instagramUrl": "instagram.example/foo.bar", "username": "foo.bar"}'),
        (9, "", " ", None, "WEBSITE = x.example//a?a=1&b=2\nusername: <foo.bar>\ninstagramUrl=www.instagram.example/foo.bar"),
        (3, "foo.bar", None, None, None),
        (4, "foo_bar", None, None, None),
    ]
    assert found(spark, rows) == {2: (2, 3), 5: (2, 3), 9: (2, 3), 3: (3, 1), 4: (4, 1)}


def test_blank_records_and_missing_ids_are_none(spark):
    assert found(spark, [(1, None, "", " ", None), (2, "", None, None, ""), (3, None, None, None, "username=\nwebsite= "), (None, "a", None, None, None)]) == {}
    assert found(spark, []) == {}


def test_repeated_ids_and_long_values(spark):
    long = "a" * 100_000
    assert found(spark, [(1, long, None, None, None), (1, long, None, None, None), (2, long.upper(), None, None, None)]) == {1: (1, 3), 2: (1, 3)}


def test_closing_slashes_and_marks_of_handles(spark):
    rows = [(1, "foo.bar", None, None, None), (2, "@foo.bar/", None, None, None), (3, "'Foo.Bar//' ", None, None, None), (4, None, None, None, "username=foo.bar/,"), (5, "foo.bar/x", None, None, None)]
    assert found(spark, rows) == {1: (1, 4), 2: (1, 4), 3: (1, 4), 4: (1, 4), 5: (5, 1)}


def test_the_scan_holds_one_run_and_counts_across_batches():
    import pyarrow as pa

    class Part:
        def partitionId(self):  # noqa: N802
            return 3

    rng = random.Random(5)
    for _ in range(60):
        keys = sorted(rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 30)))
        cuts = sorted(rng.randrange(len(keys) + 1) for _ in range(3))
        pieces = [range(a, b) for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True)]
        batches = (pa.RecordBatch.from_pydict({"key": pa.array([keys[i] for i in piece], pa.string()), "id": pa.array(list(piece), pa.int64())}) for piece in pieces)
        before, copies.TaskContext = copies.TaskContext, type("T", (), {"get": staticmethod(lambda: Part())})
        try:
            out = [r for b in copies._scan(batches) for r in b.to_pylist()]
        finally:
            copies.TaskContext = before
        runs = {k: (keys.index(k), keys.count(k)) for k in keys}
        assert [(r["id"], r["keep"], r["part"]) for r in out if r["id"] is not None] == [(i, runs[k][0], 3 if k == keys[0] else None) for i, k in enumerate(keys)]
        ends = [(r["keep"], r["n"], r["edge"], r["part"]) for r in out if r["id"] is None]
        assert sorted(e[:2] for e in ends) == sorted(set(runs.values()))
        assert {e[2] for e in ends if e[2] is not None} == {keys[0], keys[-1]}
        assert [e[0] for e in ends if e[3] is not None] == [0]


def test_one_huge_run_in_constant_memory(spark):
    # 60 MB of equal keys, far more than what a batch holds, in one partition.
    rows = spark.range(60_000).select(F.col("id"), F.repeat(F.lit("k"), 1000).alias("key"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert copies.collapse_copies(rows).collect() == [(0, 60_000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_hot_record_over_all_partitions(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else f"u{rng.randrange(300)}", None, None, None) for i in range(3000)]
    want = {}
    for i, name, *_ in rows:
        want.setdefault(name, []).append(i)
    assert found(spark, rows) == {i: (min(ids), len(ids)) for ids in want.values() for i in ids}


@pytest.mark.parametrize("name", sorted(copies.SQL))
def test_sql(spark, root, name):
    assert_same(spark, connection(root), root, copies.QUERIES[name], copies.SQL[name])
