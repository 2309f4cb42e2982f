import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadflow.functions import lexicon as lx
from leadflow.operators import candidates, evidence, keys, limiter, ordering, querygen, replies, shapes

RESULT = "request_id long, result_idx long, title string, url string, snippet string"


def greedy(rows):
    """The sequential rule, by itself: group by key, then fold into the first cluster that matches."""
    by_key = {}
    for idx, name, ks, site, listed in rows:
        for pos, key in enumerate(ks):
            c = by_key.setdefault(key, {"at": (idx, pos), "u": None if key[:4] in ("web:", "url:") else key, "w": site, "name": name, "n": 0})
            c["n"] += 1
            if not c["w"] and listed:
                c["w"] = listed
    host = lambda w: None if not w else w.split("//")[-1].split("/")[0]
    merged = []
    for c in sorted(by_key.values(), key=lambda c: c["at"]):
        match = next((m for m in merged if (m["u"] and m["u"] == c["u"]) or (host(m["w"]) and host(m["w"]) == host(c["w"]) and host(c["w"]) != "instagram.com")), None)
        if match is None:
            merged.append(dict(c))
        else:
            match["n"] += c["n"]
            match["u"], match["w"] = match["u"] or c["u"], match["w"] or c["w"]
    return sorted((m["at"], m["u"], m["w"], m["name"], m["n"]) for m in merged)


def test_merging_equals_the_sequential_rule(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        u = rng.choice([f"https://www.instagram.com/h{rng.randrange(40)}", f"https://s{rng.randrange(25)}.ir/{i}"])
        snippet = rng.choice(["", f"https://s{rng.randrange(25)}.ir/x", f"https://s{rng.randrange(25)}.ir", f"(@h{rng.randrange(40)})"])
        rows.append((1, i, f"N{i}", u, snippet))
    df = spark.createDataFrame(rows, RESULT)
    plain = []
    from leadflow.functions import extract as ex

    for r in candidates.extracted(df).withColumn("site", ex.site_of()).orderBy("result_idx").collect():
        plain.append((r.result_idx, r.title, r["keys"], r.site, r.websites[0] if r.websites else None))
    got = sorted(((r.first_idx, r.key_pos), r.username, r.website, r.business_name, r.results) for r in candidates.resolved(df).collect())
    assert got == greedy(plain)


def test_members_cover_all_results(spark):
    df = spark.createDataFrame([(1, 1, "A", "https://a.ir/1", ""), (1, 2, "B", "https://a.ir/2", ""), (2, 3, None, None, None)], RESULT)
    found = candidates.cluster_members(df).collect()
    assert sorted((r.request_id, r.cluster, r.result_idx) for r in found) == [(1, "site:a.ir", 1), (1, "site:a.ir", 2), (2, "key:url:", 3)]


LEAD = "lead_id long, username string, instagram_url string, website string, business_name string, city string"


@pytest.fixture()
def shops(spark):
    a = spark.createDataFrame([(1, "@Foo", None, None, None, None), (2, None, None, "https://x.ir/a", None, None), (3, None, None, None, "Gol-Bote", " Tehran "), (4, "new", None, "https://instagram.com/x", "Gol bote", ""), (5, None, None, None, None, None)], LEAD)
    b = spark.createDataFrame([(10, None, "https://www.instagram.com/foo", None, None, None), (11, None, None, "x.ir", None, None), (12, None, None, "http://instagram.com/y", "gol bote", "tehran"), (13, "foo", None, None, None, None)], LEAD)
    return a, b


def test_anti_and_semi_joins(shops):
    a, b = shops
    assert sorted(r.lead_id for r in keys.not_in(a, b).collect()) == [4, 5]
    assert sorted(r.lead_id for r in keys.also_in(a, b).collect()) == [1, 2, 3]
    links = keys.same_shop_links(a.withColumnRenamed("lead_id", "new_id"), b, "new_id", "lead_id").collect()
    assert sorted((r.new_id, r.lead_id, r.shared) for r in links) == [(1, 10, "handle"), (2, 11, "host"), (3, 12, "name")]
    assert keys.not_in(a.limit(0), b).count() == 0 and keys.not_in(a, b.limit(0)).count() == 5


def test_no_nested_loop(shops):
    a, b = shops
    plan = keys.not_in(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b")], "i int, k string")
    assert sorted(r.i for r in keys.first_per_key(df, ["k"], ["i"]).collect()) == [1, 5]


def test_evidence(spark):
    kind = "id int, e array<struct<type:string,signal:string,source_url:string,source_id:string,strength:string>>, u array<string>"
    df = spark.createDataFrame([(1, [("t", "1", None, "a", "strong"), ("t", "2", None, "a", "weak"), ("t", "3", None, None, "strong"), ("s", "4", None, "b", "weak")], ["x"]), (2, None, None), (3, [], [])], kind)
    rows = df.select("id", evidence.independent_signals("e").alias("s"), evidence.source_count("e").alias("n"), evidence.evidence_quality("e", "e", "u").alias("q")).orderBy("id").collect()
    assert [[x.signal for x in r.s] for r in rows] == [["1", "3", "4"], [], []]
    assert [r.n for r in rows] == [2, 0, 0] and [r.q for r in rows] == [100, 0, 0]


def test_evidence_without_an_address_has_an_unknown_source(spark):
    df = spark.createDataFrame([("https://www.a.ir/x",), (None,)], "u string")
    items = [r.e for r in df.select(evidence.evidence_item("t", "s", F.col("u"), "strong").alias("e")).collect()]
    assert [(e.type, e.signal, e.source_id, e.strength) for e in items] == [("t", "s", "a.ir", "strong"), ("t", "s", "unknown", "strong")]


def test_positions_are_global(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    rows = ordering.positions(df, [F.col("v").desc()]).collect()
    assert all(r.position == 1000 - r.v for r in rows)
    assert ordering.positions(df.limit(0), [F.col("v")]).count() == 0


def test_first_n_takes_the_first_and_not_the_best(spark):
    df = spark.createDataFrame([(1, i, i * 10) for i in range(5)], "r int, i int, score int").withColumn("k", F.lit(2))
    assert sorted(r.score for r in ordering.first_n(df, ["r"], ["i"], "k").collect()) == [0, 10]


def test_score_and_bands(spark):
    names = [n for n, _ in lx.SCORE_WEIGHTS]
    kind = "s struct<" + ",".join(f"{n}:int" for n in names) + ">"
    df = spark.createDataFrame([((70, 80, 100, 40, 68, 70, 20, 75, 80),), ((-5, 200, 0, 0, 0, 0, 0, 0, None),)], kind)
    assert [r.x for r in df.select(ordering.weighted_score("s").alias("x")).collect()] == [69, 15]
    banded = spark.createDataFrame([(v,) for v in (90, 89, 75, 60, 40, 39)], "v int").select(ordering.banded(F.col("v")).alias("b"))
    assert [r.b for r in banded.collect()] == ["HOT", "HIGH", "HIGH", "MEDIUM", "LOW", "REJECT"]


REQUEST = "request_id long, category string, country string, city string, max_leads int"


def test_queries_of_a_request(spark):
    df = spark.createDataFrame([(1, "cosmetics", "ایران", "تهران", 10), (2, "toys", "Turkey", None, 5), (3, "toys", "Iran", "", 5), (4, "furniture", "Iran ", "قم", 5)], REQUEST)
    found = {}
    for r in querygen.search_queries(df).orderBy("request_id", "pos").collect():
        found.setdefault(r.request_id, []).append(r.query)
    assert len(found[1]) == 48 and found[1][0] == "cosmetics ایران" and found[1][1] == "cosmetics تهران"
    assert found[2] == ["toys Turkey", 'site:instagram.com "toys" Turkey', "toys online shop Turkey"]
    assert found[3][-1] == "سایت فروش toys ایران" and len(set(found[3])) == len(found[3])
    assert len(found[4]) == 48


def test_further_queries_leave_out_what_has_no_code(spark):
    df = spark.createDataFrame([(1, "x", "ایران", "تهران", 1, "foreign"), (2, "x", "ایران", None, 1, "foreign"), (3, "x", "ایران", None, 1, "nothing")], REQUEST + ", pattern string")
    found = querygen.further_queries(df).groupBy("request_id").count().collect()
    assert {r.request_id: r["count"] for r in found} == {1: 5, 2: 4}


def test_valid_requests(spark):
    df = spark.createDataFrame([(1, "ab", "ab", None, 1), (2, " a ", "ab", None, 1), (3, "ab", "ab", "c" * 41, 1), (4, "ab", "ab", "", 51), (5, "ab", "ab", "c", 50)], REQUEST)
    assert sorted(r.request_id for r in querygen.valid_requests(df).collect()) == [1, 5]


GOOD = '{"businessName":"N","businessType":null,"city":null,"reasons":["r"],"warnings":[],"shopBotFit":70,"credibility":5.5'


@pytest.mark.parametrize("raw,ok", [
    (GOOD + "}", True), (GOOD + ',"inventedClaims":[]}', True), (GOOD + ',"inventedClaims":["x"]}', False), (GOOD + ',"extra":1}', True), ("nope", False), ("", False), (None, False), ("[1]", False),
    (GOOD.replace('"city":null,', "") + "}", False), (GOOD.replace(":70", ':"70"') + "}", False), (GOOD.replace(":70", ":101") + "}", False), (GOOD.replace(":70", ":null") + "}", False),
    (GOOD.replace('["r"]', str([str(i) for i in range(13)]).replace("'", '"')) + "}", False), (GOOD.replace('["r"]', "[1]") + "}", False), (GOOD.replace('["r"]', "[null]") + "}", False),
])
def test_replies(spark, raw, ok):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert (df.select(replies.parsed_reply("raw").alias("r")).first().r is not None) is ok


def test_enrichment_keeps_unmatched_leads(spark):
    leads = spark.createDataFrame([(1, "A", "t", 50, ["x"], []), (2, "B", None, 80, [], [])], "lead_id long, business_name string, business_type string, shop_bot_fit int, reason array<string>, verification_warnings array<string>")
    raw = spark.createDataFrame([(1, GOOD + "}")], "lead_id long, raw string")
    rows = {r.lead_id: r for r in replies.enriched(leads, raw, "lead_id").collect()}
    assert (rows[1].business_name, rows[1].business_type, rows[1].shop_bot_fit, rows[1].reason) == ("N", "t", 70.0, ["x", "r"])
    assert (rows[2].business_name, rows[2].shop_bot_fit, rows[2].reason) == ("B", 80.0, [])


def limit_by_loop(events, most, window):
    state, out = {}, {}
    for i, key, ts in sorted(events, key=lambda e: (e[2], e[0])):
        current = state.get(key)
        if current is None or (ts - current[0]).total_seconds() > window:
            state[key], out[i] = [ts, 1], True
        elif current[1] < most:
            current[1] += 1
            out[i] = True
        else:
            out[i] = False
    return out


def make_events(seed):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(i, rng.choice([1, 1, 1, 2, 3]), start + dt.timedelta(seconds=rng.randrange(600))) for i in range(300)]


def test_rate_limit_equals_the_loop(spark):
    events = make_events(3)
    df = spark.createDataFrame(events, "id long, k long, ts timestamp")
    got = {r.id: r.allowed for r in limiter.limited(df, "k", "ts", "id", 4, 60_000_000).collect()}
    assert got == limit_by_loop(events, 4, 60)
    assert limiter.limited(df.limit(0), "k", "ts", "id").count() == 0


def test_shapes(spark):
    df = spark.createDataFrame([(1, (1, 2)), (2, None)], "id int, s struct<a:int,b:int>")
    assert sorted((r.id, r.name, r.value) for r in shapes.unpivoted(df, ["id"], "s").where("value is not null").collect()) == [(1, "a", 1), (1, "b", 2)]
    assert shapes.unpivoted(df, ["id"], "s").count() == 4
    counted = shapes.counted(df, [], present=F.col("s").isNotNull()).first()
    assert (counted.rows, counted.present) == (2, 1)


def _sequential(rows):
    kept, seen = [], set()
    for i, *parts in rows:
        own = {(n, p) for n, p in enumerate(parts) if p}
        if not own & seen:
            kept.append(i)
            seen |= own
    return kept


def test_first_of_each_shop_is_the_sequential_loop(spark):
    rng = random.Random(11)
    kind = "i long, username string, instagram_url string, website string, business_name string, city string"
    for size, names in ((12, 5), (60, 20), (60, 60)):
        rows = [(i, *(None if rng.random() < 0.4 else f"{k}{rng.randrange(names)}" for k in "abc")) for i in range(size)]
        df = spark.createDataFrame([(i, u, None, w and f"https://{w}.example", n, "X") for i, u, w, n in rows], kind)
        found = sorted(r.i for r in keys.first_of_each_shop(df.repartition(3), ["i"]).collect())
        assert found == _sequential(rows)


def test_a_row_left_out_leaves_nobody_out(spark):
    kind = "i long, username string, instagram_url string, website string, business_name string, city string"
    df = spark.createDataFrame([(1, None, None, "w1.example", None, None), (2, "h1", None, "w1.example", None, None), (3, "h1", None, None, None, None), (4, None, None, None, None, None), (5, None, None, None, None, None)], kind)
    assert sorted(r.i for r in keys.first_of_each_shop(df, ["i"]).collect()) == [1, 3, 4, 5]
    assert keys.first_of_each_shop(df.limit(0), ["i"]).count() == 0


def test_a_request_without_candidates_falls_short(spark):
    none = spark.createDataFrame([], "request_id long, cluster string, username string, website string")
    blobs = spark.createDataFrame([], "request_id long, cluster string, blob string")
    got = querygen.shortfalls(none, blobs, requests=spark.createDataFrame([(7,)], "request_id long")).collect()
    assert [(r.request_id, r.n, r.patterns) for r in got] == [(7, 0, ["duplicates"])]
