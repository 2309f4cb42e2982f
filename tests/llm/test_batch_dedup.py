import random

from leadflow.llm import batch_dedup as b
from leadflow.plans.durable import stored_path
from pyspark.sql import functions as F

KIND = "lead_id long, username string, instagram_url string, website string, batch_id int, known_id string"


def run(spark, history, batches):
    rows = lambda rs: spark.createDataFrame([(*r, "clash") for r in rs], KIND)
    lead, new = rows(history), rows(batches)
    index = b.ShopIndex(spark, stored_path(spark, "test-shops"), 4)
    index.add(lead, 0, accepted=True)
    for number in sorted({r[4] for r in batches}):
        index.add(new.where(f"batch_id = {number}"), number + 1)
    return {r.id: r.known_id for r in index.known().where("batch > 0 and known_id < id").collect()}


SHARED = [(90 + i, None, None, f"https://links.example/account{i}x", 0) for i in range(4)]


def test_batches_against_history(spark):
    history = [(1, "foo.barbaz", None, None, 0), (2, None, "https://www.instagram.example/second_shop", "https://second.example", 0), (3, None, None, "https://links.example/thirdshop/p", 0), *SHARED]
    batches = [
        (101, "@FOO_BARBAZ", None, None, 1), (102, "foobabraz", None, None, 1), (103, "foobarbaz2", None, None, 1), (104, None, None, "http://WWW.second.example/contact?x=1", 1),
        (105, "thirdshop", None, None, 1), (106, "brandnewshop", None, None, 1), (107, None, None, None, 1), (108, "", "", " ", 1),
        (109, "brandnewshp", None, "https://brandnew.example", 2), (110, None, None, "brandnew.example/about", 3), (111, None, None, "https://links.example/otheraccount", 3),
    ]
    assert run(spark, history, batches) == {101: 1, 102: 1, 104: 2, 105: 3, 109: 106, 110: 106}


def test_an_index_is_closed_and_opened_again(spark):
    path = stored_path(spark, "test-kept")
    rows = lambda rs: spark.createDataFrame([(*r, "clash") for r in rs], KIND)
    b.ShopIndex(spark, path, 8).add(rows([(1, "foo.barbaz", None, None, 0), *SHARED]), 0, accepted=True)
    other = spark.newSession()
    b.ShopIndex(other, path).add(rows([(101, "foobabraz", None, None, 1), (102, None, None, "https://fresh.example", 1)]), 1)
    # A run that broke off: its rows are there, but its part is not done.
    broken = b.ShopIndex(spark, path)
    broken._append(spark.createDataFrame([("h:fresh.example", 7)], "node string, known long"), "exact", "broken", "node")
    last = b.ShopIndex(spark, path)
    assert last.buckets == 8
    last.add(rows([(103, None, None, "fresh.example/about", 2)]), 2)
    want = {101: 1, 103: 102}
    assert {r.id: r.known_id for r in last.known().where("known_id < id").collect()} == want
    last.compact()
    again = b.ShopIndex(spark, path)
    again.add(rows([(104, "foo-barbaz", None, None, 3)]), 3)
    assert {r.id: r.known_id for r in again.known().where("known_id < id").collect()} == {**want, 104: 1}


def test_a_batch_reads_the_partitions_of_its_own_keys(spark):
    """The rows that a small batch reads do not grow with the history, as long as there are partitions enough."""
    read = {}
    for size in (2_000, 8_000):
        path = stored_path(spark, "test-probe")
        index = b.ShopIndex(spark, path, size // 10)
        history = spark.range(size).select(F.col("id").alias("lead_id"), F.concat(F.lit("shop"), F.translate(F.conv("id", 10, 26), "0123456789", "qrstuvwxyz"), F.lit("x")).alias("username"), F.lit(None).cast("string").alias("instagram_url"), F.lit(None).cast("string").alias("website"))
        index.add(history, 0, accepted=True)
        keys = spark.createDataFrame([(f"a:shop{k}",) for k in range(5)], "node string")
        buckets = [r[0] for r in keys.select(index._bucket("node")).distinct().collect()]
        kept = index._keyed("exact", b._EXACT, buckets)
        assert len(kept.inputFiles()) == len(buckets)
        read[size] = kept.count()
    assert read[8_000] < 2 * read[2_000] and read[8_000] < 400


def test_a_host_that_turns_out_to_be_shared(spark):
    batches = [
        (10, None, None, "https://many.example/firstshop", 1), (11, "secondshop", None, "https://many.example/secondshop", 2), (12, "thirdplace", None, "https://many.example/thirdplace", 3),
        (13, "firstshop", None, None, 4), (14, None, None, "many.example/secondshop?x=1", 5),
        # Two pages of one shop, as many as there are shops on the host above.
        (20, "ownerofsite", None, "https://single.example/home", 1), (21, None, None, "https://single.example/about", 2), (22, None, None, "https://single.example", 3),
    ]
    assert run(spark, [], batches) == {13: 10, 14: 11, 21: 20, 22: 20}


def test_waiting_batches_in_one_pass(spark):
    """One pass over all that waits gives what one batch after the other gives, also where a host looks shared only for a while."""
    history = [(1, "foo.barbaz", None, None, 0), (2, None, None, "https://late.example/firstshop", 0), (3, "bidak", None, None, 0)]
    batches = [
        *[(100 + i, None, None, f"https://passing.example/page{c}", 1 + i % 2) for i, c in enumerate("abcd")], *[(110 + i, None, None, f"https://passing.example/page{'abcd'[i % 4]}", 3) for i in range(12)],
        (130, "pagea", None, None, 4), (131, "secondshop", None, "https://late.example/secondshop", 2), (132, "firstshop", None, None, 2), (133, "thirdplace", None, "https://late.example/thirdplace", 5), (134, None, None, "late.example/secondshpo", 5),
        (140, "foobabraz", None, None, 2), (141, "foobabra", None, None, 1), (142, "bidka", None, None, 5), (143, "newaccount", None, None, 1), (144, "newacount", None, "https://newaccount.example", 5), (145, None, None, "https://newaccount.example/x", 2),
        (150, "beforeall", None, None, -1), (151, "beforeal", None, None, 1),
    ]
    lead, new = (spark.createDataFrame([(*r, "clash") for r in rows], KIND) for rows in (history, batches))
    index = b.ShopIndex(spark, stored_path(spark, "test-waiting"), 4)
    index.add(lead, 0, accepted=True)
    index.add(new, F.col("batch_id") + 2)
    assert len(index.parts) == 2
    found = {r.id: (r.known_id, r.batch) for r in index.known().where("batch > 0 and known_id < id").collect()}
    assert {k: v for k, (v, _) in found.items()} == run(spark, history, [(*r[:4], r[4] + 1) for r in batches])
    assert found[130] == (100, 6) and found[132][0] == 2 and found[140][0] == 1 and found[142][0] == 3 and found[145][0] == 143 and found[151][0] == 150


def test_slips_of_short_accounts(spark):
    history = [(1, "bidak", None, None, 0), (2, "zofezilerita", None, None, 0), (3, "abc", None, None, 0)]
    assert run(spark, history, [(11, "bidka", None, None, 1), (12, "zofezilexrita", None, None, 1), (13, "bida", None, None, 2), (14, "abd", None, None, 2), (15, "bidak1", None, None, 2)]) == {11: 1, 12: 2, 13: 1}


def test_later_records_join_earlier_ones(spark):
    batches = [(10, "alphashop", None, None, 1), (11, None, None, "https://alpha.example", 2), (12, "alphashop", None, "https://alpha.example", 3), (13, None, None, "https://alpha.example/x", 4)]
    assert run(spark, [], batches) == {11: 10, 12: 10, 13: 10}


def test_a_hot_account(spark):
    batches = [(100 + i, "hotaccount" if i % 2 else "hot_account", None, None, i % 3) for i in range(200)]
    found = run(spark, [], batches)
    assert found == {100 + i: 100 for i in range(1, 200)}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (60, 100), (7, 7)]
    got = {r.id: r.label for r in b.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50, 60: 50}
    assert b.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_slips():
    assert b.same_but_for_slip("fooshop", "fooshp") and b.same_but_for_slip("fooshop", "foohsop") and b.same_but_for_slip("foo1shop", "fo1oshop")
    assert not b.same_but_for_slip("fooshop1", "fooshop2") and not b.same_but_for_slip("fooshop", "fooshop2") and not b.same_but_for_slip("fooshop", "fobshpo")


def test_recall_of_the_bands():
    rng = random.Random(4)
    syllables = [c + v for c in "bcdfgjklmnprstz" for v in "aeio"]
    accounts = ["".join(rng.choice(syllables) for _ in range(7)) for _ in range(600)]

    def slip(text):
        i, kind = rng.randrange(1, len(text) - 2), rng.randrange(4)
        return (text[:i] + text[i + 1] + text[i] + text[i + 2 :], text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1 :])[kind]

    slipped = [slip(a) for a in accounts]
    size = max(64, b.BANDS * b.ROWS)
    left, right = b.signatures(accounts, size), b.signatures(slipped, size)
    met = [any((left[i, k : k + b.ROWS] == right[i, k : k + b.ROWS]).all() for k in range(0, b.BANDS * b.ROWS, b.ROWS)) for i in range(len(accounts))]
    assert sum(met) / len(met) >= 0.99


def test_recall_from_end_to_end(spark):
    rng = random.Random(9)
    syllables = [c + v for c in "bcdfgjklmnprstz" for v in "aeio"]
    accounts = list({"".join(rng.choice(syllables) for _ in range(rng.choice((3, 5, 6, 7, 8)))): None for _ in range(500)})

    def slip(text):
        i, kind = rng.randrange(1, len(text) - 2), rng.randrange(4)
        return (text[:i] + text[i + 1] + text[i] + text[i + 2 :], text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1 :])[kind]

    slipped = [slip(a) for a in accounts]
    found = run(spark, [(i, a, None, None, 0) for i, a in enumerate(accounts)], [(1000 + i, a, None, None, 1) for i, a in enumerate(slipped)])
    asked = [i for i, (a, s) in enumerate(zip(accounts, slipped, strict=True)) if a != s and s not in accounts]
    assert sum(1000 + i in found for i in asked) >= 0.99 * len(asked)


def test_long_accounts_and_repeated_rows(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    assert run(spark, [(1, long, None, None, 0)], [(5, long + "y", None, None, 1), (6, long, None, None, 1), (6, long, None, None, 1)]) == {5: 1, 6: 1}
