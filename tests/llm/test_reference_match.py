from hypothesis import given, settings
from hypothesis import strategies as st

from leadflow.llm import reference_match as m

NAMES = [("city", 1, "Taludasht"), ("city", 1, "تالودشت"), ("city", 2, "Talushahr"), ("city", 2, "تالوشهر"), ("cat", 1, "Leather bags"), ("cat", 2, "Home decor"), ("cat", 3, "لوازم ورزشی"), ("cat", 4, "لوازم تحریر"), ("cat", 5, "فرش"), ("cat", 6, "Shoes and boots"), ("cat", 7, "لوازم الکترونیکی")]


def matched(spark, values, names=NAMES):
    df = spark.createDataFrame([(*v, "clash") for v in values], "field string, value string, ref_id string")
    rows = m.match_values(df, spark.createDataFrame(names, "field string, ref_id long, name string")).collect()
    assert len(rows) == len({(r.field, r.value) for r in rows})
    return {(r.field, r.value): r.ref_id for r in rows}


def test_values(spark):
    want = {
        ("city", " Taludasht."): 1, ("city", "Talu-Dasht"): 1, ("city", "تالو دشت"): 1, ("city", "Tlaudasht, Iran"): 1, ("city", "شهر تالوششهر"): 2, ("city", "ТaluЅhahr"): 2, ("city", "Wexholm"): 0, ("city", "-"): 0,
        ("city", "تالو‌شهر"): 2, ("city", "𝗧𝗮𝗹𝘂𝗱𝗮𝘀𝗵𝘁"): 1,
        ("cat", "#HomeDecor"): 2, ("cat", "Lether bgas shop"): 1, ("cat", "فروش لوازم ورزشی"): 3, ("cat", "لوازم‌تحریر!"): 4, ("cat", "لوازم"): 0, ("cat", "فررش"): 5, ("cat", "Shoes & boots!"): 6, ("cat", "Plumbing"): 0, ("cat", ""): 0,
        ("cat", "فروشگاه لوازم الکترونیکی"): 7,
    }
    assert matched(spark, [*want, *want]) == want


def test_nulls_and_empty_tables(spark):
    assert matched(spark, [("city", None)]) == {}
    assert matched(spark, []) == {}
    assert matched(spark, [("city", "Taludasht")], []) == {("city", "Taludasht"): 0}


def test_ties_go_to_the_smaller_id(spark):
    assert matched(spark, [("x", "abcdefx")], [("x", 9, "abcdefy"), ("x", 4, "abcdefz")]) == {("x", "abcdefx"): 4}


def test_long_values(spark):
    value = "word " * 3000 + "Taludasht"
    assert matched(spark, [("city", value), ("city", "y" * 50_000)]) == {("city", value): 1, ("city", "y" * 50_000): 0}


def distance(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(0, 3))
def test_edit_distance(a, b, most):
    assert m.edit_distance(a, b, most) == min(distance(a, b), most + 1)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", min_size=3, max_size=9), st.text("abcd", min_size=3, max_size=9))
def test_neighbourhoods_meet_within_the_allowed_edits(a, b):
    if distance(a, b) <= min(m.edits_allowed(a), m.edits_allowed(b)):
        assert m.neighbours(a) & m.neighbours(b)


def test_tokens_and_runs_of_any_length(spark):
    long = "".join("abcdefghijklmnopqrstuvwxyz"[(7 * i * i + 3 * i) % 26] for i in range(60))
    names = [*NAMES, ("city", 8, long)]
    slip = long[:30] + "q" + long[31:]
    want = {("city", "T a l u d a s h t"): 1, ("city", "Ta lu da sh t, Iran"): 1, ("city", slip): 8, ("city", " ".join(slip)): 8}
    assert matched(spark, list(want), names) == want
