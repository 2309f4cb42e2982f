import pytest
from pyspark.sql import functions as F

from leadflow.functions import extract as ex
from leadflow.functions import text as tx


def values(spark, inputs, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_handles(spark):
    cases = {
        "@Foo.Bar": "foo.bar", "https://www.instagram.com/Foo_1/?hl=fa": "foo_1", "instagram.com/foo/p/1": "foo", "  @@x/ ": "x", "foo?x": "foo",
        "p": None, "https://www.instagram.com/reel/abc": None, "": None, None: None, "سلام": None, "https://example.com/foo": "https", "foo.": "foo.",
    }
    assert values(spark, list(cases), tx.norm_handle) == list(cases.values())


def test_hosts(spark):
    cases = {
        "https://www.Shop.ir/a?b": "shop.ir", "shop.ir": "shop.ir", "http://u:p@a.b:8080/x": "a.b", "m.shop.ir": "m.shop.ir", "httpbin.org": None, "": None, None: None,
        "https://": None, " https://x.y": None, "HTTPS://x.y": "https", "a b": None, "https://www.www.x": "www.x",
    }
    assert values(spark, list(cases), tx.host_of) == list(cases.values())
    assert values(spark, ["", "https://a.b"], tx.source_id) == ["unknown", "a.b"]


def test_canonical_url_keeps_a_fragment(spark):
    assert values(spark, ["HTTP://A.b/c//?x=1", "http://a.b/#top", "?x", None], tx.canonical_url) == ["http://a.b/c", "http://a.b/#top", "", None]


def test_business_key(spark):
    assert values(spark, ["  Foo-Bar! 1 ", "گل‌بوته", "---", "", None], tx.business_key) == ["foo bar 1", "گل بوته", None, None, None]


def test_word_lists_match_inside_words(spark):
    assert values(spark, ["Turkish", "necessarily", "nothing", "ادبی"], tx.mentions_city) == [True, True, False, False]
    assert values(spark, ["comparison", "ادبی", "x"], tx.mentions_abroad) == [True, True, False]


def test_phone_and_currency(spark):
    assert values(spark, ["0912 345-6789", "021 8877 6655", "+98", "۰۹۱۲۳۴۵۶۷۸۹", "12345"], tx.has_phone) == [True, True, True, False, False]
    assert values(spark, ["shirt", "irté", "irtx", "IRT", "ottoman", "material", "تومان"], tx.has_currency) == [True, True, False, True, True, True, True]


def test_redacted(spark):
    assert values(spark, ["key sk-abc1!", "x" * 400], tx.redacted) == ["key [redacted]!", "x" * 300]


def test_mentions_of_a_missing_word_are_false(spark):
    df = spark.createDataFrame([("In Tehran", "tehran"), ("x", ""), ("x", None), (None, "a")], "t string, w string")
    assert [r.m for r in df.select(tx.mentions("t", "w").alias("m")).collect()] == [True, False, False, False]


@pytest.mark.parametrize("url,ok", [("http://10.0.0.1/x", False), ("https://localhost", False), ("https://a.local", False), ("ftp://a.b", False), ("https://a.b", True), ("http://172.20.1.1", False), ("http://172.40.1.1", True)])
def test_fetchable(spark, url, ok):
    assert values(spark, [url], tx.is_fetchable) == [ok]


def extracted(spark, title, url, snippet):
    from leadflow.operators.candidates import extracted as run

    df = spark.createDataFrame([(title, url, snippet)], "title string, url string, snippet string")
    return run(df).withColumn("name", ex.name_in_title()).first()


def test_extraction(spark):
    r = extracted(spark, "Foo – bar | baz", "https://www.instagram.com/Foo.1/?x", "see https://a.ir, https://www.youtube.com/x t.me/shop_1 واتساپ (@other_2)")
    assert r["handles"] == ["foo.1", "other_2"]
    assert r["websites"] == ["https://a.ir"]
    assert (r["telegram"], r["whatsapp"], r["name"]) == ("t.me/shop_1", "whatsapp", "Foo")
    assert r["keys"] == ["foo.1", "other_2"]


def test_extraction_of_nothing(spark):
    r = extracted(spark, None, None, None)
    assert (r["handles"], r["websites"], r["telegram"], r["whatsapp"], r["name"], r["keys"]) == ([], [], None, None, None, ["url:"])


def test_blocked_paths_and_sites(spark):
    r = extracted(spark, "T", "https://www.instagram.com/p/1", "https://smart.media/x https://b.ir/y).")
    assert r["handles"] == [] and r["websites"] == ["https://www.instagram.com/p/1", "https://b.ir/y"][1:]
    assert r["keys"] == ["web:b.ir"]
