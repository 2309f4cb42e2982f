import numpy as np
import pytest
from pyspark.sql import functions as F

from leadflow.llm import languages as g


def test_meanings():
    for label, code in (("fa", "fa"), ("FA", "fa"), ("fa-IR", "fa"), ("en_US", "en"), ("Farsi", "fa"), (" German ", "de"), ("per", "fa"), ("mul", None), ("", None), (None, None), ("?", None), ("zxx", None)):
        assert g.meant_language(label) == code


def test_meanings_in_a_column(spark):
    labels = ["fa-IR", "Türkçe", "xx", "", None, "EN", "de-AT", "und"]
    df = spark.createDataFrame([(v,) for v in labels], "v string")
    assert [r.m for r in df.select(g._meant(F.col("v")).alias("m")).collect()] == [g.meant_language(v) for v in labels]


def test_gradients_equal_differences():
    net = g.ByteNetwork(hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    steps, mask, held = g._as_steps(["hello there", "سلام"])
    assert held.sum((0, 2)).tolist() == [11, 8] and mask.sum(0).tolist() == [3, 2]
    mask, held = mask.astype(float), held.astype(float)
    target, weight = np.array([1, 0]), np.ones((1, 2))
    grads, _ = net.gradients(steps, mask, held, target, weight)
    rng = np.random.default_rng(0)
    for name, grad in grads.items():
        places = [np.unravel_index(np.abs(grad).argmax(), grad.shape)] + [tuple(rng.integers(0, n) for n in grad.shape) for _ in range(3)]
        for at in places:
            was, step = net.p[name][at], 1e-4
            net.p[name][at] = was + step
            up = net.gradients(steps, mask, held, target, weight)[1]
            net.p[name][at] = was - step
            down = net.gradients(steps, mask, held, target, weight)[1]
            net.p[name][at] = was
            # The loss adds 1e-9 inside its logarithm.
            assert abs(grad[at] - (up - down) / (2 * step)) < 1e-5 + 1e-3 * abs(grad[at])


SENTENCES = {
    "en": ["the shop sends every order by post", "please read the table before you choose", "our staff answer questions from ten until seven", "this page belongs to a small family workshop"],
    "de": ["der laden schickt jede bestellung mit der post", "bitte lesen sie die tabelle vor der auswahl", "unsere mitarbeiter beantworten fragen bis sieben uhr", "diese seite gehört einer kleinen werkstatt"],
    "fa": ["این صفحه متعلق به یک کارگاه خانوادگی است", "لطفاً پیش از خرید جدول اندازه را بخوانید", "همکاران ما پاسخگوی پرسش‌های شما هستند", "ارسال به همه شهرها با پست انجام می‌شود"],
    "ru": ["магазин отправляет каждый заказ почтой", "пожалуйста прочитайте таблицу перед выбором", "наши сотрудники отвечают на вопросы до семи", "эта страница принадлежит семейной мастерской"],
}


@pytest.fixture(scope="module")
def net():
    return g.train([(f"{s} {i}. {row[(j + 1) % 4]}.", code) for code, row in SENTENCES.items() for j, s in enumerate(row) for i in "abcdefgh"])


def codes(net, text):
    return [code for _, code, _ in g.segments(net, [text])[0]]


def test_whole_and_mixed_texts(net):
    for code, row in SENTENCES.items():
        assert codes(net, ". ".join(row) + ".") == [code]
    mixed = f"{SENTENCES['en'][0]}. {SENTENCES['en'][1]}.\n{SENTENCES['fa'][0]}. {SENTENCES['ru'][0]}."
    assert codes(net, mixed) == ["en", "fa", "ru"]


def test_persian_typed_with_arabic_letters_and_capitals(net):
    for row in (SENTENCES["fa"], SENTENCES["en"], SENTENCES["ru"]):
        text = ". ".join(row) + "."
        other = text.replace("ی", "ي").replace("ک", "ك").upper()
        assert g.segments(net, [other])[0] == g.segments(net, [text])[0]


def test_every_byte_has_a_label(net):
    steps, mask, held = g._as_steps(["این صفحه", "abc"])
    probs, _ = net.forward(steps, mask)
    assert probs.shape == (*held.shape, len(g.LANGUAGES)) and np.allclose(probs.sum(3), 1, atol=1e-5)


def test_a_kept_network_is_not_trained_again(spark, monkeypatch):
    sample = [(f"{s}.", code) for code, row in SENTENCES.items() for s in row]
    monkeypatch.setattr(g, "UPDATES", (3, 3))
    first = g.kept_network(spark, sample)
    monkeypatch.setattr(g, "train", None)
    again = g.kept_network(spark, sample[::-1])
    assert all((first[k] == again[k]).all() for k in first)


def test_no_words_no_language(net):
    for text in ("", " ", "⭐⭐⭐", "0900 123", "???", "@foo.bar https://x.example", "<|endoftext|>"):
        assert codes(net, text) == []


def test_tags_and_addresses_make_no_segment(net):
    assert codes(net, f"{SENTENCES['fa'][0]}.\n#mokame #dozashele\n@shop.name https://a.example/b <|endoftext|>") == ["fa"]


def test_table(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(-1, None, "fa"), (-2, "", None), (-3, " \n ", "en"), (-4, "متن " * 20_000, None)], docs.schema)
    rows = g.label_languages(docs.unionByName(extra).withColumn("label", F.lit("clash")), "doc_id", "text", "lang", 40).collect()
    assert not [r for r in rows if r.id in (-1, -2, -3)]
    assert [(r.seg_no, r.lang) for r in rows if r.id == -4] == [(0, "fa")]
    assert all(0 < r.confidence <= 1 for r in rows)
    assert g.label_languages(docs.limit(0), "doc_id", "text", "lang").count() == 0
    assert g.label_languages(docs.withColumn("lang", F.lit("xx")), "doc_id", "text", "lang").count() == 0
