import pytest
from leadflow.llm import lookalikes as k


def canonical(spark, values, persian=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)], "i int, v string, canonical string")
    found = {r.i: r.canonical for r in k.canonical_values(df, ["i"], "v", F.lit(persian)).collect()}
    return [found.get(i, v) for i, v in enumerate(values)]


CLEAN = [
    "قیمت هر کرم مرطوب‌کننده حدود ۵۸ هزار تومان است و موجودی انبار محدود می‌باشد.", "In this review an address was found, but no recent date.",
    "Адрес магазина указан на странице, но дата не ясна.", "يقدم متجر جديد في المدينة مجموعة من العطور ابتداء من السبت إلى الخميس.", "Yürüyüş ayakkabısı için ğüşıöç", "👩‍🎨 ❤️ 🛍️", "", None, "گزینه free shipping برای روسری فعال نیست",
]


def test_clean_values_stay(spark):
    assert canonical(spark, CLEAN) == CLEAN


@pytest.mark.parametrize("odd,plain", [
    ("In this review an address was founｄ.", "In this review an address was found."),
    ("In thiѕ rеview аn address", "In this review an address"),
    ("قيمت هر كرم مرطوب‌كننده حدود ٥٨ هزار تومان است", "قیمت هر کرم مرطوب‌کننده حدود ۵۸ هزار تومان است"),
    ("موجودی‌‌ها است و‌ می‌باشد", "موجودی‌ها است و می‌باشد"),
    ("تیرواکنﺪ", "تیرواکند"), ("⁦Hello﻿", "Hello"), ("ｎｕｍｂｅｒ １２", "number 12"), ("𝗧𝗶𝗿𝘃𝗮", "Tirva"),
    ("Yürüyüş", "Yürüyüş"), ("آدرس", "آدرس"), ("👗‍ x", "👗 x"), ("Mагазин открыт", "Магазин открыт"),
])
def test_disguises_are_undone(spark, odd, plain):
    assert canonical(spark, [odd, *CLEAN])[0] == plain


def test_the_vocabulary_decides_on_whole_words(spark):
    # All letters of these words have twins; only a known word is a case.
    values = ["соре", "the cope was here", "we соре with it"]
    assert canonical(spark, values)[2] == "we соре with it" or canonical(spark, values)[2] == "we cope with it"
    assert canonical(spark, ["we cope with it", "they соре as well"])[1] == "they cope as well"
    assert canonical(spark, ["nothing here", "they соре as well"])[1] == "they соре as well"


def test_persian_names_are_not_taken_for_arabic(spark):
    assert canonical(spark, ["لوازم الکترونیکی", "الکتروني"], True) == ["لوازم الکترونیکی", "الکترونی"]


def test_repeated_and_long_values(spark):
    long = "است و " * 30_000 + "كار"
    assert canonical(spark, [long, long]) == [long[:-3] + "کار"] * 2
    assert canonical(spark, []) == []


def test_no_character_that_the_tables_change_escapes():
    import unicodedata

    import pyarrow as pa
    import pyarrow.compute as pc

    every = [chr(p) for p in range(0x80, 0x110000) if not 0xD800 <= p < 0xE000]
    changed = [c for c in every if c in k._LATIN_OF or c in k.TO_PERSIAN or c in k.IGNORABLE or c in k.BLANKS or unicodedata.category(c)[0] in "LMN" and k._plain(c) != c]
    # Besides, what the operator itself does to each character alone and within a word.
    letters = [c for c in every if unicodedata.category(c)[0] in "LMN" and c != k.EMOJI_STYLE and unicodedata.name(c, "")[:6] not in ("CJK UN", "HANGUL")]
    changed += [v for v in (around.format(c) for around in ("{}", "wo{}rd") for c in letters) if k.by_table(v, "la")[0] != v]
    changed += ["!\u200d!", "(\u200d)", "ա ո", "x²", "H₂O", "ᴬbc"]
    missed = [v for v, hit in zip(changed, pc.match_substring_regex(pa.array(changed), k.SUSPECT).to_pylist(), strict=True) if not hit]
    assert len(changed) > 5000 and missed == []
    usual = pa.array([v for v in CLEAN[4:6] if v])
    assert not any(pc.match_substring_regex(usual, k.SUSPECT).to_pylist())


def test_odd_characters_alone_in_a_value(spark):
    assert canonical(spark, ["a !\u200d! b", "10 m²"]) == ["a !! b", "10 m2"]
    assert canonical(spark, ["oոline shop"]) == ["online shop"]


def test_trie_search():
    trie = k.LookalikeTrie("la")
    for word, n in (("cope", 5), ("cape", 2), ("copied", 1), ("capital", 3)):
        trie.add(word, n)
    assert trie.search("с\u200bоре") == (0, 5, "cope")
    assert trie.search("cqpe") is None
    # An edit costs one and stays as it is; what looks alike around it is read by the spelling.
    assert trie.search("сqре", 1) == (1, 5, "cqpe")
    assert trie.search("соppе", 1) == (1, 5, "coppe") and trie.search("соp", 1) == (1, 5, "cop")
    assert trie.search("сарitаll") == (1, 3, "capitall") and trie.search("сарitаlls") is None
    persian = k.LookalikeTrie("fa")
    persian.add("قیمت", 1)
    assert persian.search("قيمت") == (0, 1, "قیمت")


def test_slices_hold_every_spelling_within_the_budget(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    words = list({"".join(rng.choice("abcde") for _ in range(rng.randrange(2, 12))): None for _ in range(300)})
    held = {r.w: set(r.s) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", k.spelling_slices(F.col("w")).alias("s")).collect()}
    for word in words:
        at, c = rng.randrange(len(word)), rng.choice("abcde")
        for token in (word, word[:at] + c + word[at:], word[:at] + c + word[at + 1 :], word[:at] + word[at + 1 :], word + c):
            trie = k.LookalikeTrie("la")
            trie.add(word, 1)
            if trie.search(token):
                assert held[word] & set(k.slices_of(token)), (word, token)


def test_without_the_tries_cases_are_lost(spark, monkeypatch):
    # Wholly of twins: the table cannot tell; with one edit only the weighted automaton can.
    odd = ["they ѕсоор as well", "this is our сорах", "this is our сарасеѕ", "this is our сараасеѕ"]
    clean = ["they scoop as well", "copax capaces scoop"]
    got = canonical(spark, [*clean, *odd])[len(clean) :]
    assert got[1:] == ["this is our copax", "this is our capaces", "this is our capaaces"]
    monkeypatch.setattr(k, "spelling_slices", lambda folded: k.F.array(k.F.lit("nothing")))
    bare = canonical(spark, [*clean, *odd])[len(clean) :]
    assert bare[1] == odd[1] and bare != got



def test_queries_agree_on_the_test_tables(spark, root):
    rows = k.p2_canonical(spark, root).collect()
    assert rows and all(r.canonical != r.value for r in rows)
    again = spark.createDataFrame([(i, r.canonical) for i, r in enumerate(rows)], "i int, v string")
    assert k.canonical_values(again, ["i"], "v").count() <= len(rows) * 0.01
