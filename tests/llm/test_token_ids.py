import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadflow.llm import token_ids as t

FILE = os.path.join(t.TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer files")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(FILE.replace(".tiktoken", ".json"))
    tool.encode_special_tokens = True
    return tool


PARTS = ["'s", "'", "re", "'ll", "'ve", " ", "  ", "\n", "\t", " ", " ", "a", "Z", "ش", "می‌", "١", "9", "½", "!", "🙂", "é", "é", "<|endoftext|>", "\r\n", "x" * 70]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=3)), max_size=40).map("".join))
def test_ids_equal_the_public_tokenizer(public, text):
    text = text.encode("utf-8", "ignore").decode()
    assert t.encode([text], FILE)[0] == public.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join))
def test_round_trip(text):
    assert t.restore(t.encode([text], FILE)[0], FILE) == text


def test_texts_do_not_touch(public):
    texts = ["a ", " b", "'", "s", "", "x\n", "\n"]
    assert t.encode(texts, FILE) == [public.encode(x, add_special_tokens=False).ids for x in texts]


def test_very_long_texts(public, monkeypatch):
    text = "'ll word " * 30_000
    assert t.encode([text], FILE)[0] == public.encode(text, add_special_tokens=False).ids
    one = "ab" * 3_000
    assert t.encode([one], FILE)[0] == public.encode(one, add_special_tokens=False).ids
    monkeypatch.setattr(t, "CHUNK", 10)
    assert t.encode(["hello world", "again and again"], FILE) == [public.encode(x, add_special_tokens=False).ids for x in ("hello world", "again and again")]


def test_table(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (2, "hi there", 7), (None, "hi there", 7)], "doc_id long, text string, ids int")
    rows = t.token_ids(df, "doc_id", "text", FILE).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in rows) == sorted([(1, []), (2, []), (2, t.encode(["hi there"], FILE)[0]), (0, t.encode(["hi there"], FILE)[0])])
    assert t.token_ids(df.limit(0), "doc_id", "text", FILE).count() == 0


def test_offsets_lead_back(spark):
    text = "It's  می‌شود, 12!\n"
    r = t.token_ids(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text", FILE, True).first()
    for k, start in enumerate(r.starts):
        end = r.starts[k + 1] if k + 1 < len(r.starts) else len(text)
        last = r.firsts[k + 1] if k + 1 < len(r.firsts) else len(r.ids)
        assert t.restore(r.ids[r.firsts[k] : last], FILE) == text[start:end]
