import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadflow.llm import packing as p

needs_files = pytest.mark.skipif(not os.path.exists(p.TOKENIZERS), reason="no tokenizer files")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.just(50))
def test_no_container_is_overfull_and_all_are_placed(lengths, capacity):
    home = p.pack(np.array(lengths, np.int64), capacity)
    assert len(home) == len(lengths)
    totals = {}
    for n, k in zip(lengths, home.tolist(), strict=True):
        totals[k] = totals.get(k, 0) + n
    assert all(v <= capacity for v in totals.values())
    # Two containers could be joined at most if they are the two last ones of a descending order.
    assert len(totals) <= 2 * -(-sum(lengths) // capacity) + 1


def test_little_space_is_unused():
    lengths = np.random.default_rng(1).integers(20, 400, 5000)
    used = len(set(p.pack(lengths, 2048).tolist()))
    assert used <= 1.01 * -(-int(lengths.sum()) // 2048) + 1


def test_costs_are_balanced():
    lengths = np.random.default_rng(2).integers(20, 400, 5000).astype(np.int64)
    home = p.pack(lengths, 4096)
    cost = np.bincount(home, lengths + p.QUADRATIC * lengths**2)
    assert np.sort(cost)[5:].min() > 0.85 * cost.max()


@needs_files
def test_placing(spark):
    rows = [(1, None), (2, ""), (3, "word " * 500), (4, "short"), (4, "short"), (None, "x")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, container string")
    specs = [(1, "byte_bpe_50k", 128), (2, "piece_bpe_32k", 64), (3, "word_bpe_49k", 1000)]
    found = p.fill_containers(df, "doc_id", "text", specs, shard=4).toPandas()
    names = {1: 128, 2: 64, 3: 1000}
    for spec, group in found.groupby("spec_id"):
        assert (group.groupby("container_id").n_tokens.sum() <= names[spec]).all()
        assert len(group[group.piece_no == 0]) == len(rows)
        long = group[group.id == 3].sort_values("piece_no")
        counted = p.count_tokens(["word " * 500], p.TOKENIZERS, [specs[spec - 1][1]])[specs[spec - 1][1]][0]
        assert long.n_tokens.sum() == counted and (long.n_tokens[:-1] == names[spec]).all()
        assert (long.token_start.to_numpy() == np.arange(len(long)) * names[spec]).all()
        assert group[group.id.isin([1, 2])].n_tokens.tolist() == [0, 0]
        assert (group[group.id == 4].piece_no == 0).all()
    assert p.fill_containers(df.limit(0), "doc_id", "text", specs).count() == 0
    assert p.fill_containers(df, "doc_id", "text", []).count() == 0
