"""The linear program of packing decides, also with as many lengths as real tables have."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from mnemolake.llm import packing


@pytest.mark.parametrize(("most", "whole_share"), [(10, 0.8), (400, 0.98)])
def test_every_one_of_2000_lengths_is_covered(most, whole_share):
    rng = np.random.default_rng(5)
    counts = rng.integers(1, most, 2048)
    counts[0] = counts[rng.integers(1, 2048, 40)] = 0
    cover, left = np.zeros(2048), counts.copy()
    found = packing.solve(counts.astype(float), 2048)[0]
    for config, times in found.items():
        assert sum(config) <= 2048 and times > 0
        kinds, n = np.unique(np.array(config), return_counts=True)
        cover[kinds] += times * n
        if whole := int(min(np.floor(times + 1e-9), (left[kinds] // n).min())):
            left[kinds] -= whole * n
    assert (cover >= counts - 1e-6 * np.maximum(counts, 1)).all()
    assert left.sum() <= (1 - whole_share) * counts.sum()
    assert sum(n for _, n in packing.plan(counts, 2048, found)) <= 1.01 * max((counts * np.arange(2048)).sum() / 2048, counts[1025:].sum()) + 2


@pytest.fixture(scope="module")
def documents():
    """How many pieces of sf0.1 have each length."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokens = packing.word_tokens(public_tokenizers.path("word_bpe_49k.json"))
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    lengths = np.array([len(ids) // 4 + 1 for ids in tokens.encode_all([t or "" for t in texts])])
    counts = np.bincount(lengths % 2048, minlength=2048)
    counts[0] = 0
    return counts


@pytest.mark.parametrize("times", [1, 100, 1000])
def test_value_and_bound_meet_on_whole_documents(documents, times):
    counts = documents * times
    found, bound = packing.solve(counts, 2048)
    assert bound <= sum(found.values()) * (1 + 1e-9) <= 1.0005 * bound
    cover = np.zeros(2048)
    for config, n in found.items():
        np.add.at(cover, list(config), n)
    assert (cover >= counts * (1 - 1e-9) - 1e-6).all()
    made = packing.plan(counts, 2048, found)
    held = np.zeros(2048, np.int64)
    for config, n in made:
        assert sum(config) <= 2048
        np.add.at(held, list(config), n)
    assert (held == counts).all()
    assert sum(n for _, n in made) <= min(sum(packing.best_fit(counts, 2048).values()), 1.0005 * bound + 1)
