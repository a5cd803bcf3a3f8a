"""A fit's memory: the rows' ids, which it is given, and arrays of the feature space; no values or copies of rows beside them."""

from __future__ import annotations

import tracemalloc

import numpy as np

from mnemolake.llm import nbsvm


def test_a_fit_holds_no_second_copy_of_its_rows():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(1 << 16, 20_000, replace=False)).astype("<i4") for _ in range(240)]
    y = np.array([i % 4 == 0 for i in range(len(rows))], int)
    tracemalloc.start()
    try:
        nbsvm.fit(rows, y, 16, epochs=2, folds=2, least=10)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < sum(x.nbytes for x in rows) / 2


def test_descent_is_that_of_whole_rows():
    """Against the same steps on rows written out as vectors."""
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(60, int(rng.integers(1, 20)), replace=False)).astype("<i4") for _ in range(80)]
    y, scale = rng.integers(0, 2, 80), rng.normal(size=60).astype(np.float32)
    scale[::7] = 0
    got = nbsvm.dual_descent(rows, y, scale, 1.0, 9)
    x = np.zeros((80, 61))
    for i, ids in enumerate(rows):
        x[i, ids] = scale[ids] / max(np.linalg.norm(scale[ids].astype(float)), 1e-9)
    x[:, 60] = 1
    w, alpha, order = np.zeros(61), np.zeros(80), np.random.default_rng(7)
    for _ in range(9):
        for i in order.permutation(80):
            s = 1.0 if y[i] else -1.0
            new = min(max(alpha[i] - (s * (x[i] @ w) - 1) / 2, 0.0), 1.0)
            w, alpha[i] = w + (new - alpha[i]) * s * x[i], new
    assert np.allclose(got, w, atol=1e-6)
