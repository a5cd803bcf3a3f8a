"""The classifiers against a plain naive Bayes SVM, and their recall and precision on held-out rows of the test data."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from mnemolake.llm import classify, nbsvm


def test_ratios_and_descent_against_plain_python():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 60, 12)) for _ in range(80)]
    y = np.array([int(3 in x or 7 in x) for x in rows])
    scale = nbsvm.log_count_ratio(rows, y, 64, alpha=2.0)
    up, n = int(y.sum()), len(y)
    for f in range(64):
        p, q = (sum(f in x for x, label in zip(rows, y, strict=True) if label == k) for k in (1, 0))
        want = np.log((p + 2 * up / n) / (up + 2 * up / n)) - np.log((q + 2 * (n - up) / n) / (n - up + 2 * (n - up) / n))
        assert abs(scale[f] - want) < 1e-5
    w = nbsvm.dual_descent(rows, y, scale, cost=1.0, epochs=400)
    # the same problem by projected gradient ascent on the dual, densely
    x = np.zeros((n, 65))
    for i, own in enumerate(rows):
        x[i, own] = scale[own]
        x[i] /= np.linalg.norm(x[i])
        x[i, 64] = 1
    gram = (x @ x.T) * np.outer(2 * y - 1, 2 * y - 1)
    alpha = np.zeros(n)
    for _ in range(30_000):
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, 1)
    loss = lambda v: v @ v / 2 + np.maximum(0, 1 - (2 * y - 1) * (x @ v)).sum()
    assert loss(w) <= 1.01 * loss((alpha * (2 * y - 1)) @ x)


def _held_out(label, modulus, rest, features, how):
    docs, labels = (pq.read_table(f"/root/testdata/sf0.1/{t}.parquet").to_pylist() for t in ("documents", "labels"))
    known = {r["doc_id"]: r[label] for r in labels if r[label] in (0, 1)}
    scratch = features.scratch()
    rows = [(zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest, known[r["doc_id"]], np.sort(features(r["text"], scratch))) for r in docs if r["doc_id"] in known]
    model = nbsvm.fit([x for held, _, x in rows if not held], np.array([v for held, v, _ in rows if not held]), features.bits, **how)
    got = [(model.score(x) >= classify.THRESHOLD, v) for held, v, x in rows if held]
    return got


@pytest.mark.parametrize(("of", "label", "modulus", "rest", "features", "how"), [
    (1, "toxic", 3, 1, classify.TOXIC, classify.TOXIC_FIT), (1, "quality", 4, 2, classify.QUALITY, classify.QUALITY_FIT), (0, "quality", 4, 2, classify.QUALITY, classify.QUALITY_FIT),
])
def test_held_out_recall_and_precision(of, label, modulus, rest, features, how):
    got = _held_out(label, modulus, rest, features, how)
    hits = sum(p == of == v for p, v in got)
    assert hits >= 0.9 * sum(v == of for _, v in got)
    assert hits >= 0.9 * sum(p == of for p, _ in got)


def test_kept_columns_may_have_the_result_s_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 6, "y"), (None, None, 7, "z")], "doc_id long, text string, score int, predicted string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    out = classify.quality(docs, labels, keep=("doc_id", "text", "score", "predicted"))
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "text", "doc_score", "doc_predicted"]
    assert sorted(r.doc_score for r in out.collect()) == [5, 6, 7]
