"""Nearest rows in blocks: a third of all vectors equal, ties, the cut inside blocks, thresholds met exactly."""

import datetime as dt

import numpy as np

from mnemolake.operators import patterns, retrieval


def brute(queries, rows, k, own):
    out = set()
    for q, x in queries:
        near = [(-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9), i) for i, y in rows if not own or i != q]
        out |= {(q, i, n) for n, (_, i) in enumerate(sorted(near)[:k], 1)}
    return out


def vectors(n):
    rng = np.random.default_rng(3)
    return [(f"{i:03}", [1.0, 2.0, 2.0] if i % 3 == 0 else rng.integers(1, 9, 3).astype(float).tolist()) for i in range(n)]


def test_neighbours_of_hot_vectors(spark):
    rows = vectors(90)
    df = spark.createDataFrame([(i, v, None, None) for i, v in rows], "id string, embedding array<double>, superseded_by string, expires_at timestamp_ntz")
    got = retrieval.neighbours(df, -1.0, 4, block=16)
    assert {(r.id, r.other, r.rank) for r in got.collect()} == brute(rows, rows, 4, True)
    # before the ranks across blocks, each row has k rows at most from each pair of blocks, though 29 equal ones pass
    pairs = retrieval._block_pairs(df.select("id", "embedding").coalesce(1), 0.9999, 128, 4)
    assert max(r["count"] for r in pairs.groupBy("id").count().collect()) == 4


def test_nearest_keeps_the_query_itself(spark):
    rows = vectors(60)
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = retrieval.nearest(df.where("id < '010'"), df, 5, block=8)
    assert {(r.id, r.other, r.rank) for r in got.collect()} == brute(rows[:10], rows, 5, False)
    assert retrieval.nearest(df.where("false"), df, 5).count() == 0 == retrieval.nearest(df, df.where("false"), 5).count()


def test_clusters_take_likeness_at_the_threshold(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("a", [1.0, 0.0], day), ("b", [3.0, 4.0], day), ("c", [0.0, -1.0], day)]  # a and b: 0.6 exactly
    df = spark.createDataFrame([(*r, None, None) for r in rows], "id string, embedding array<double>, created_at timestamp_ntz, superseded_by string, expires_at timestamp_ntz")
    assert {(r.cluster, r.id) for r in patterns.greedy_clusters(df, 0.6).collect()} == {("a", "a"), ("a", "b")}


def test_blocks_are_packed_once_and_strips_keep_ties(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"{i:03d}", [float(x) for x in v]) for i, v in enumerate(rng.integers(-1, 2, (90, 3)))] + [("nan", [float("nan"), 1.0, 1.0]), ("short", [1.0]), ("null", [None, 1.0, 1.0])]
    monkeypatch.setattr(retrieval, "STRIP", 7)
    pairs = retrieval._block_pairs(spark.createDataFrame(rows, "id string, embedding array<double>"), -0.5, 40, 4)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = sorted((r.id, r["rank"], r.other, r.similarity) for r in retrieval._ranked(pairs, 4).collect())
    want = []
    for a, x in rows:
        near = []
        for b, y in rows:
            if a != b:
                ok = len(x) == len(y) and None not in x + y and not np.isnan(x + y).any()
                norms = np.linalg.norm(x) * np.linalg.norm(y) if ok else 0
                s = round(float(np.dot(x, y) / norms), 9) if norms else (None if len(x) == len(y) and len(x) == 3 and "nan" in (a, b) or "null" in (a, b) and len(x) == len(y) else 0.0)
                if s is not None and s > -0.5:
                    near.append((-s, b))
        want += [(a, n + 1, b, -s) for n, (s, b) in enumerate(sorted(near)[:4])]
    assert got == sorted(want)
