"""Block products against brute force: short products only rule pairs out, each pair of blocks is multiplied once, and the work
is dealt over tasks."""

from __future__ import annotations

import numpy as np
import pytest

from mnemolake.operators import retrieval


def _brute(ids, m, threshold, k, inclusive=False):
    norm = np.linalg.norm(m, axis=1)
    sim = np.round(m @ m.T / np.maximum(np.outer(norm, norm), 1e-300), 9)
    out = {}
    for a, own in enumerate(ids):
        near = sorted((-sim[a, b], other) for b, other in enumerate(ids) if a != b and (sim[a, b] >= threshold if inclusive else sim[a, b] > threshold))
        out |= {(own, other): -s for s, other in near[:k]}
    return out


@pytest.mark.parametrize(("threshold", "k"), [(0.35, 3), (0.1, 2), (-2.0, 4), (0.5, None)])
def test_pairs_are_those_of_brute_force(spark, threshold, k):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(150, 12))
    m[40:60], m[60] = m[40], 0.0  # equal vectors, and a zero vector
    m[61] = m[62] * 1e-120
    ids = [f"{i:03}" for i in range(len(m))]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m, strict=True)], "id string, embedding array<double>").repartition(3)
    got = retrieval._block_pairs(rows, threshold, 16, k)
    if k is not None:
        got = retrieval._ranked(got, k)
    got, want = {(r.id, r.other): r.similarity for r in got.collect()}, _brute(ids, m, threshold, k or len(m))
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-9 for x in got)


def test_pairs_of_blocks_are_many_tasks_and_each_is_there_once(spark, monkeypatch):
    seen, real = [], retrieval.multiplied

    def watch(met, *args, **named):
        seen.append((met.rdd.getNumPartitions(), met.count()))
        return real(met, *args, **named)

    monkeypatch.setattr(retrieval, "multiplied", watch)
    rows = spark.range(60).selectExpr("cast(id as string) as id", "array(1.0D, cast(id as double)) as embedding").coalesce(1)
    assert retrieval._block_pairs(rows, 0.9, 10, 3).count() >= 60
    assert seen[0][1] == 21 and seen[0][0] > 1  # 6 blocks: 6 + 15 pairs, in one file


def test_links_near_the_threshold_are_told_exactly():
    x = np.array([[1.0, 0.0]])
    angle = np.arccos(0.8) + np.array([-1e-4, -1e-8, -2e-10, 2e-10, 1e-8, 1e-4])
    y = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    side = lambda m: (m, np.full(len(m), 2), np.linalg.norm(m, axis=1))
    want = np.round(retrieval._product(*side(x), *side(y)), 9) >= 0.8
    assert (retrieval._near(side(x), side(y), 0.8) == want).all() and want.any() and not want.all()
