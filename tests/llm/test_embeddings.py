"""Whitening and product codes against plain versions."""

import collections
import hashlib
import math
import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemolake.llm import codes, whitening
from mnemolake.llm.queries import ORACLE_SQL, QUERIES

VECTORS = "vec_id long, embedding array<double>, label int, x int, code string, component int, error long, `of` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "c", 2, 3, 4) for i, v, label in rows], VECTORS)


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def odd_rows(seed, n, width):
    """Ties, repeats, a third of all rows equal, null ids and labels, and rows that take no part."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.15, width).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(n + i, [0.25] * width, None if i % 2 else 7) for i in range(n // 2)]
    rows += [rows[3], (rows[3][0], rows[4][1], 2), (None, rows[5][1], 1), (None, [0.5] * width, None)]
    rows += [(-1, None, 1), (-2, [0.1, None], 1), (-3, [math.nan] * width, 1), (-4, [math.inf] * width, 1)]
    return rows


# whitening


def plain_matrix(rows):
    kept = [(i, v) for i, v, _ in rows if good(v)]
    width = max(len(v) for _, v in kept)
    x = [tuple(math.floor(max(-(2.0**30), min(2.0**30, 64 * c))) + 1_000_000 for c in v + [0.0] * (width - len(v))) for _, v in kept]
    return [i for i, _ in kept], x


def check_whitening(rows, got):
    ids, x = plain_matrix(rows)
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    most = min(16, len(sums))
    assert len(got) == most * len(ids)
    by = collections.defaultdict(list)
    for r in got:
        by[r.component].append(r)
    assert sorted(by) == list(range(1, most + 1))
    deviations = collections.Counter((i, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for i, v in zip(ids, x, strict=True))
    for k in range(most):
        assert collections.Counter((r.vec_id, r.deviation) for r in by[k + 1]) == deviations
        assert {r.n for r in by[k + 1]} == {n} and [*{r.explained for r in by[k + 1]}] == pytest.approx([values[k] / values.sum()], rel=1e-9)
        assert all(r.identity_error < 1e-9 for r in by[k + 1])
        plain = sorted(abs(float(np.dot([float(n * a - s) / n for a, s in zip(v, sums, strict=True)], axes[:, k])) / math.sqrt(values[k])) for v in x)
        assert sorted(abs(r.whitened) for r in by[k + 1]) == pytest.approx(plain, abs=1e-8)


def test_whitening(spark):
    rows = odd_rows(1, 150, 20)
    check_whitening(rows, whitening.whiten(frame(spark, rows).repartition(5)).collect())


def test_whitening_of_few_dimensions(spark):
    rows = odd_rows(2, 80, 5) + [(900, [0.3, 0.1], 1), (901, [0.2], 1), (902, [], 1)]
    got = whitening.whiten(frame(spark, rows).repartition(3)).collect()
    check_whitening(rows, got)


def test_one_sign_for_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, 1, 3) * [3, 1, 0.2]).tolist(), 0) for i in range(200)]
    got = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(frame(spark, rows).repartition(4)).collect()}
    y = np.array([[got[i, k] for k in (1, 2, 3)] for i in range(200)])
    assert np.abs(y.T @ y / 200 - np.eye(3)).max() < 1e-9 and np.abs(y.mean(0)).max() < 1e-9


def test_whitening_without_variance(spark):
    flat = whitening.whiten(frame(spark, [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)])).collect()
    assert len(flat) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 and r.identity_error == 0 for r in flat)
    line = whitening.whiten(frame(spark, [(i, [i / 8, i / 4], 0) for i in range(9)])).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True} and max(r.identity_error for r in line) < 1e-9
    assert whitening.whiten(frame(spark, [(1, None, 0)])).count() == 0 and whitening.whiten(frame(spark, [])).count() == 0


def test_whitening_of_huge_components(spark):
    rows = [(i, [1e300 * (i % 3 - 1), 0.1 * i], 0) for i in range(60)]
    got = whitening.whiten(frame(spark, rows)).collect()
    x = [v for v in plain_matrix(rows)[1]]
    fit = set(x)
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    want = [d if (d := sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) < 2**63 else None for v in x]
    assert [r.deviation for r in sorted(got, key=lambda r: r.vec_id) if r.component == 1] == want


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 24), st.integers(0, 2**32 - 1), st.sampled_from([1.0, 1e-6]))
def test_jacobi(n, seed, grade):
    rng = np.random.default_rng(seed)
    d = np.geomspace(1, grade, n)
    b = rng.normal(0, 1, (3 * n + 5, n)) * d
    a = b.T @ b
    values, axes = whitening.jacobi(a)
    assert np.all(np.diff(values) <= 0) and np.abs(axes.T @ axes - np.eye(n)).max() < 1e-12
    assert np.abs(axes @ np.diag(values) @ axes.T - a).max() < 1e-12 * np.abs(a).max()
    plain = np.sort(np.linalg.svd(b, compute_uv=False) ** 2)[::-1]  # accurate for small ones too
    assert values == pytest.approx(plain, rel=1e-6)


# product codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, label) for i, v, label in rows if good(v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    x = [[max(-(2**22), min(2**22, math.floor(max(-1e9, min(1e9, 256 * c))))) for c in v + [0.0] * (width - len(v))] for _, v, _ in kept]
    size, order = width // parts, sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, x[r]))[:entries]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(x[r], p) for r in order] for p in range(parts)]
    dist = lambda a, b: sum((c - d) ** 2 for c, d in zip(a, b, strict=True))
    for k in range(rounds + 1):
        at = [[min((dist(cut(v, p), e), n) for n, e in enumerate(books[p])) for p in range(parts)] for v in x]
        if k < rounds:
            for p in range(parts):
                for n in range(len(books[p])):
                    if own := [cut(v, p) for v, a in zip(x, at, strict=True) if a[p][1] == n]:
                        books[p][n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    errors = collections.Counter()
    for (_, _, label), a in zip(kept, at, strict=True):
        errors[label] += sum(d for d, _ in a)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return collections.Counter((i, "".join(f"{n:02x}" for _, n in a), sum(d for d, _ in a), errors[label], sha) for (i, _, label), a in zip(kept, at, strict=True))


@pytest.mark.parametrize(("n", "width", "parts"), [(150, 32, 16), (30, 6, 3), (40, 5, 4)])
def test_codes(spark, n, width, parts):
    rows = odd_rows(n, n, width)
    got = codes.product_codes(frame(spark, rows).repartition(5), parts).collect()
    assert collections.Counter(map(tuple, got)) == plain_codes(rows, parts)


def test_codes_of_odd_widths(spark):
    rows = odd_rows(3, 70, 4) + [(300, [0.5], 1), (301, [], 1), (302, [1e300, -1e300, 0.1, 5.0], 3)]
    got = codes.product_codes(frame(spark, rows).repartition(3), 2, entries=20).collect()
    assert collections.Counter(map(tuple, got)) == plain_codes(rows, 2, 20)
    assert [tuple(r)[:4] for r in codes.product_codes(frame(spark, [(1, [], 1)])).collect()] == [(1, "00" * 16, 0, 0)]
    assert codes.product_codes(frame(spark, [(1, None, 1)])).count() == 0 == codes.product_codes(frame(spark, [])).count()
    with pytest.raises(ValueError, match="hex"):
        codes.product_codes(frame(spark, rows), entries=300)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([2, 20, 2**22]), st.integers(1, 5))
def test_annulus_finds_the_nearest_and_leaves_entries_out(seed, spread, size):
    rng = np.random.default_rng(seed)
    entries, x = rng.integers(-spread, spread, (64, size)), rng.integers(-spread, spread, (300, size))
    book = codes.Codebook(entries)
    number, d = book.nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert np.array_equal(d, every.min(1)) and np.array_equal(number, every.argmin(1))
    lo, hi = book.annulus(np.sqrt((x * x).sum(1)), d)
    assert (hi > lo).all() and (spread < 20 or size > 2 or (hi - lo).mean() < 40)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_codes_as_their_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    file = f"{path}/embeddings.parquet"
    con.execute(f"create view embeddings as select * from '{file + '/*.parquet' if os.path.isdir(file) else file}'")
    got = QUERIES["op13_codes"](spark, path)
    want = con.execute(ORACLE_SQL["op13_codes"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
