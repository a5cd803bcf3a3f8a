"""Whitening of embeddings by a cyclic Jacobi eigensolver.

Components become whole numbers x; the fit list holds each different x vector once, so that copies, however many, do not
weigh. Its count, sums and centred scatter are added up by Spark: each task gives one matrix of partial sums. The driver turns
the covariance by symmetric Jacobi rotations, sweep after sweep through all pairs of dimensions, until every off-diagonal
entry has vanished against its two diagonal ones. That test is relative to the pair, so that small eigenvalues come out as
accurately as large ones. The whitening matrix (width x 16 numbers) goes along with the tasks that project the rows.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as filled up with zeros to the
longest length. Scaled components beyond 2^30 are taken as 2^30 (likewise below). Rows without vec_id, repeated rows and
repeated ids are rows like any other. A component without variance, to rounding, has no whitened value (null), and is left out
of identity_error; explained is null where nothing varies at all, and deviation where it does not fit a long. Vectors with
fewer than 16 dimensions have as many components as dimensions. An empty table gives no rows; other columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, staged, table
from .vectors import matrix, whole, widest

MOST, OFFSET, STEP = 2**30, 1_000_000, 2048
#: The driver holds the covariance, so that dimensions have a bound; components with less than this share of the variance have none.
WIDEST, NOTHING = 4096, 1e-13


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix. A sweep turns every pair of dimensions once,
    in the cyclic order of a round-robin: each of its rounds has disjoint pairs, whose rotations do not touch one another and
    are done together. It ends with a sweep in which no pair needed a rotation."""
    a, n = np.array(a, float), len(a)
    v = np.eye(n)
    m = n + n % 2
    seats = np.arange(m)
    least = np.finfo(float).tiny
    for _ in range(sweeps):
        turned = False
        for _ in range(m - 1):
            p, q = np.minimum(seats[: m // 2], seats[m // 2 :][::-1]), np.maximum(seats[: m // 2], seats[m // 2 :][::-1])
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            p, q = p[q < n], q[q < n]
            off, app, aqq = a[p, q], a[p, p], a[q, q]
            need = np.abs(off) > np.maximum(np.finfo(float).eps * np.sqrt(np.abs(app * aqq)), least)
            if not need.any():
                continue
            turned = True
            p, q, off, app, aqq = p[need], q[need], off[need], app[need], aqq[need]
            theta = (aqq - app) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            for x in (a, v):  # columns of both
                x[:, p], x[:, q] = c * x[:, p] - s * x[:, q], s * x[:, p] + c * x[:, q]
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[p, p], a[q, q], a[p, q], a[q, p] = app - t * off, aqq + t * off, 0.0, 0.0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    return np.diag(a)[order], v / np.sqrt((v * v).sum(0))


def _scatter(fit: DataFrame, width: int, project) -> np.ndarray:
    """The sum over the fit list of y y^T with y = project(x), x a step of rows. Each task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, len(batch), STEP):
                y = project(matrix(batch.column(0).slice(at, STEP), width))
                total = y.T @ y if total is None else total + y.T @ y
        for i, row in enumerate(total if total is not None else ()):
            j = np.arange(i + 1)
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(i + 1, i), pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(row[: i + 1], pa.float64())})

    added = fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect()  # a matrix
    size = max((r[0] for r in added), default=-1) + 1
    out = np.zeros((size, size))
    for i, j, v in added:
        out[i, j] = out[j, i] = v
    return out


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows of the fit list and the sums of its dimensions, in whole numbers; fit holds x without the offset."""
    places = fit.select(F.posexplode("x").alias("place", "v")).groupBy("place").agg(F.sum("v")).collect()  # one row a dimension
    n, sums = fit.count(), [0] * width
    for place, v in places:
        sums[place] = v
    return n, [s + n * OFFSET for s in sums]


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each usable row of vectors (vec_id,
    embedding) and each of the largest components."""
    spark = vectors.sparkSession
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole(vectors, scale, MOST, F.col("vec_id").cast("long").alias("vec_id"))
    width = widest(rows)
    if not width:
        return spark.createDataFrame([], kind)
    if width > WIDEST:
        raise ValueError(f"at most {WIDEST} dimensions")
    filled = F.when(F.size("x") < width, F.concat("x", F.array_repeat(F.lit(0), F.lit(width) - F.size("x")))).otherwise(F.col("x"))
    fit = staged(rows.select(filled.alias("x")).distinct(), "fit")
    n, sums = _sums(fit, width)
    # the mean as a whole number and a rest below one: x less the first is exact, however large the offset
    floors, rests = np.array([s // n - OFFSET for s in sums], np.int64), np.array([(s % n) / n for s in sums])
    scatter = _scatter(fit, width, lambda x: (x - floors) - rests)
    values, turned = jacobi(scatter / n)
    trace, most = float(values.sum()), min(components, width)
    values, axes = values[:most], turned[:, :most]
    alive = values > NOTHING * max(trace, 0.0)
    matrix16 = np.where(alive, axes / np.sqrt(np.where(alive, values, 1.0)), 0.0)

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - floors) - rests) @ matrix16

    centre = _mean(fit, width, projected, n)
    spread = _scatter(fit, width, lambda x: projected(x) - centre) / n - np.eye(most)
    error = float(np.abs(spread[np.ix_(alive, alive)]).max(initial=0.0))
    discard(fit)
    explained = [float(e) / trace if trace > 0 else None for e in values]
    exact = np.array([s - n * OFFSET for s in sums], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = pa.array(np.arange(1, most + 1), pa.int32())
        for batch in batches:
            for at in range(0, len(batch), STEP):
                step = batch.slice(at, STEP)
                x = matrix(step.column(1), width)
                k = len(step)
                far = int(np.abs(x).max(initial=0)) * n + int(np.abs(exact).max())
                if far * far * width < 2**63:
                    deviation = ((x * n - exact.astype(np.int64)) ** 2).sum(1).tolist()
                else:
                    deviation = [d if (d := sum((a * n - s) ** 2 for a, s in zip(r, exact.tolist(), strict=True))) < 2**63 else None for r in x.tolist()]
                y = projected(x)
                yield pa.RecordBatch.from_arrays([
                    step.column(0).take(pa.array(np.repeat(np.arange(k), most))), pa.concat_arrays([number] * k), pa.array(np.full(k * most, n), pa.int64()),
                    pa.array([d for d in deviation for _ in range(most)], pa.int64()), pa.array(y.reshape(-1), pa.float64(), mask=np.tile(~alive, k)),
                    pa.array(explained * k, pa.float64()), pa.array(np.full(k * most, error), pa.float64()),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, kind)


def _mean(fit: DataFrame, width: int, project, n: int) -> np.ndarray:
    """The mean over the fit list of project(x); next to nothing, but the covariance is centred before it is multiplied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, len(batch), STEP):
                y = project(matrix(batch.column(0).slice(at, STEP), width)).sum(0)
                total = y if total is None else total + y
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total)), pa.int32()), "v": pa.array(total, pa.float64())})

    return np.array([r[1] for r in sorted(fit.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect())]) / n


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
