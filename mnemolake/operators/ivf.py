"""Approximate nearest neighbours from an inverted file: rows stored under the cell of their nearest centroid, so that a query
reads a few cells only, whose rows are then compared exactly.

Centroids come from spherical k-means on a bounded sample (SAMPLE rows, those with the smallest hashes of their ids, so that a
run again takes the same); every row is stored. Rows without a direction of the index's length (another number of components,
zero vectors, null or non-finite components) go to a cell of their own that is always read: no row is out of reach, and with
all cells probed the result is the exact one."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import filled
from .retrieval import _ranked, multiplied, packed, sided
from .retrieval import nearest as exact

SAMPLE, ROUNDS, MOST_CELLS, REST = 16_384, 10, 4096, -1


@dataclass(frozen=True)
class Index:
    path: str
    centroids: np.ndarray  # unit rows; at most MOST_CELLS

    def rows(self, spark: SparkSession, cells: list[int] | None = None) -> DataFrame:
        """id, embedding, cell of the given cells (None: all); the others' files are not read."""
        out = spark.read.schema("id string, embedding array<double>, cell int").parquet(f"{self.path}/rows")
        return out if cells is None else out.where(F.col("cell").isin(cells))


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def fit_centroids(m: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means; a cell that has lost its rows takes the row that is least like its own centroid."""
    x = _units(m)
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        sim = x @ centres.T
        own = sim.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(sim[np.arange(len(x)), own], kind="stable")[: len(empty)]]
        centres = _units(sums)
    return centres


def _nearest_cells(lists: pa.Array, centroids: np.ndarray, probes: int) -> np.ndarray:
    """Of each vector the numbers of the nearest cells, the nearest first; REST throughout for one without a direction."""
    m, sizes = filled(lists)
    with np.errstate(invalid="ignore", over="ignore"):
        ok = (sizes == centroids.shape[1]) & np.isfinite(m).all(1) & (np.linalg.norm(m, axis=1) > 0)
    out = np.full((len(sizes), probes), REST, np.int64)
    if ok.any():
        sim = _units(m[ok][:, : centroids.shape[1]]) @ centroids.T
        out[ok] = np.argsort(-sim, axis=1, kind="stable")[:, :probes]
    return out


def build(rows: DataFrame, path: str, cells: int, dims: int | None = None, sample: int = SAMPLE) -> Index:
    """Writes the index of rows (id, embedding) to path. dims: components of the indexed vectors (None: those that most of the
    sample have)."""
    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"1 to {MOST_CELLS} cells")
    spark, rows = rows.sparkSession, rows.where("embedding is not null").select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def fit(batches):
        table = pa.Table.from_batches(batches)
        if len(table):
            m, sizes = filled(table.column(0).combine_chunks())
            width = dims or int(np.bincount(sizes).argmax())
            good = (sizes == width) & np.isfinite(m).all(1) & (np.linalg.norm(m, axis=1) > 0)
            if width and good.any():
                centres = fit_centroids(m[good][:, :width], cells)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(len(centres)), pa.int32()), "centroid": pa.array(list(centres), pa.list_(pa.float64()))})

    chosen = rows.orderBy(F.xxhash64("id"), "id", "embedding").limit(sample).select("embedding").coalesce(1)  # bounded: one task
    chosen.mapInArrow(fit, "cell int, centroid array<double>").write.parquet(f"{path}/centroids")
    index = open_index(spark, path)

    def assign(batches):
        for b in batches:
            own = _nearest_cells(b.column(1), index.centroids, 1)[:, 0] if len(index.centroids) else np.full(len(b), REST)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32())], ["id", "embedding", "cell"])

    placed = rows.mapInArrow(assign, "id string, embedding array<double>, cell int")
    # a partition holds whole small cells or a part of a large one: a cell with a third of all rows is written by many tasks
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    return index


def open_index(spark: SparkSession, path: str) -> Index:
    got = sorted(spark.read.schema("cell int, centroid array<double>").parquet(f"{path}/centroids").collect())  # bounded: MOST_CELLS
    return Index(path, np.array([r.centroid for r in got], float) if got else np.zeros((0, 0)))


def probed(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """id, embedding, cell: each query once for each cell that it is to see."""
    probes = min(probes, max(len(index.centroids), 1))

    def choose(batches):
        for b in batches:
            cells = _nearest_cells(b.column(1), index.centroids, probes) if len(index.centroids) else np.full((len(b), probes), REST)
            # a query without a direction sees all cells: its similarities are all 0 or, for its own length, to be computed
            lists = [[*range(REST, len(index.centroids))] if c[0] == REST else [REST, *c.tolist()] for c in cells]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32()))], ["id", "embedding", "cells"])

    rows = queries.where("embedding is not null").select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(choose, "id string, embedding array<double>, cells array<int>").select("id", "embedding", F.explode("cells").alias("cell"))


def nearest(queries: DataFrame, index: Index, k: int, probes: int = 16, block: int = 2048) -> DataFrame:
    """id (of the query), other, similarity, rank: the k nearest of the rows in the cells that a query probes, compared exactly.
    Queries and rows meet as blocks of a cell; cells that no query probes are not read (a partition filter). Equal ids do not
    exclude one another: leave a query's own row out by its id."""
    spark = queries.sparkSession
    asked = probed(queries, index, probes)
    cells = sorted(r.cell for r in asked.select("cell").distinct().collect())  # bounded by the number of cells
    left = sided(packed(asked.repartition("cell"), block, "cell"), "x")
    right = sided(packed(index.rows(spark, cells), block, "cell"), "y")
    return _ranked(multiplied(left.join(right, F.col("x_cell") == F.col("y_cell")), -2.0, k, False), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of the truth's (id, other) that were found, both distinct; 1 where there is no truth."""
    hit = truth.select("id", "other").distinct().join(found.select("id", "other").distinct().withColumn("hit", F.lit(1)), ["id", "other"], "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))


def tuned_probes(rows: DataFrame, index: Index, k: int = 10, target: float = 0.93, sample: int = 64) -> int:
    """The least number of cells to probe at which the share of true nearest rows found reaches the target, measured with a
    sample of the indexed rows as queries (the smallest hashes of their ids) against all rows: one exact search, then a
    histogram of how far down a query's own order of cells its true nearest rows lie."""
    if not len(index.centroids):
        return 1
    spark, rows = rows.sparkSession, rows.where("embedding is not null").select(F.col("id").cast("string").alias("id"), "embedding")
    asked = rows.orderBy(F.xxhash64(F.concat(F.lit("probe"), "id")), "id").limit(sample)

    def order(batches):
        for b in batches:
            cells = _nearest_cells(b.column(1), index.centroids, len(index.centroids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([*cells], pa.list_(pa.int32()))], ["id", "cells"])

    far = asked.select("id", F.col("embedding").cast("array<double>")).mapInArrow(order, "id string, cells array<int>")
    near = exact(asked, rows, k).join(index.rows(spark).select(F.col("id").alias("other"), "cell"), "other").join(far, "id")
    place = F.when(F.col("cell") == REST, 1).when(F.get("cells", F.lit(0)) == REST, 1).otherwise(F.array_position("cells", F.col("cell").cast("int")))
    counts = {r.place: r.n for r in near.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}  # one row a cell at most
    total, seen = sum(counts.values()), 0
    for place in sorted(counts):
        seen += counts[place]
        if seen >= target * total:
            return int(place)
    return 1


def nearest_others(queries: DataFrame, index: Index, k: int, probes: int) -> DataFrame:
    """As nearest, without the rows that have a query's own id."""
    found = nearest(queries, index, k + 1, probes).where("id <> other").drop("rank")
    return _ranked(found, k)
