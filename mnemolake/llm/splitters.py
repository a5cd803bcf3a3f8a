"""Sampled splitters: quantile boundaries of weighted keys, and the range that a key falls in, by native expressions.

Keys are 64-bit integers. The sample is bounded by a parameter; every row is then placed by the boundaries.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal_array

#: The most cells of the look-up table.
CELLS = 4096


def sample_splitters(df: DataFrame, key: Column, weight: Column, ranges: int, per_range: int = 24, seed: int = 17, total: int | None = None) -> tuple[list[int], dict[int, int]]:
    """Boundaries b: range i holds b[i-1] <= key < b[i]. Draws about ranges * per_range keys, each row as often as its share
    of the total weight asks (systematic rounding with a hash as the offset), and cuts the drawn keys at even quantiles.
    Equal boundaries merge, so a key with more than a range's weight gets a range of its own; the second result says of such
    ranges how many ranges' weight they hold. What reaches the driver is the sample: at most 2 * ranges * per_range + 64 keys
    on average, whatever the input."""
    rows = df.select(key.alias("k"), weight.cast("double").alias("w")).where("k is not null and w > 0")
    if total is None:
        total = rows.agg(F.sum("w")).first()[0] or 0
    if not total:
        return [], {}
    wanted = ranges * per_range
    chance = (F.xxhash64("k", "w", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).alias("u")
    drawn = rows.select("k", F.floor(F.col("w") * F.lit(wanted / total) + chance).cast("int").alias("n")).where("n > 0")
    got = sorted((r.k, r.n) for r in drawn.groupBy("k").agg(F.sum("n").alias("n")).collect())
    mass, out, seen, heavy = sum(n for _, n in got), [], 0, {}
    for k, n in got:
        before, seen = seen * ranges // mass, seen + n
        if seen * ranges // mass > before:
            if n * ranges > mass:
                out.append(k)  # a heavy key starts a range of its own
                heavy[k] = -(-n * ranges // mass)
            out.append(k + 1)
    top = 2**63 - 1
    bounds = sorted({b for b in out if b <= top})
    return bounds, {bisect.bisect_right(bounds, k): n for k, n in heavy.items()}


def sample_boundaries(df: DataFrame, key: Column, weight: Column, ranges: int, per_range: int = 24, seed: int = 17, total: int | None = None) -> list[int]:
    """The boundaries alone."""
    return sample_splitters(df, key, weight, ranges, per_range, seed, total)[0]


def range_of(key: Column, boundaries: list[int]) -> Column:
    """The number of boundaries <= key. A table of cells over the span of the boundaries gives the first boundary worth
    comparing; only those within the key's own cell are compared, so the cost does not grow with their number."""
    if not boundaries:
        return F.lit(0)
    low, high, cells = boundaries[0], boundaries[-1], min(CELLS, 2 * len(boundaries))
    width = (high - low) // cells + 1
    first, count, at = [], [], 0
    for c in range(cells):
        first.append(at)
        start = at
        while at < len(boundaries) and boundaries[at] < low + (c + 1) * width:
            at += 1
        count.append(at - start)
    # decimals are not needed: the distance to low is taken in halves, which cannot overflow
    half = F.shiftright(key, 1) - F.lit(low >> 1)
    cell = F.greatest(F.lit(0.0), F.least(F.lit(cells - 1.0), half / F.lit(max(width / 2, 0.5)))).cast("int")
    # rounding may put a key one cell off: compare from the cell before to the cell after
    before = F.greatest(cell - 1, F.lit(0))
    start = F.get(literal_array(first, "int"), before)
    stop_cell = F.least(cell + 1, F.lit(cells - 1))
    stop = F.get(literal_array([f + n for f, n in zip(first, count)], "int"), stop_cell)
    near = F.slice(literal_array(boundaries, "bigint"), start + 1, stop - start)
    return start + F.size(F.filter(near, lambda b: b <= key))
