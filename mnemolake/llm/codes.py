"""Product codes of vectors: each part of a vector is replaced by the number of the nearest entry of that part's codebook.

The nearest entry is found by annular norm pruning. A codebook's entries are sorted by norm. An entry that is no farther from
a part than the best one so far must have a norm within that distance of the part's own (triangle inequality), so a binary
search on both sides gives the annulus of norms that can still matter, its borders included; its entries, and only these,
are measured exactly, in whole numbers. The best one so far comes from the entries next to the part's norm.

Codebooks are small (entries x width numbers) and go along with the tasks. A round is one pass over the rows: each task adds up
what it assigns to each entry, Spark adds the tasks' sums, and the driver divides them. Nothing is dropped or sampled.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as filled up with zeros to the
longest length, and all to a multiple of the number of parts. Scaled components beyond 2^22 are taken as 2^22 (likewise below),
so that squared distances stay whole numbers of 64 bits. Rows without vec_id are coded too, but come last where the first
entries are chosen; repeated rows count each, equal vec_ids there by their vectors. With fewer rows than entries a codebook is
that much smaller. A sum of errors beyond a long is null. An empty table gives no rows; other columns change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table
from .vectors import matrix, whole, widest

MOST, WIDEST_PART = 2**22, 256
#: Rows of a step, entries next to a part's norm that are looked at first, labels whose sums are broadcast.
STEP, PROBES, FEW_LABELS = 2048, (-2, -1, 0, 1), 50_000


class Codebook:
    """The entries of one part position, sorted by norm. entries: at most 256 rows of whole numbers."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries * entries).sum(1))
        self.order = np.lexsort((np.arange(len(entries)), norms))
        self.entries, self.norms = entries[self.order], norms[self.order]

    def annulus(self, norms: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From which to before which place entries can be as near as best (squared), for parts of these norms. Norms are
        rounded, so that the borders are set a little wider; entries beyond them are farther for certain."""
        reach = np.sqrt(best)
        reach = reach + 1e-9 * (reach + norms) + 1e-6
        return np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's nearest entry, ties to the lower one, and the squared distance."""
        norms = np.sqrt((x * x).sum(1))
        at, last = np.searchsorted(self.norms, norms), len(self.entries) - 1
        best = None
        for step in PROBES:
            d = ((x - self.entries[np.clip(at + step, 0, last)]) ** 2).sum(1)
            best = d if best is None else np.minimum(best, d)
        lo, hi = self.annulus(norms, best)
        count = hi - lo
        start = np.cumsum(count) - count
        row = np.repeat(np.arange(len(x)), count)
        entry = np.arange(len(row)) - np.repeat(start - lo, count)
        found = ((x[row] - self.entries[entry]) ** 2).sum(1) * 256 + self.order[entry]
        least = np.minimum.reduceat(found, start)
        return least & 255, least >> 8


def _steps(batches: Iterator[pa.RecordBatch], width: int, parts: int, books: list[Codebook]):
    """Batches in steps, each with the parts, their entries' numbers and squared distances."""
    for batch in batches:
        for at in range(0, len(batch), STEP):
            step = batch.slice(at, STEP)
            x = matrix(step.column(step.schema.get_field_index("x")), width).reshape(len(step), parts, -1)
            found = [book.nearest(x[:, p]) for p, book in enumerate(books)]
            yield step, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _updated(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the floor of the mean of the parts that it is nearest to; entries without parts stay."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for _, x, numbers, _ in _steps(batches, parts * size, parts, [Codebook(b) for b in books]):
            slots = (numbers + np.arange(parts) * entries).reshape(-1)
            np.add.at(sums, slots, x.reshape(-1, size))
            counts += np.bincount(slots, minlength=parts * entries)
        used = np.flatnonzero(counts)
        slot, place = np.repeat(used, size), np.tile(np.arange(size), len(used))
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int64()), "place": pa.array(place, pa.int64()), "total": pa.array(sums[used].reshape(-1), pa.int64()), "n": pa.array(counts[slot], pa.int64())})

    added = rows.select("x").mapInArrow(run, "slot long, place long, total long, n long").groupBy("slot", "place").agg(F.sum("total"), F.sum("n"))
    out = books.copy().reshape(parts * entries, size)
    for slot, place, total, n in added.collect():  # at most as many rows as the codebooks have numbers
        out[slot, place] = total // n
    return out.reshape(books.shape)


def product_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each usable row of vectors (vec_id, embedding, label)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    rows = whole(vectors, scale, MOST, F.col("vec_id").cast("long").alias("vec_id"), "label")
    longest = widest(rows)
    if longest is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    size = -(-longest // parts)
    width = size * parts
    if size > WIDEST_PART:
        raise ValueError(f"a part may have {WIDEST_PART} components")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()  # the first entries, no more
    start = matrix(pa.array([r.x for r in first], pa.list_(pa.int32())), width)
    books = np.ascontiguousarray(start.reshape(len(first), parts, size).transpose(1, 0, 2))
    for _ in range(rounds if size else 0):
        books = _updated(rows, books)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    hexed = np.array([f"{i:02x}" for i in range(256)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, _, numbers, distances in _steps(batches, width, parts, [Codebook(b) for b in books]):
            codes = ["".join(r) for r in hexed[numbers].tolist()]
            yield pa.RecordBatch.from_arrays([step.column(0), step.column(1), pa.array(codes, pa.string()), pa.array(distances.sum(1), pa.int64())], ["vec_id", "label", "code", "error"])

    kind = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = staged(rows.mapInArrow(code, kind), "codes")
    sums = staged(coded.groupBy(F.col("label").alias("of")).agg(F.expr("try_sum(error)").alias("label_error")), "label-errors")
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(table(spark, sf_dir, "embeddings"))


def _assigned(n: int, book: str) -> str:
    return f"""a{n} as (
  select p.row, p.part, min(cast(list_sum(list_transform(list_zip(p.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) * 256 + b.entry) as best
  from p join {book} b using (part) group by p.row, p.part
)"""


def _next_book(n: int) -> str:
    return f"""b{n + 1} as (
  select b.part, b.entry, coalesce(m.s, b.s) as s from b{n} b left join (
    select part, entry, list(mean order by place) as s from (
      select a.part, a.best & 255 as entry, d.place, cast(floor(sum(d.v) / count(*)) as bigint) as mean
      from a{n} a join d using (row, part) group by 1, 2, 3
    ) group by 1, 2
  ) m using (part, entry)
)"""


OP13_SQL = f"""
with k as (
  select row_number() over () as row, vec_id, label, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0
), p as (
  select row, vec_id, cast(part as bigint) as part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] as s from k, range(16) r(part)
), d as (
  select row, part, unnest(s) as v, generate_subscripts(s, 1) as place from p
), b0 as (
  select part, entry, s from (select part, s, row_number() over (partition by part order by vec_id) - 1 as entry from p) where entry < 64
), {_assigned(0, "b0")}, {_next_book(0)}, {_assigned(1, "b1")}, {_next_book(1)}, {_assigned(2, "b2")}, e as (
  select row, string_agg(printf('%02x', best & 255), '' order by part) as code, cast(sum(best >> 8) as bigint) as error from a2 group by row
), h as (
  select sha256(string_agg(cast(c as varchar), ',' order by part, entry, place)) as codebooks_sha256
  from (select part, entry, unnest(s) as c, generate_subscripts(s, 1) as place from b2)
) select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from k join e using (row), h
"""
