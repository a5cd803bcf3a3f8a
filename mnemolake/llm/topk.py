"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are sparse integer rows: a component is a term, its value a weight. Candidates are cut into blocks of bounded size,
each block inverted into postings (for every term, the places and weights of the vectors that have it). Queries come in
blocks too. For each pair of blocks, every term of a query scatters its weighted postings into that query's dense score
array; partition selection keeps each array's best k, and the best lists of all blocks are merged. This is the stated query
set against all rows, in blocks: both sides are packed into few rows first, and no pair of vectors is ever a row.

Ties go to the smaller vec_id. A query's own rows (those with its vec_id) are no candidates. Vectors that are null or hold a
null or non-finite component take no part, nor do rows without vec_id; vectors shorter than others lack the missing terms.
Repeated rows are candidates each; an id that repeats among the queries asks once, with the smallest of its vectors. An empty
table gives an empty result; other columns are ignored. Scaled components beyond a long count as its ends; scores are then
added up in Python's whole numbers, and those beyond a long are returned as its ends, ranked as such between blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table

QUERY_BLOCK, ROW_BLOCK = 1024, 4096
HITS = "query_id long, vec_id long, score long"


def _clean(vectors: DataFrame, scale: int) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (vec_id, v) as blocks of at most `size`, one row each: n, ids, terms in CSR form (ends, term numbers, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), size):
                b = whole.slice(at, size)
                lists = b.column(1)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                start = np.cumsum(sizes) - sizes
                terms = np.arange(len(values)) - np.repeat(start, sizes)
                row = np.repeat(np.arange(len(b)), sizes)
                keep = values != 0
                ends = np.cumsum(np.bincount(row[keep], minlength=len(b)))
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([len(b)], pa.int64()), "ids": pa.array([b.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary()),
                    "ends": pa.array([ends.astype(np.int64).tobytes()], pa.binary()), "terms": pa.array([terms[keep].astype(np.int32).tobytes()], pa.binary()),
                    "weights": pa.array([values[keep].astype(np.int64).tobytes()], pa.binary()),
                })

    blocks = rows.mapInArrow(run, "n long, ids binary, ends binary, terms binary, weights binary")
    return staged(blocks.withColumn("block", F.monotonically_increasing_id()), name)


def _unpack(b, side: str):
    read = lambda c, kind: np.frombuffer(b[f"{side}_{c}"], kind)
    return read("ids", np.int64), read("ends", np.int64), read("terms", np.int32), read("weights", np.int64)


def block_hits(query, rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of one block of candidates for each query of a block, ties to the smaller id."""
    (q_ids, q_ends, q_terms, q_weights), (ids, ends, terms, weights) = query, rows
    n = len(ids)
    by_id = np.argsort(ids, kind="stable")
    place = np.empty(n, np.int64)
    place[by_id] = np.arange(n)  # candidates in the order of their ids: ties by place
    ids = ids[by_id]
    n_terms = int(max(terms.max(initial=-1), q_terms.max(initial=-1))) + 1
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))  # noqa: E731  the least long has no absolute value
    largest = most(q_weights) * most(weights) * n_terms
    wide = largest * n >= 2**62  # no room in a long for a score and its ties
    kind = object if wide else np.int32 if largest < 2**31 else np.int64
    as_kind = int if wide else kind
    row = place[np.repeat(np.arange(n), np.diff(ends, prepend=0))]
    order = np.argsort(terms, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=n_terms))])
    postings: list[tuple[np.ndarray | None, np.ndarray]] = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        at, weight = row[order[lo:hi]], weights[order[lo:hi]].astype(kind)
        if 2 * len(at) > n:  # a term that most vectors have: its postings are laid out densely
            dense = np.zeros(n, kind)
            dense[at] = weight
            postings.append((None, dense))
        else:
            postings.append((at, weight))
    out_q, out_v, out_s = [], [], []
    score, part, down, start = np.zeros(n, kind), np.zeros(n, kind), n - 1 - np.arange(n), 0
    for q, end in zip(q_ids.tolist(), q_ends.tolist(), strict=True):
        score.fill(0)
        for t, w in zip(q_terms[start:end].tolist(), q_weights[start:end].tolist(), strict=True):
            at, weight = postings[t]
            if at is None:
                score += np.multiply(weight, as_kind(w), out=part)
            else:
                score[at] += weight * as_kind(w)
        start = end
        lo, hi = np.searchsorted(ids, [q, q + 1])  # the query's own rows
        if wide:
            bounded = [max(-(2**63), min(2**63 - 1, s)) for s in score.tolist()]
            best = np.array(heapq.nsmallest(k, (i for i in range(n) if not lo <= i < hi), key=lambda i: (-bounded[i], i)), np.int64)
            out_q.append(np.full(len(best), q))
            out_v.append(ids[best])
            out_s.append(np.array([bounded[i] for i in best], np.int64))
            continue
        rank = score.astype(np.int64) * n + down  # unique: by score, then by place
        rank[lo:hi] = np.iinfo(np.int64).min
        best = np.argpartition(rank, n - k)[n - k :] if n > k else np.arange(n)
        best = best[(best < lo) | (best >= hi)]
        out_q.append(np.full(len(best), q))
        out_v.append(ids[best])
        out_s.append(score[best].astype(np.int64))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(out_q), cat(out_v), cat(out_s)


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all other rows. Queries are the rows of vectors (vec_id,
    embedding) whose id is divisible by query_every."""
    rows = _clean(vectors, scale)
    asked = rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    q = _packed(asked, QUERY_BLOCK, "queries")
    c = _packed(rows, ROW_BLOCK, "rows")
    named = lambda df, side: df.select(*(F.col(x).alias(f"{side}_{x}") for x in df.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                hits = block_hits(_unpack(b, "q"), _unpack(b, "c"), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in hits], ["query_id", "vec_id", "score"])

    # blocks meet by number: each side names all block numbers of the other, so that pairs are dealt out evenly
    q_numbers, c_numbers = q.select(F.col("block").alias("q_block")), c.select(F.col("block").alias("c_block"))
    pairs = q_numbers.join(c_numbers, how="cross").repartition("q_block", "c_block")  # numbers only, one for each block
    met = pairs.join(named(q, "q"), "q_block").join(named(c, "c"), "c_block")
    hits = met.select(*(f"{s}_{x}" for s in "qc" for x in ("ids", "ends", "terms", "weights"))).mapInArrow(run, HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as w from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
) select query_id, rank, vec_id, score from r where rank <= 20
"""
