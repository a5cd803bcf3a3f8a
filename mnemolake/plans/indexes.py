"""Queries: approximate neighbours from an inverted file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ivf, retrieval
from ..sources.stages import new_path
from .registry import query

CELLS = 64


def _indexed(t):
    rows = t.memories.where("superseded_by is null and embedding is not null").select("id", "embedding")
    return rows, ivf.build(rows, new_path(t.spark, "ivf"), CELLS)


def _asked(rows):
    return rows.where(F.col("id").cast("long") % 50 == 0)


@query("r20_approximate")
def _(t):
    rows, index = _indexed(t)
    return ivf.nearest_others(_asked(rows), index, 10, ivf.tuned_probes(rows, index)).select("id", "rank", "other", F.round("similarity", 4).alias("similarity"))


@query("r20_recall")
def _(t):
    rows, index = _indexed(t)
    probes = ivf.tuned_probes(rows, index)
    return ivf.recall(ivf.nearest(_asked(rows), index, 10, probes), retrieval.nearest(_asked(rows), rows, 10)).select(F.lit(len(index.centroids)).alias("cells"), F.lit(probes).alias("probes"), "recall")


@query("r20_all_cells", """with m as (select id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from memories where superseded_by is null and embedding is not null),
 s as (select a.id, b.id as other, round(list_dot_product(a.e, b.e) / (a.n * b.n), 9) as s from m a join m b on a.id <> b.id where a.id::bigint % 50 = 0),
 r as (select id, other, s, cast(row_number() over (partition by id order by s desc, other) as integer) as rank from s)
 select id, rank, other, round(s, 4) as similarity from r where rank <= 10""")
def _(t):
    rows, index = _indexed(t)
    return ivf.nearest_others(_asked(rows), index, 10, CELLS).select("id", "rank", "other", F.round("similarity", 4).alias("similarity"))
