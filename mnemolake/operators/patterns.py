"""Clusters of like memories and the patterns made of them.

Pairs come from block products (retrieval.neighbours), distributed. The greedy fold over them runs on an input that its limit
bounds (the newest 500 memories); capped walks (walks.py) go over all memories in rounds of joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.columns import active
from .metrics import top_words
from .retrieval import _block_pairs, neighbours
from .walks import capped_walks


def greedy_clusters(memories: DataFrame, threshold: float, newest: int = 500) -> DataFrame:
    """cluster (the seed), id: walks memories from the newest; each not yet taken seeds a cluster of all not yet taken that
    are as like to the seed as the threshold. Clusters of one are dropped."""
    rows = memories.where(active() & F.col("embedding").isNotNull()).orderBy(F.desc("created_at"), "id").limit(newest)
    rank = rows.select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("created_at"), "id")).alias("rank"))
    pairs = _block_pairs(rows.select("id", "embedding"), threshold, newest, inclusive=True)
    named = pairs.join(rank.withColumnRenamed("rank", "ra"), "id").join(rank.select(F.col("id").alias("other"), F.col("rank").alias("rb")), "other").where("ra < rb")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for r in pdf.sort_values(["ra", "rb"]).itertuples():
            near.setdefault(r.id, []).append(r.other)
        taken, out = set(), []
        for seed in pdf.sort_values("ra").id.drop_duplicates():
            if seed not in taken and (own := [x for x in near[seed] if x not in taken]):
                out += [(seed, x) for x in [seed, *own]]
                taken |= {seed, *own}
        return pd.DataFrame(out, columns=["cluster", "id"])

    return named.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fold, "cluster string, id string")


def components(memories: DataFrame, threshold: float, most: int = 7) -> DataFrame:
    """cluster, id: breadth first from the newest over each memory's nearest ten, cut at `most` members; clusters of one are
    dropped. A cluster's members are all that is ever gathered."""
    near = neighbours(memories, threshold)
    newest = memories.where(active()).select("id", (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("order"))
    walks = capped_walks(near, newest, most).where(F.size("own") > 1)
    return walks.select(F.col("id").alias("cluster"), F.explode("own").alias("id"))


def describe(clusters: DataFrame, memories: DataFrame) -> DataFrame:
    """cluster, pattern_key, n, impact, representative (highest importance), latest."""
    rows = clusters.join(memories, "id")
    text = F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("id", F.left("content", F.lit(200)).alias("t")))), lambda x: x.t))
    agg = rows.groupBy("cluster").agg(
        F.count("*").alias("n"), F.avg(F.coalesce("importance", F.lit(5))).alias("mean"), text.alias("text"), F.max_by("id", F.struct("importance", "id")).alias("representative"), F.max_by("id", F.struct("created_at", "id")).alias("latest"),
    )
    words = top_words(agg, "cluster", "text", rules.STOP_WORDS).groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x.word), "-").alias("words"))
    key = F.left(F.concat_ws("-", rules.theme(F.col("text")), F.col("words")), F.lit(60))
    return agg.join(words, "cluster", "left").select("cluster", key.alias("pattern_key"), "n", F.round(F.col("mean") * F.log2(F.col("n") + 1), 2).alias("impact"), "representative", "latest")


def merge_cluster(texts: list[tuple[str, int, str]], cap: int = 5000) -> str:
    """One text of (id, importance, content): the most important, then longest, and from the others each sentence of 10
    characters or more that shares at most 0.6 of its words with every sentence so far."""
    import re

    split = lambda t: [s.strip() for s in re.split(r"[.!?\n]+", t) if s.strip()]
    own = sorted(texts, key=lambda x: (-x[1], -len(x[2]), x[0]))
    out, seen = own[0][2], [set(s.lower().split()) for s in split(own[0][2])]
    for _, _, text in own[1:]:
        for s in split(text):
            words = set(s.lower().split())
            if len(s) >= 10 and all(len(words & w) / max(len(words), 1) <= 0.6 for w in seen):
                out, seen = f"{out}\n{s}.", [*seen, words]
    return out[:cap]


def consolidate(clusters: DataFrame, memories: DataFrame) -> DataFrame:
    """cluster, content, tier (the best), importance and confidence (largest), tags (all), members: one merged memory each.
    Clusters are bounded, so a group fits a task."""
    rows = clusters.join(memories, "id").select("cluster", "id", "content", "tier", "importance", "confidence_score", "tags")
    order = {"hot": 0, "warm": 1, "cold": 2, "archive": 3}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        text = merge_cluster(list(zip(pdf.id, pdf.importance, pdf.content, strict=True)))
        tags = list(dict.fromkeys(t for ts in pdf.tags for t in ts))
        best = min(pdf.tier, key=lambda t: order.get(t, 4))
        return pd.DataFrame([(pdf.cluster.iloc[0], text, best, int(pdf.importance.max()), pdf.confidence_score.max(), tags, len(pdf))], columns=["cluster", "content", "tier", "importance", "confidence_score", "tags", "members"])

    return rows.groupBy("cluster").applyInPandas(one, "cluster string, content string, tier string, importance int, confidence_score double, tags array<string>, members int")
