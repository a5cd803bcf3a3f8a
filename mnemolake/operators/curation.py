"""Duplicates, lifecycle, scoring and repair. Functions return a diff (id, what changes); merge.apply_diff applies one, and
not applying it is the dry run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.columns import active, add_tag, content_key


def duplicate_groups(memories: DataFrame) -> DataFrame:
    """key, n, keep: groups of equal type, content, context and agent; the oldest is kept."""
    key = content_key(*(F.col(c) for c in ("type", "content", "context", "agent")))
    return memories.where(active()).groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min_by("id", F.struct("created_at", "id")).alias("keep")).where(F.col("n") > 1)


def supersede_duplicates(memories: DataFrame) -> DataFrame:
    """id, superseded_by, tags of every copy but the oldest. The oldest comes from an aggregate that combines before the
    shuffle, not from a window over the group, so a very large group costs no more than its rows."""
    rows = memories.where(active()).withColumn("key", content_key(*(F.col(c) for c in ("type", "content", "context", "agent"))))
    groups = duplicate_groups(memories).select("key", "keep")
    return rows.join(groups, "key").where(F.col("id") != F.col("keep")).select("id", F.col("keep").alias("superseded_by"), add_tag(F.col("tags"), F.lit("dedup_superseded")).alias("tags"))


def promote(memories: DataFrame, as_of: Column, recurrence: int = 3, days: int = 30) -> DataFrame:
    fresh = F.col("status").isin("pending", "in_progress") & (F.col("recurrence_count") >= recurrence) & (F.col("last_seen") >= as_of - F.make_dt_interval(F.lit(days)))
    return memories.where(fresh).select("id", F.lit("promoted").alias("status"))


def degrade(memories: DataFrame, as_of: Column, days: int = 45) -> DataFrame:
    """Runs on what promote left. Only rows whose status changes."""
    old = memories.where(F.col("last_seen") < as_of - F.make_dt_interval(F.lit(days)))
    new = F.when((F.col("importance") <= 3) & (F.col("access_count") <= 1), "wont_fix").otherwise("pending")
    return old.where(F.col("status").isin("pending", "in_progress")).select("id", "status", new.alias("new_status"))


def low_signal(memories: DataFrame, max_length: int = 12, tier: str = "cold", importance: int = 2) -> DataFrame:
    short = active() & (F.length(F.coalesce("content", F.lit(""))) <= max_length) & F.col("type").isin("decision", "action", "learning", "note")
    return memories.where(short).select("id", F.lit(tier).alias("tier"), F.least(F.col("importance"), F.lit(importance)).alias("importance"), add_tag(F.col("tags"), F.lit("low_signal")).alias("tags"))


def expire(memories: DataFrame, as_of: Column) -> DataFrame:
    return memories.where(active() & (F.col("expires_at") < as_of)).select("id", F.lit("archive").alias("tier"), F.lit("expired").alias("superseded_by"))


def stale_tiers(memories: DataFrame, as_of: Column, hot_days: int = 60, warm_days: int = 90) -> DataFrame:
    """hot to warm, then warm to cold; a hot row falls through to cold in one run only if some warm row was stale already."""
    touched = F.coalesce("last_accessed", "created_at")
    old = lambda d: touched < as_of - F.make_dt_interval(F.lit(d))
    rows = memories.where(active())
    any_warm = rows.where((F.col("tier") == "warm") & old(warm_days)).select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias("any"))
    flag = any_warm.scalar()
    new = F.when((F.col("tier") == "hot") & old(warm_days) & flag, "cold").when((F.col("tier") == "hot") & old(hot_days), "warm").when((F.col("tier") == "warm") & old(warm_days), "cold")
    return rows.select("id", F.col("tier").alias("old_tier"), new.alias("tier")).where(F.col("tier").isNotNull())


def backfill_source(memories: DataFrame, kind: str = "markdown_import") -> DataFrame:
    return memories.where(active() & F.col("source_kind").isNull()).select("id", F.lit(kind).alias("source_kind"))


def reclassify(memories: DataFrame) -> DataFrame:
    got = rules.category(F.col("content"), F.col("type"))
    return memories.where(active()).select(
        "id", F.coalesce("category", got.getField("category")).alias("category"), rules.importance(F.col("content"), F.col("tier"), F.col("access_count")).alias("importance"),
        F.when(F.col("status") == "pending", "promoted").otherwise(F.col("status")).alias("status"), got.getField("type").alias("type_hint"),
    )


def quality(memories: DataFrame, as_of: Column, known_paths: DataFrame | None = None, n: int = 50) -> DataFrame:
    """Score, action, new tier and importance of the n most used active memories. known_paths (path) says which absolute
    paths exist; without it none counts as missing."""
    rows = memories.where(active()).orderBy(F.desc_nulls_last("access_count"), "id").limit(n)
    missing = None
    if known_paths is not None:
        paths = rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?:^|\s)(/[\w./-]+)"), F.lit(1)))).alias("path"))
        lost = paths.join(known_paths, "path", "left_anti").groupBy("id").agg(F.count("*").alias("missing"))
        rows = rows.join(lost, "id", "left")
        missing = F.coalesce("missing", F.lit(0))
    rows = rows.withColumn("score", rules.quality_score(as_of, missing))
    act = rules.quality_action(F.col("score"))
    return rows.select("id", "score", act.getField("action").alias("action"), act.getField("tier").alias("new_tier"), act.getField("importance").alias("new_importance"))


def cross_agent(memories: DataFrame, as_of: Column, days: int = 14, candidates: int = 30, most: int = 20) -> DataFrame:
    """Strong recent memories of any agent that get the cross-agent tag."""
    strong = (F.col("type").isin("learning", "gotcha") & (F.col("importance") >= 7)) | (F.col("type").isin("decision", "fact") & (F.col("importance") >= 8))
    rows = memories.where(active() & strong & F.col("agent").isNotNull() & (F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))) & ~F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "cross-agent"))
    best = rows.orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(candidates)
    return best.orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(most).select("id", add_tag(F.col("tags"), F.lit("cross-agent")).alias("tags"))


def feedback(memories: DataFrame, events: DataFrame) -> DataFrame:
    """events (id, verdict): useful +1 (importance to 10), useless -1 (to 1), incorrect supersedes and costs 5."""
    total = events.groupBy("id").agg(F.count_if(F.col("verdict") == "useful").alias("up"), F.count_if(F.col("verdict") == "useless").alias("down"), F.count_if(F.col("verdict") == "incorrect").alias("bad"))
    change = F.col("up") - F.col("down")
    return memories.join(total, "id").select(
        "id", F.least(F.lit(10), F.greatest(F.lit(1), F.col("importance") + change)).cast("int").alias("importance"),
        (F.coalesce("feedback_score", F.lit(0)) + change - 5 * F.col("bad")).cast("int").alias("feedback_score"),
        F.when(F.col("bad") > 0, "feedback:incorrect").otherwise(F.col("superseded_by")).alias("superseded_by"),
    )


def contradictions(memories: DataFrame, threshold: float, n: int = 30, tier: str = "hot") -> DataFrame:
    """loser, keeper, similarity (and the pair's ranks ra, rb) among the n most used memories of a tier. The first pair that a memory loses counts."""
    from ..functions.vectors import cosine

    order = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("access_count"), F.desc_nulls_last("importance"), "id")
    top = memories.where(active() & (F.col("tier") == tier) & F.col("embedding").isNotNull()).orderBy(F.desc_nulls_last("access_count"), F.desc_nulls_last("importance"), "id").limit(n)
    top = top.select("id", "context", "content", "importance", "created_at", "embedding", F.length("content").alias("len"), F.row_number().over(order).alias("rank"))
    a, b = top.alias("a"), top.alias("b")
    c = F.col
    pairs = a.join(b, c("a.rank") < c("b.rank")).withColumn("similarity", cosine(c("a.embedding"), c("b.embedding"))).where(c("similarity") >= threshold)
    pairs = pairs.where(c("a.context").isNull() | c("b.context").isNull() | (c("a.context") == c("b.context")))
    same = F.abs(c("a.len") - c("b.len")) / F.greatest(c("a.len"), c("b.len"), F.lit(1)) < 0.10
    keep_a = F.when(same, c("a.importance") >= c("b.importance")).otherwise(c("a.len") > c("b.len"))
    judged = pairs.select(F.when(keep_a, c("b.id")).otherwise(c("a.id")).alias("loser"), F.when(keep_a, c("a.id")).otherwise(c("b.id")).alias("keeper"), "similarity", c("a.rank").alias("ra"), c("b.rank").alias("rb"))
    first = F.row_number().over(Window.partitionBy("loser").orderBy("ra", "rb"))
    return judged.withColumn("n", first).where("n = 1").select("loser", "keeper", F.round("similarity", 4).alias("similarity"), "ra", "rb")


def supersede_contradicted(memories: DataFrame, judged: DataFrame) -> DataFrame:
    """Diff of what contradictions judged: a loser is superseded by its keeper; a keeper gets its own tags, those of the last
    memory that lost to it, and a mark. A memory may be both."""
    none = F.array().cast("array<string>")
    lost = judged.select(F.col("loser").alias("id"), "keeper")
    tags = judged.join(memories.select(F.col("id").alias("loser"), F.col("tags").alias("more")), "loser")
    won = tags.groupBy(F.col("keeper").alias("id")).agg(F.max_by(F.coalesce("more", none), F.struct("ra", "rb")).alias("more"))
    both = memories.select("id", "superseded_by", "tags").join(lost.join(won, "id", "full"), "id")
    union = F.array_distinct(F.concat(F.coalesce("tags", none), "more", F.array(F.lit("dedup_contradiction"))))
    return both.select("id", F.coalesce("keeper", "superseded_by").alias("superseded_by"), F.when(F.col("more").isNotNull(), union).otherwise(F.col("tags")).alias("tags"))
