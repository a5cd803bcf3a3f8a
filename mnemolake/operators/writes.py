"""Changes to stored tables as rows: what to append, and diffs that merge.apply_diff or merge.merge put in. Nothing here writes
but `append`, whose failures do not stop its caller."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import OUTCOMES
from . import merge

# Statuses that end a memory's life.
ENDING = ("resolved", "promoted", "wont_fix")
SNAPSHOT_RULES = {c: merge.keep for c in ("project", "agent", "session_start")}
CLUSTER_RULES = {
    "recurrence_count": lambda old, new: old + new, "first_seen": merge.keep, "last_seen": merge.overwrite, "impact_score": merge.largest, "representative_memory_id": merge.keep,
    "last_memory_id": merge.overwrite, "last_category": merge.fill, "last_status": merge.fill, "promoted_to": merge.keep, "created_at": merge.keep,
}


def append(rows: DataFrame, path: str) -> bool:
    """Adds rows to a log; a log that cannot be written is no reason to fail."""
    try:
        rows.write.mode("append").parquet(path)
    except Exception:  # noqa: BLE001
        logging.getLogger(__name__).warning("log not written: %s", path, exc_info=True)
        return False
    return True


def query_events(events: DataFrame) -> DataFrame:
    """What the query log takes: events with a hash; the kind is a search where none is said."""
    return events.where(F.coalesce("query_hash", F.lit("")) != "").withColumn("query_kind", F.coalesce("query_kind", F.lit("search")))


def pilot_rows(injected: DataFrame, as_of: Column) -> DataFrame:
    """One row for each agent of injected (agent, own, content): its own memories, the team's, and their characters."""
    own = F.coalesce(F.col("own"), F.lit(False))
    return injected.groupBy("agent").agg(
        F.count_if(own).cast("int").alias("own_memories"), F.count_if(~own).cast("int").alias("team_memories"), F.sum(F.char_length(F.coalesce("content", F.lit("")))).cast("int").alias("total_chars")
    ).withColumn("injected_at", as_of)


def touched(memories: DataFrame, returned: DataFrame, as_of: Column) -> DataFrame:
    """Diff: memories that searches returned (id, once for each time) were accessed then, that many times more."""
    times = returned.where("id is not null").groupBy("id").agg(F.count("*").alias("times"))
    return memories.select("id", "access_count").join(times, "id").select("id", as_of.alias("last_accessed"), (F.coalesce("access_count", F.lit(0)) + F.col("times")).cast("int").alias("access_count"))


def resolved(memories: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Diff of memories by requests (at, id, pattern_key, status, resolved_at, promoted_to, resolution_notes): by id where one is
    given, else by key; of several the last. An ending status sets resolved_at where the request does not."""
    what = requests.where(F.col("status").isNotNull()).withColumn("resolved_at", F.coalesce("resolved_at", F.when(F.col("status").isin(*ENDING), as_of)))
    what = what.select("at", F.col("id").alias("by_id"), F.col("pattern_key").alias("by_key"), F.struct("at", "status", "resolved_at", "promoted_to", "resolution_notes").alias("x"))
    ids = what.where("by_id is not null").groupBy(F.col("by_id").alias("id")).agg(F.max("x").alias("x"))
    keys = what.where("by_id is null and by_key is not null").groupBy(F.col("by_key").alias("pattern_key")).agg(F.max("x").alias("y"))
    both = memories.select("id", "pattern_key", "resolved_at", "promoted_to", "resolution_notes").join(ids, "id", "left").join(keys, "pattern_key", "left")
    both = both.withColumn("z", F.greatest("x", "y")).where("z is not null")
    return both.select("id", "pattern_key", F.col("z.status").alias("status"), *(F.coalesce(f"z.{c}", c).alias(c) for c in ("resolved_at", "promoted_to", "resolution_notes")))


def resolved_patterns(patterns: DataFrame, diff: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Diff of patterns whose key was resolved, by itself or through one of its memories: the last request counts."""
    own = requests.where(F.col("status").isNotNull())
    by_key = own.where("id is null and pattern_key is not null").select("pattern_key", F.struct("at", "status", "promoted_to").alias("x"))
    by_id = own.where("id is not null").drop("pattern_key").join(diff.select("id", "pattern_key"), "id").where("pattern_key is not null").select("pattern_key", F.struct("at", "status", "promoted_to").alias("x"))
    last = by_key.union(by_id).groupBy("pattern_key").agg(F.max("x").alias("x"))
    return patterns.select("pattern_key", "promoted_to").join(last, "pattern_key").select("pattern_key", F.col("x.status").alias("last_status"), F.coalesce("x.promoted_to", "promoted_to").alias("promoted_to"), as_of.alias("updated_at"))


def without_embedding(memories: DataFrame, most: int = 20) -> DataFrame:
    """The newest memories that lack an embedding: as many as one repair makes anew."""
    return memories.where(F.col("embedding").isNull()).orderBy(F.desc("created_at"), "id").limit(most)


def cluster_rows(members: DataFrame, as_of: Column) -> DataFrame:
    """Pattern rows of clusters (pattern_key, id, importance, created_at, category, status, impact): merged into patterns by
    CLUSTER_RULES they add their size each time they are merged, so a second run counts again."""
    best, latest = F.struct(F.coalesce("importance", F.lit(5)), F.col("id")), F.struct("created_at", "id")
    return members.groupBy("pattern_key").agg(
        F.count("*").cast("int").alias("recurrence_count"), F.coalesce(F.max_by("created_at", best), as_of).alias("first_seen"), F.coalesce(F.max("created_at"), as_of).alias("last_seen"),
        F.max("impact").alias("impact_score"), F.max_by("id", best).alias("representative_memory_id"), F.max_by("id", latest).alias("last_memory_id"),
        F.max_by("category", latest).alias("last_category"), F.max_by("status", latest).alias("last_status"),
    )


def promoted(patterns: DataFrame, applied: DataFrame, as_of: Column) -> DataFrame:
    """Diff of patterns whose suggestions (id, pattern_key) were applied; the suggestions themselves get status promoted."""
    keys = applied.where("pattern_key is not null").select("pattern_key").distinct()
    return patterns.select("pattern_key").join(keys, "pattern_key").select("pattern_key", F.lit("auto").alias("promoted_to"), F.lit("promoted").alias("last_status"), as_of.alias("updated_at"))


def advised(advisories: DataFrame, feedback: DataFrame) -> DataFrame:
    """feedback (id, was_followed, outcome) with known: whether there is such an advisory; the known ones are the diff."""
    return feedback.join(advisories.select("id", "agent", "tool").withColumn("known", F.lit(True)), "id", "left").select("id", "agent", "tool", "was_followed", F.when(F.col("outcome") != "", F.col("outcome")).alias("outcome"), F.coalesce("known", F.lit(False)).alias("known"))


def trajectory_rows(found: DataFrame) -> DataFrame:
    """Trajectories to append: an unknown outcome is a success, steps that are none are an empty list."""
    return found.withColumns({"outcome": F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise("success"), "steps": F.coalesce("steps", F.from_json(F.lit("[]"), "array<struct<action: string, result: string>>"))})


def lifecycle(rows: DataFrame) -> DataFrame:
    """Blank lifecycle texts are null; a status that is not said is pending."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    out = rows.withColumn("status", F.coalesce(blank("status"), F.lit("pending")))
    return out.withColumns({c: blank(c) for c in ("category", "pattern_key", "promoted_to", "resolution_notes") if c in rows.columns})
