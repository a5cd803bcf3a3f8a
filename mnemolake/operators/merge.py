"""Upserts without a table format: a snapshot joined with changes, column by column; written whole and swapped in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import tier_impact

Resolver = Callable[[Column, Column], Column]
overwrite: Resolver = lambda old, new: new
fill: Resolver = lambda old, new: F.coalesce(new, old)
first: Resolver = lambda old, new: F.coalesce(old, new)
largest: Resolver = lambda old, new: F.greatest(old, new)
least: Resolver = lambda old, new: F.least(old, new)
keep: Resolver = lambda old, new: old


def merge(target: DataFrame, source: DataFrame, keys: list[str], resolvers: dict[str, Resolver], default: Resolver = overwrite) -> DataFrame:
    """target with source's rows merged by key: unmatched rows of either side stay as they are. Keys are unique in source."""
    t, s = target.alias("t"), source.withColumn("__new", F.lit(True)).alias("s")
    on = None
    for k in keys:
        c = F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
        on = c if on is None else on & c
    both = t.withColumn("__old", F.lit(True)).alias("t").join(s, on, "full_outer")
    out = []
    for c in target.columns:
        old, new = F.col(f"t.{c}"), F.col(f"s.{c}") if c in source.columns else None
        if new is None:
            out.append(old.alias(c))
        elif c in keys:
            out.append(F.coalesce(old, new).alias(c))
        else:
            out.append(F.when(F.col("__old").isNull(), new).when(F.col("__new").isNull(), old).otherwise(resolvers.get(c, default)(old, new)).alias(c))
    return both.select(*out)


def apply_diff(target: DataFrame, diff: DataFrame, key: str = "id") -> DataFrame:
    """target with the diff's columns put in where it has a row. A diff that has both c and new_c tells c as it was and as it
    shall be: new_c is put in."""
    cols = [c for c in target.columns if c != key and (c in diff.columns or f"new_{c}" in diff.columns)]
    named = diff.select(key, *(F.col(f"new_{c}" if f"new_{c}" in diff.columns else c).alias(f"__{c}") for c in cols), F.lit(True).alias("__hit"))
    joined = target.join(named, key, "left")
    return joined.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in target.columns))


# How a stored memory takes a new version of itself: what is not named is overwritten.
MEMORY_RULES = {
    **{c: fill for c in ("pattern_key", "resolved_at", "promoted_to", "resolution_notes", "source_kind", "source_path", "confidence_score", "expires_at", "sensitivity")},
    "recurrence_count": largest, "last_seen": largest, "first_seen": least, "access_count": keep, "created_at": keep, "feedback_score": keep,
}
PATTERN_RULES = {
    "recurrence_count": largest, "first_seen": least, "last_seen": largest, "impact_score": largest, "representative_memory_id": first,
    "last_memory_id": overwrite, "last_category": fill, "last_status": fill, "promoted_to": fill, "created_at": keep,
}


def merge_plan(candidates: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """candidates (cand_id, pattern_key, recurrence_count, first_seen, last_seen) against the newest existing memory of their
    key: what id, recurrence and times they end up with."""
    newest = F.row_number().over(Window.partitionBy("pattern_key").orderBy(F.desc_nulls_last("last_seen"), "id"))
    old = existing.where(F.col("pattern_key").isNotNull()).withColumn("n", newest).where("n = 1").select("pattern_key", F.col("id").alias("old_id"), F.col("recurrence_count").alias("old_n"), F.col("first_seen").alias("old_first"))
    rows = candidates.join(old, "pattern_key", "left")
    found = F.col("old_id").isNotNull()
    return rows.select(
        "cand_id", found.alias("found"), F.coalesce("old_id", "cand_id").alias("final_id"),
        F.when(found, F.greatest(F.coalesce("old_n", F.lit(1)) + 1, F.coalesce("recurrence_count", F.lit(0)))).otherwise(F.coalesce("recurrence_count", F.lit(1))).alias("final_recurrence"),
        F.coalesce("first_seen", "old_first", now).alias("final_first"), F.coalesce("last_seen", now).alias("final_last"),
    )


def pattern_rows(memories: DataFrame) -> DataFrame:
    """What stored memories say of their patterns, one row a key."""
    latest = F.struct("last_seen", "id")
    return memories.where(F.col("pattern_key").isNotNull()).groupBy("pattern_key").agg(
        F.max("recurrence_count").alias("recurrence_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max(F.col("importance") * tier_impact(F.col("tier"))).alias("impact_score"), F.min("id").alias("representative_memory_id"),
        F.max_by("id", latest).alias("last_memory_id"), F.max_by("status", latest).alias("last_status"),
    )


def insert_absent(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of new whose key target lacks."""
    return new.join(target.select(key).distinct(), key, "left_anti")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot at path; one that a writer had set aside when it was lost is put back first."""
    jvm = spark._jvm
    old, now = (jvm.org.apache.hadoop.fs.Path(path + x) for x in (".old", ""))
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(now) and fs.exists(old):
        fs.rename(old, now)
    return spark.read.parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Writes beside the old snapshot, then swaps. Between the two renames there is only the one set aside, which
    read_snapshot finds; a lost writer's is put back before it could be deleted."""
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    new, old, now = (jvm.org.apache.hadoop.fs.Path(path + x) for x in (".new", ".old", ""))
    fs = now.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(now) and fs.exists(old):
        fs.rename(old, now)
    fs.delete(new, True)
    df.write.parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(now):
        fs.rename(now, old)
    fs.rename(new, now)
    fs.delete(old, True)
