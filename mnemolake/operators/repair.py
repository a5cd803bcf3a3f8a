"""The repair run: each step's diff, or the snapshot that applying them in order leaves; schema evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import curation, merge, metrics


def steps(memories: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Diffs by step, all against the table as it is: the dry run."""
    return {
        "expired": curation.expire(memories, as_of),
        "orphans": metrics.orphans(memories).select("id", F.lit(None).cast("string").alias("superseded_by")),
        "source_kind": curation.backfill_source(memories),
        "stale_tiers": curation.stale_tiers(memories, as_of).select("id", "tier"),
        "duplicates": curation.supersede_duplicates(memories),
    }


def counts(memories: DataFrame, as_of: Column) -> DataFrame:
    """step, n."""
    out = None
    for name, diff in steps(memories, as_of).items():
        n = diff.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
        out = n if out is None else out.union(n)
    return out


def run(memories: DataFrame, as_of: Column) -> DataFrame:
    """Each step sees what the one before left."""
    for name in list(steps(memories, as_of)):
        memories = merge.apply_diff(memories, steps(memories, as_of)[name])
    return memories


def evolve(df: DataFrame, ddl: str) -> DataFrame:
    """df with the columns that the schema has and it lacks, as nulls, in the schema's order; columns beyond it stay last."""
    fields = T.StructType.fromDDL(ddl).fields
    known = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    return df.select(*known, *(c for c in df.columns if c not in {f.name for f in fields}))
