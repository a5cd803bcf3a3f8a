"""Counts, averages, dashboards, checks and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions.columns import active


def count_by(df: DataFrame, column: str, missing: str) -> DataFrame:
    """key, n; most first, then by key."""
    return df.groupBy(F.coalesce(column, F.lit(missing)).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")


def query_stats(log: DataFrame, since: Column) -> DataFrame:
    rows = log.where(F.col("created_at") >= since)
    mean = lambda c, d: F.round(F.avg(c), d)
    return rows.groupBy("query_kind").agg(
        F.count("*").alias("n"), mean("duration_ms", 2).alias("avg_ms"), mean("results_count", 2).alias("avg_results"),
        mean("avg_similarity", 4).alias("avg_similarity"), mean("top_similarity", 4).alias("avg_top"),
    )


def cycle_totals(cycles: DataFrame) -> DataFrame:
    by = lambda s: F.count_if(F.col("status") == s).alias(s)
    return cycles.agg(F.count("*").alias("total"), by("predicted"), by("evaluated"), by("distilled"))


def cycles_by_tool(cycles: DataFrame) -> DataFrame:
    acc = F.col("accuracy")
    return cycles.where(acc.isNotNull()).groupBy("tool").agg(F.count("*").alias("n"), F.round(F.avg(acc), 3).alias("avg_accuracy"), F.count_if(acc >= 0.8).alias("accurate"), F.count_if(acc < 0.5).alias("wrong"))


def accuracy_spread(cycles: DataFrame) -> DataFrame:
    a = F.col("accuracy")
    return cycles.where(a.isNotNull()).agg(F.round(F.avg(a), 4).alias("mean"), F.round(F.stddev_samp(a), 4).alias("spread"), F.min(a).alias("least"), F.max(a).alias("most"))


def resync_patterns(memories: DataFrame) -> DataFrame:
    """Per pattern key: the largest recurrence, first and last time seen, and status and target of its latest memory. The
    order is encoded in the key so that a null of the latest row stays null."""
    latest = F.struct(F.coalesce(F.col("last_seen"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")), F.col("created_at"), F.col("id"))
    return memories.where(F.col("pattern_key").isNotNull()).groupBy("pattern_key").agg(
        F.max("recurrence_count").alias("recurrence_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max_by("status", latest).alias("last_status"), F.max_by("category", latest).alias("last_category"), F.max_by("promoted_to", latest).alias("promoted_to"),
    )


def top_patterns(patterns: DataFrame, n: int = 10) -> DataFrame:
    """The patterns that recur most; of equal ones those of more impact, then the latest."""
    return patterns.orderBy(F.desc("recurrence_count"), F.desc_nulls_last("impact_score"), F.desc("last_seen"), "pattern_key").limit(n)


def top_contexts(memories: DataFrame, n: int = 5) -> DataFrame:
    return memories.where(active()).groupBy(F.coalesce("context", F.lit("none")).alias("context")).agg(F.count("*").alias("n"), F.round(F.avg("importance"), 1).alias("avg_importance")).orderBy(F.desc("n"), "context").limit(n)


def daily_trend(log: DataFrame) -> DataFrame:
    day = F.date_format(F.date_trunc("day", F.col("created_at")), "yyyy-MM-dd").alias("day")
    return log.groupBy(day, "query_kind").agg(F.round(F.avg(F.coalesce("duration_ms", F.lit(0))), 2).alias("avg_ms"), F.count("*").alias("n"))


def alerts(log: DataFrame, as_of: Column, limits: dict[str, float], hours: int = 24) -> DataFrame:
    """Kinds whose average duration in the window reaches their limit."""
    recent = log.where((F.col("created_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col("created_at") < as_of))
    at = F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))))
    out = recent.groupBy("query_kind").agg(F.round(F.avg("duration_ms"), 2).alias("avg_ms"), F.count("*").alias("n"))
    return out.withColumn("threshold", at[F.col("query_kind")]).withColumn("alert", F.coalesce(F.col("avg_ms") >= F.col("threshold"), F.lit(False)))


def result_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("avg_similarity"), F.round(F.max("similarity"), 6).alias("top_similarity"))


def context_packs(memories: DataFrame, as_of: Column, days: int = 7, budget: int = 800, line: int = 200) -> DataFrame:
    """For each context (null or empty: unknown) of the hot and warm memories of the last days: how many, their mean
    importance, and a text: a heading and one line for each by importance, then age. A text beyond the budget ends with how many
    lines it leaves out, 20 characters being kept for that. A line has 7 characters at least, so no more than the budget's
    seventh of a context can enter its text: only those are gathered."""
    rows = memories.where(active() & F.col("tier").isin("hot", "warm") & (F.col("created_at") > as_of - F.make_dt_interval(F.lit(days))))
    rows = rows.withColumn("context", F.coalesce(F.when(F.col("context") != "", F.col("context")), F.lit("unknown")))
    text = F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), "\n", " "), r"^\s+|\s+$", "")
    short = F.when(F.char_length(text) > line, F.concat(F.left(text, F.lit(line - 1)), F.lit("…"))).otherwise(text)
    bullet = F.concat(F.lit("- ["), F.coalesce(F.when(F.col("type") != "", F.col("type")), F.lit("note")), F.lit("] "), short)
    order = Window.partitionBy("context").orderBy(F.desc("importance"), F.desc("created_at"), "id")
    first = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget // 7 + 1).select("context", "rank", bullet.alias("bullet"))
    lines = first.groupBy("context").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "bullet"))), lambda x: x["bullet"]).alias("lines"))
    counts = rows.groupBy("context").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("importance", F.lit(0))), 1).alias("avg_importance"))
    head = F.concat(F.lit("### "), "context", F.lit(" ("), F.col("n").cast("string"), F.format_string(" memories, avg importance %.1f)\n", "avg_importance"))
    packs = counts.join(lines, "context").withColumn("head", head)
    whole = F.concat("head", F.array_join("lines", "\n"))
    start = F.struct(F.char_length("head").alias("size"), F.lit(0).alias("shown"))
    # lines are taken up to the first that does not fit; sizes only grow, so none after it fits either
    grown = lambda acc, x: F.struct((acc["size"] + F.char_length(x) + 1).alias("size"), (acc["shown"] + (acc["size"] + F.char_length(x) + 1 <= budget - 20).cast("int")).alias("shown"))
    packs = packs.withColumn("shown", F.aggregate("lines", start, grown)["shown"])
    left_out = F.col("n") - F.array_position("lines", F.get("lines", F.col("shown"))) + 1
    part = F.concat("head", F.array_join(F.transform(F.slice("lines", F.lit(1), F.col("shown")), lambda x: F.concat(x, F.lit("\n"))), ""), F.lit("- ... (+"), left_out.cast("string"), F.lit(" more)"))
    return packs.select("context", "n", "avg_importance", F.when((F.char_length(whole) <= budget) & (F.size("lines") == F.col("n")), whole).otherwise(part).alias("pack"))


def top_words(texts: DataFrame, key: str, text: str, stop: tuple[str, ...], n: int = 2) -> DataFrame:
    """The most frequent words of more than 3 letters for each key; of equal ones the first in the alphabet."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-záéíóúñ\s]", " "), r"\s+")
    one = texts.select(key, F.explode(words).alias("word")).where((F.length("word") > 3) & ~F.col("word").isin(*stop))
    counts = one.groupBy(key, "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


# Checks of a memories table: name, severity when it finds rows, predicate over one row (or a join, below).
def doctor(memories: DataFrame, as_of: Column) -> DataFrame:
    """check, n, status (pass, warn or fail) in one scan, and the orphans' anti-join."""
    on = F.col("superseded_by").isNull()
    ago = lambda d: as_of - F.make_dt_interval(F.lit(d))
    counts = memories.agg(
        F.count_if(on & F.col("embedding").isNull()).alias("null_embeddings"),
        F.count_if(on & (F.col("expires_at") < as_of)).alias("expired_active"),
        F.count_if(on & F.col("tier").isin("hot", "warm") & (F.coalesce("last_accessed", "created_at") < ago(30))).alias("stale_hot_warm"),
        F.count_if(on & F.col("source_kind").isNull()).alias("missing_source_kind"),
        F.count_if(on & ~F.col("type").isin(*schemas.TYPES)).alias("bad_type"),
        F.greatest(F.count_distinct(F.size("embedding")) - 1, F.lit(0)).alias("mixed_dims"),
    )
    rows = counts.select(F.expr("stack(6, 'null_embeddings', null_embeddings, 'expired_active', expired_active, 'stale_hot_warm', stale_hot_warm, 'missing_source_kind', missing_source_kind, 'bad_type', bad_type, 'mixed_dims', mixed_dims) as (check, n)"))
    lost = orphans(memories).agg(F.count("*").alias("n")).select(F.lit("orphaned_supersede").alias("check"), "n")
    fails = F.col("check").isin("bad_type", "mixed_dims")
    return rows.union(lost).select("check", "n", F.when(F.col("n") == 0, "pass").when(fails, "fail").otherwise("warn").alias("status"))


def rollup(checks: DataFrame) -> DataFrame:
    by = lambda s: F.count_if(F.col("status") == s).alias(s)
    return checks.agg(F.count("*").alias("checks"), by("pass"), by("warn"), by("fail"))


def orphans(memories: DataFrame) -> DataFrame:
    """Rows superseded by an id that does not exist; the expiry mark is no id."""
    ids = memories.select(F.col("id").alias("superseded_by"))
    return memories.where(F.col("superseded_by").isNotNull() & (F.col("superseded_by") != "expired")).join(ids, "superseded_by", "left_anti")


def violations(memories: DataFrame) -> DataFrame:
    """id and broken rules of each row that breaks one."""
    rules = {
        "type": ~F.col("type").isin(*schemas.TYPES), "tier": ~F.col("tier").isin(*schemas.TIERS), "status": ~F.col("status").isin(*schemas.STATUSES),
        "importance": ~F.col("importance").between(1, 10), "recurrence": F.col("recurrence_count") < 1, "unaccessed": F.col("last_accessed").isNull() & (F.col("access_count") > 0),
    }
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return memories.select("id", F.array_join(broken, ",").alias("broken")).where(F.col("broken") != "")


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def freshness(memories: DataFrame, as_of: Column) -> DataFrame:
    hours = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.max("created_at").cast("timestamp"))) / 3600
    return memories.agg(F.round(hours, 2).alias("hours")).withColumn("status", F.when(F.col("hours") < 24, "ok").when(F.col("hours") < 72, "warn").otherwise("fail"))


def evaluate(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Over results (query_id, id, pattern_key, similarity, rank) and expected (query_id, keys): queries, hits at k, the hit
    rate over all queries, the mean top similarity and rows that repeat a key within a query."""
    top = results.where(F.col("rank") <= k).withColumn("key", F.coalesce("pattern_key", "id"))
    per = top.groupBy("query_id").agg(F.collect_set("key").alias("found"), F.collect_set("id").alias("ids"), F.max("similarity").alias("top"), (F.count("*") - F.count_distinct("key")).alias("repeats"))
    hit = F.coalesce(F.arrays_overlap("keys", "found") | F.arrays_overlap("keys", "ids"), F.lit(False))
    all_ = expected.join(per, "query_id", "left").select(hit.alias("hit"), "top", F.coalesce("repeats", F.lit(0)).alias("repeats"))
    return all_.agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / F.count("*"), 4).alias("hit_rate"), F.round(F.avg("top"), 4).alias("avg_top"), F.sum("repeats").alias("repeats"))
