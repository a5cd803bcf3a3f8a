"""What session messages yield: errors with their fixes, decisions, facts, snapshots, transcripts, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.columns import sha_prefix

def _order():
    return Window.partitionBy("session_id").orderBy("pos")


def error_fixes(messages: DataFrame, ahead: int = 5) -> DataFrame:
    """session_id, pos, error, fix: a runtime error of a tool or assistant and the first of the next messages that says it is
    fixed. Looks ahead by a bounded frame."""
    nxt = F.collect_list(F.struct(F.col("pos").alias("p"), F.left("text", F.lit(300)).alias("t"), rules.says_fixed(F.col("text")).alias("ok"))).over(_order().rowsBetween(1, ahead))
    rows = messages.withColumn("next", nxt)
    fix = F.get(F.filter("next", lambda x: x.ok), F.lit(0))
    bad = F.col("role").isin("tool", "assistant") & rules.runtime_error(F.col("text")) & fix.isNotNull()
    return rows.where(bad).select("session_id", "pos", F.left("text", F.lit(300)).alias("error"), fix.t.alias("fix"))


def decisions(messages: DataFrame) -> DataFrame:
    return messages.where(rules.decision(F.col("text"))).select("session_id", "pos", F.left("text", F.lit(500)).alias("content"))


def repeated_failures(messages: DataFrame, least: int = 3) -> DataFrame:
    """Fingerprints (first 50 characters of a tool's error, as a slug) that occur `least` times or more."""
    rows = messages.where((F.col("role") == "tool") & rules.runtime_error(F.col("text")))
    key = F.regexp_replace(F.lower(F.substring("text", 1, 50)), "[^a-z0-9]", "_")
    return rows.groupBy(key.alias("fingerprint")).agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions")).where(F.col("n") >= least)


def exit_failures(messages: DataFrame) -> DataFrame:
    """Tool results that ended badly (exit_code) or that show an error message (error_pattern; one result may be both), each
    type and command (or message, or else beginning) once, the earliest."""
    text = F.col("text")
    snippet = F.trim(F.regexp_replace(F.substring("text", 1, 300), r"\s+", " "))
    rows = messages.where(F.col("role") == "tool").select("session_id", "pos", rules.exit_failure(text).alias("e"), rules.error_message(text).alias("message"), snippet.alias("snippet"))
    kind = lambda name, what, code: F.struct(F.lit(name).alias("type"), what.alias("what"), code.alias("code"))
    ended = F.when(F.col("e").isNotNull(), kind("exit_code", F.col("e.command"), F.col("e.code")))
    shown = F.when(F.col("message").isNotNull(), kind("error_pattern", F.col("message"), F.lit(None).cast("int")))
    rows = rows.select("session_id", "pos", "snippet", F.explode(F.array_compact(F.array(ended, shown))).alias("x"))
    key = F.concat_ws("|", "x.type", F.coalesce("x.what", F.left("snippet", F.lit(80))))
    first = F.min(F.struct("session_id", "pos")).alias("at")
    return rows.groupBy(key.alias("key")).agg(first, F.count("*").alias("n"), F.min("x.code").alias("code")).select("key", "at.session_id", "at.pos", "n", "code")


def facts(messages: DataFrame) -> DataFrame:
    return messages.select("session_id", "pos", F.explode(rules.facts(F.col("text"))).alias("f")).select("session_id", "pos", "f.*")


def new_facts(found: DataFrame, known: DataFrame) -> DataFrame:
    """Facts whose normalised key (first of equal ones) is not known yet."""
    key = sha_prefix(F.lower(F.regexp_replace("content", r"\s+", " ")), 20)
    rows = found.withColumn("key", key).groupBy("key").agg(F.min("content").alias("content"))
    return rows.join(known.select(key.alias("key")).distinct(), "key", "left_anti")


def first_seen(rows: DataFrame, text: str = "text", order: tuple = ("session_id", "pos"), prefix: int = 500) -> DataFrame:
    """The first row of each text (by its first characters), through a combining aggregate."""
    key = sha_prefix(F.substring(text, 1, prefix), 16)
    return rows.groupBy(key.alias("key")).agg(F.min(F.struct(*order)).alias("at"), F.count("*").alias("n")).select("key", "at.*", "n")


def snapshots(messages: DataFrame) -> DataFrame:
    """Per session: bounds, turns, errors, blockers, last text and status."""
    err = F.col("text").rlike(r"(?:error|Error|ERROR|fail|FAIL|exception|Exception)[:\s].{10,120}")
    blocked = F.col("text").rlike("(?i)block(?:ed|er|ing)|can'?t proceed|stuck|waiting for")
    talk = F.col("role").isin("user", "assistant")
    agg = messages.groupBy("session_id").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count_if(talk).alias("turns"), F.count_if(err).alias("errors"), F.count_if(blocked & talk).alias("blockers"),
        F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("pos"))).alias("last_text"),
    )
    return agg.select("session_id", "session_start", "session_end", "turns", "errors", "blockers", rules.session_status(F.col("blockers"), F.col("errors"), F.col("turns"), F.col("last_text")).alias("status"))


def transcripts(messages: DataFrame, cap: int = 1500, budget: int = 12000) -> DataFrame:
    """Per session: how many messages, each cut at cap, fit the budget before the first that does not, and their length."""
    size = F.least(F.length("text"), F.lit(cap))
    rows = messages.select("session_id", "pos", size.alias("size")).withColumn("total", F.sum("size").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("total") <= budget).groupBy("session_id").agg(F.count("*").alias("messages"), F.max("total").alias("chars"))


def candidates(messages: DataFrame, agent: Column, n: int = 200) -> DataFrame:
    """Assistant and user messages as candidate memories: classified, deduped by their beginning, best by importance then
    type priority (a decision's 0 counts as none and sorts last, as 9)."""
    got = rules.session_message(F.col("text"))
    rows = messages.where(F.col("role").isin("assistant", "user") & (F.length("text") >= 120)).select("session_id", "pos", "text", got.alias("g")).where("g is not null")
    one = rows.withColumn("key", sha_prefix(F.substring("text", 1, 500), 16))
    one = one.groupBy("key").agg(F.min_by(F.struct("session_id", "pos", "text", "g"), F.struct("session_id", "pos")).alias("r")).select("key", "r.*")
    priority = F.when(F.col("g.type") == "gotcha", 1).when(F.col("g.type") == "learning", 2).when(F.col("g.type") == "note", 3).otherwise(9)
    best = one.orderBy(F.desc("g.importance"), priority, "key").limit(n)
    return best.select(
        F.concat(F.lit("m_"), F.col("key")).alias("id"), F.col("g.type").alias("type"), F.left("text", F.lit(1500)).alias("content"), F.concat(F.lit("agent:"), agent).alias("context"),
        F.when(F.col("g.importance") >= 7, "hot").otherwise("warm").alias("tier"), F.col("g.importance").alias("importance"), F.col("g.category").alias("category"),
        F.array(F.lit("auto-harvested"), F.concat(F.lit("session:"), F.left("session_id", F.lit(8)))).alias("tags"),
    )


def long_sessions(messages: DataFrame, least: int = 20) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "tool").alias("tool_calls")).where(F.col("messages") >= least)
