"""Session files distilled into memories, each file exactly once.

Every batch of new files is one commit of numbered snapshots (sources/snapshots.py): memories, the ledger of files, and which
batch of which stream it was, published together. A batch that runs again after its commit changes nothing; one that was lost
before its commit has changed nothing yet. The ledger also keeps a file from a second stream, or from one whose checkpoint was
lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import rules
from ..functions.vectors import Embedder, embed_column
from ..operators import adapters, ingest, sessions
from ..sources.discovery import AGENT, _plain, cut_lines
from ..sources.readers import ENTRY, SKIPPED_AGENTS, flatten_text
from ..sources.snapshots import Snapshots, compact
from ..sources.stages import staged

#: Events that a session must have to be worth distilling; shorter ones are not logged, so that they are looked at again.
LEAST_EVENTS = 5
LEDGER = "path string, memories_created int, memories_skipped int, processed_at timestamp_ntz"


def events(lines: DataFrame) -> DataFrame:
    """path, agent, session_id, pos, type, role, text, cwd, custom_type of lines (path, agent, session_id, pos, line) that are JSON
    objects; others are dropped. text is null for what is no message."""
    rows = lines.where(F.expr("try_parse_json(line)").isNotNull() & F.startswith(F.ltrim("line"), F.lit("{"))).withColumn("e", F.from_json("line", ENTRY)).where("e is not null")
    inner = F.from_json("e.message", "role string, content string")
    plain = F.when(~F.startswith(F.ltrim("e.message"), F.lit("{")), F.col("e.message"))
    text = F.when((F.col("e.type") == "message") & F.col("e.message").isNotNull(), F.coalesce(flatten_text(inner.content, " "), plain, F.lit("")))
    return rows.select("path", "agent", "session_id", "pos", "e.type", F.coalesce("e.role", inner.role).alias("role"), text.alias("text"), "e.cwd", F.col("e.customType").alias("custom_type"))


def findings(found: DataFrame) -> DataFrame:
    """session_file, agent, kind, content, importance of what sessions (events) hold: errors with their fix, decisions, failures that
    repeat within a session, and a note of each long session. Texts are cut before anything is gathered."""
    talk = found.where("text is not null").withColumnRenamed("session_id", "name").withColumn("session_id", F.col("path"))
    agent = found.groupBy(F.col("path").alias("session_id")).agg(F.min("agent").alias("agent"))
    # The words of a finding and its importance.
    short = talk.where(F.length("text") <= 2000)
    fixes = sessions.error_fixes(talk).where(F.length("error") > 0).select("session_id", F.lit("error_fix").alias("kind"), F.concat(F.lit("Error: "), "error", F.lit("\nFix: "), "fix").alias("content"), F.lit(7).alias("importance"))
    chosen = sessions.decisions(talk).select("session_id", F.lit("decision").alias("kind"), "content", F.lit(6).alias("importance"))
    key = F.regexp_replace(F.lower(F.substring("text", 1, 50)), "[^a-z0-9]", "_")
    again = short.where((F.col("role") == "tool") & rules.runtime_error(F.col("text"))).groupBy("session_id", key.alias("key")).agg(F.count("*").alias("n")).where("n >= 3")
    again = again.select("session_id", F.lit("repeated_failure").alias("kind"), F.concat(F.lit("Repeated failure (×"), F.col("n").cast("string"), F.lit("): "), F.left(F.translate("key", "_", " "), F.lit(100))).alias("content"), F.lit(6).alias("importance"))
    tool = ((F.col("type") == "custom") & (F.col("custom_type") == "tool_call")) | ((F.col("type") == "message") & (F.col("role") == "tool"))
    size = found.groupBy(F.col("path").alias("session_id")).agg(F.count_if(F.col("type") == "message").alias("turns"), F.count_if(F.coalesce(tool, F.lit(False))).alias("calls"), F.min_by("cwd", F.when(F.col("type") == "session", F.col("pos"))).alias("cwd"))
    where = F.when(F.coalesce("cwd", F.lit("")) == "", "unknown dir").otherwise(F.col("cwd"))
    long_ = size.where("turns >= 20").select("session_id", F.lit("complex_session").alias("kind"), F.concat(F.lit("Complex session ("), F.col("turns").cast("string"), F.lit(" turns, "), F.col("calls").cast("string"), F.lit(" tool calls) in "), where, F.lit(". File: "), F.regexp_extract("session_id", "([^/]+)$", 1)).alias("content"), F.lit(5).alias("importance"))
    every = fixes.unionByName(chosen).unionByName(again).unionByName(long_)
    return every.join(agent, "session_id").select(F.col("session_id").alias("session_file"), "agent", "kind", "content", "importance")


def distil(lines: DataFrame, memories: DataFrame, ledger: DataFrame, as_of: Column, embedder: Embedder, threshold: float = 0.92) -> tuple[DataFrame, DataFrame] | None:
    """The new snapshot of memories, and the ledger's new rows (None: no new sessions), for the sessions in lines that the ledger does not name and that have
    enough events. A finding that is as like as the threshold to an active memory, or to one found before it (by id), is skipped."""
    fresh = events(lines.join(ledger.select("path").distinct(), "path", "left_anti"))
    enough = fresh.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_EVENTS).select("path")
    known = staged(fresh.join(enough, "path", "left_semi"), "events")
    if known.isEmpty():
        return None
    made = adapters.from_distilled(findings(known)).dropDuplicates(["id"]).withColumn("created_at", as_of)
    made = staged(made.withColumn("embedding", embed_column(embedder)("content")), "findings")
    told = staged(ingest.novel(made, memories, as_of, threshold), "novel")
    stored = ingest.store_all(told.where("twin is null").drop("twin", "embedding"), memories, as_of, embedder=embedder)
    out = told.select("id", F.col("source_path").alias("path"), "twin").join(stored.outcomes.select(F.col("cand_id").alias("id"), "reason"), "id", "left")
    left_out = F.col("twin").isNotNull() | F.col("reason").isNotNull()
    counts = out.groupBy("path").agg(F.count_if(~left_out).cast("int").alias("memories_created"), F.count_if(left_out).cast("int").alias("memories_skipped"))
    none = F.lit(0)
    rows = enough.join(counts, "path", "left").select("path", F.coalesce("memories_created", none).alias("memories_created"), F.coalesce("memories_skipped", none).alias("memories_skipped"), as_of.alias("processed_at"))
    return stored.memories, rows


class SessionSink:
    """What a stream of session files does with each batch."""

    def __init__(self, path: str, as_of: Column, embedder: Embedder, keep: int = 2):
        self.path, self.as_of, self.embedder, self.keep = path, as_of, embedder, keep

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        tables = Snapshots(spark, self.path)
        now = tables.latest()
        if now.info.get("done", {}).get(stream, -1) >= number:
            return  # this batch was committed before its checkpoint was
        memories, ledger = now.read(spark, "memories", schemas.MEMORIES), now.read(spark, "ledger", LEDGER)
        got = distil(cut_lines(batch), memories, ledger, self.as_of, self.embedder)
        replace, add = ({"memories": got[0]}, {"ledger": got[1]}) if got else ({}, {})
        tables.commit(now, replace, add, {"done": {**now.info.get("done", {}), stream: number}})
        tables.vacuum(self.keep)


def watch_sessions(spark: SparkSession, root: str, pattern: str = "*.jsonl", max_files: int = 1000, agent_pattern: str = AGENT) -> DataFrame:
    """New session files as they come, one row each: path, agent, session_id, modified, value."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(root)
    path = F.col("_metadata.file_path")
    rows = files.select(_plain(path).alias("path"), F.regexp_extract(path, agent_pattern, 1).alias("agent"), F.regexp_extract(path, r"/([^/]+)\.[^./]+$", 1).alias("session_id"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    return rows.where(~F.col("agent").isin(*SKIPPED_AGENTS))


def ledger_of(spark: SparkSession, path: str) -> DataFrame:
    return compact(Snapshots(spark, path).latest().read(spark, "ledger", LEDGER), "path", "processed_at")
