"""Files as DataFrames: session logs, markdown, legacy JSON, evaluation sets. Paths and times come from file metadata."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import sha1_id

ENTRY = "type string, timestamp string, customType string, cwd string, role string, content string, message string"
SKIPPED_AGENTS = ("heartbeat", "monitor")
#: Texts that are no message worth keeping. Fixed values.
IDLE = ("NO_REPLY", "HEARTBEAT_OK")


def lines(spark: SparkSession, root: str, pattern: str = "*.jsonl", modified_after: str | None = None, min_bytes: int = 0, agent: str | None = None) -> DataFrame:
    """file, agent, session_id, line of every log under root/<agent>/sessions, by file time, size and agent."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    rows = reader.text(root).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("line"))
    rows = rows.where(F.col("size") > min_bytes).withColumns({"agent": F.regexp_extract("file", r"/([^/]+)/sessions/", 1), "session_id": F.regexp_extract("file", r"/([^/]+)\.[a-z]+$", 1)})
    rows = rows.where(~F.col("agent").isin(*SKIPPED_AGENTS))
    return rows.where(F.col("agent") == agent) if agent else rows


def entries(rows: DataFrame) -> DataFrame:
    """Log lines parsed; those that are no JSON object are dropped."""
    e = F.from_json("line", ENTRY)
    return rows.where(F.expr("try_parse_json(line)").isNotNull() & F.startswith(F.ltrim("line"), F.lit("{"))).withColumn("e", e).where("e is not null").select("file", "agent", "session_id", "e.*")


def flatten_text(content: Column, joint: str = "\n") -> Column:
    """Content that is a string, or a list of blocks of which the texts count."""
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    texts = F.filter(F.transform(blocks, lambda b: F.when(F.coalesce(b.type, F.lit("text")) == "text", b.text)), lambda t: t.isNotNull())
    return F.when(F.startswith(F.ltrim(content), F.lit("[")) & blocks.isNotNull(), F.array_join(texts, joint)).otherwise(content)


def messages(parsed: DataFrame, joint: str = "\n") -> DataFrame:
    """file, agent, session_id, role, text, ts of message entries, nested or flat."""
    inner = F.from_json("message", "role string, content string")
    content = F.coalesce(inner.content, F.col("content"))
    text = flatten_text(content, joint)
    return parsed.select("file", "agent", "session_id", F.coalesce(inner.role, "role").alias("role"), F.trim(text).alias("text"), F.try_to_timestamp("timestamp").alias("ts")).where("role is not null and text <> ''")


def substantial(rows: DataFrame, least: int = 120) -> DataFrame:
    return rows.where((F.length("text") >= least) & ~F.col("text").isin(*IDLE))


def markdown(spark: SparkSession, root: str, modified_after: str | None = None) -> DataFrame:
    """file, agent, text of whole markdown files; the workspace without a suffix belongs to main."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    name = F.regexp_extract("_metadata.file_path", r"/workspace-?([^/]*)/", 1)
    return reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.when(name == "", "main").otherwise(name).alias("agent"), F.col("value").alias("text"))


def blocks(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row for each second-level heading's block: pos, heading, body."""
    parts = F.filter(F.split(text, r"(?m)^(?=## )"), lambda x: F.startswith(x, F.lit("## ")))
    out = rows.select(*(c for c in rows.columns if c != text), F.posexplode(parts).alias("pos", "block"))
    return out.select(*(c for c in rows.columns if c != text), "pos", F.trim(F.regexp_extract("block", r"^## ([^\n]*)", 1)).alias("heading"), F.regexp_replace(F.regexp_replace("block", r"^## [^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"))


def pack_lines(text: str, size: int = 5000) -> list[str]:
    """Lines packed into chunks of at most `size` characters; a longer line is a chunk of its own."""
    out: list[str] = []
    held: list[str] = []
    n = 0
    for line in (text or "").split("\n"):
        if held and n + len(line) + 1 > size:
            out.append("\n".join(held))
            held, n = [], 0
        held.append(line)
        n += len(line) + 1
    return [c for c in [*out, "\n".join(held)] if c.strip()]


def chunks(rows: DataFrame, size: int = 5000) -> DataFrame:
    """Whole texts (file, text) as memories of note, hot, importance 9."""
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack_lines(t, size))

    out = rows.select("file", F.posexplode(cut("text")).alias("i", "content"))
    return out.select(sha1_id("memmd_", F.col("file"), F.col("i").cast("string"), F.col("content")).alias("id"), F.lit("note").alias("type"), "content", F.lit("hot").alias("tier"), F.lit(9).alias("importance"), F.lit("system").alias("agent"))


def legacy(spark: SparkSession, root: str) -> DataFrame:
    """One JSON object a file in folders named by tier."""
    schema = "id string, type string, content string, text string, tier string, context string, agent string, importance int, tags array<string>, timestamp string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    content, path = F.coalesce("content", "text"), F.col("_metadata.file_path")
    ts = F.try_to_timestamp("timestamp")
    return rows.select(
        F.coalesce("id", sha1_id("v2_", F.regexp_extract(path, "/([^/]+)$", 1), content)).alias("id"), F.coalesce("type", F.lit("note")).alias("type"), content.alias("content"), "context",
        F.coalesce("tier", F.regexp_extract(path, "/([^/]+)/[^/]+$", 1)).alias("tier"), "agent", F.coalesce("importance", F.lit(5)).alias("importance"), "tags", ts.alias("created_at"), ts.alias("last_accessed"),
    )


def eval_set(spark: SparkSession, path: str, lines_: bool = True) -> DataFrame:
    """query and keys; a line that does not parse is an error."""
    schema = "query string, expected_key string, expected_pattern_key string, expected_id string, expected_keys array<string>, context string, tier string, minImportance int"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", str(not lines_).lower()).json(path)
    keys = F.array_distinct(F.concat(F.array_compact(F.array("expected_key", "expected_pattern_key", "expected_id")), F.coalesce("expected_keys", F.array().cast("array<string>"))))
    return rows.select("query", keys.alias("keys"), "context", "tier", F.col("minImportance").alias("min_importance"))
