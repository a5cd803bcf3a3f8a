"""Which session files to read: found by their metadata alone, then only those are read.

The pass over metadata lists files with their time and size; no content is read (the column is pruned from the scan). What it
keeps is cut to the newest before anything is opened, and left out is what a ledger of done files names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import SKIPPED_AGENTS

AGENT = r"/([^/]+)/sessions/"
FOUND = "path string, modified timestamp, size long, agent string, session_id string"


def discover(
    spark: SparkSession, roots: str | list[str], since: Column | None = None, above: int = 0, newest: int | None = None, agent: str | None = None,
    pattern: str = "*.jsonl", agent_pattern: str = AGENT, skipped: tuple[str, ...] = SKIPPED_AGENTS, done: DataFrame | None = None,
) -> DataFrame:
    """path, modified, size, agent, session_id of files under the roots (missing ones count as empty), the newest first by time,
    then path: changed since, larger than `above` bytes, of one agent or of all but the skipped, not in done (path), and of these
    the `newest`. Files outside an agent's folder have agent ''. pattern may name several endings: *.{jsonl,ndjson}."""
    from .stages import file_system

    there = []
    for root in [roots] if isinstance(roots, str) else roots:
        fs, place = file_system(spark, root)
        if fs.exists(place):
            there.append(root)
    if not there:
        return spark.createDataFrame([], FOUND)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(there)
    rows = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.regexp_extract("path", agent_pattern, 1).alias("agent"), F.regexp_extract("path", r"/([^/]+)\.[^./]+$", 1).alias("session_id")).distinct()
    rows = rows.where((F.col("size") > above) & ~F.col("agent").isin(*skipped or ("",)) if skipped else F.col("size") > above)
    if since is not None:
        rows = rows.where(F.col("modified") >= since)
    if agent is not None:
        rows = rows.where(F.col("agent") == agent)
    if done is not None:
        rows = rows.join(done.select("path").distinct(), "path", "left_anti")
    rows = rows.orderBy(F.desc("modified"), "path")
    return rows.limit(newest) if newest is not None else rows


def read_found(spark: SparkSession, found: DataFrame, most: int = 10_000) -> DataFrame:
    """path, agent, session_id, modified, pos, line of the first `most` files of found, and no others: their paths, which are that
    many at most, name what is read. A file is one row until it is cut into lines, so that lines keep their place."""
    rows = found.limit(most).collect()
    if not rows:
        return spark.createDataFrame([], "path string, agent string, session_id string, modified timestamp, pos int, line string")
    names = spark.createDataFrame(rows, found.schema)
    text = spark.read.text([r.path for r in rows], wholetext=True).select(_plain(F.col("_metadata.file_path")).alias("path"), "value")
    return cut_lines(text.join(F.broadcast(names.withColumn("path", _plain(F.col("path")))), "path"))  # at most `most` names


def _plain(path: Column) -> Column:
    """Sources write the same local path with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def cut_lines(rows: DataFrame) -> DataFrame:
    """rows (path, agent, session_id, modified, value) as lines that are not blank, with their place."""
    cut = rows.select("path", "agent", "session_id", "modified", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return cut.where(F.trim("line") != "")
