"""Structured Streaming: file ingest that sees each file once, the advice cooldown as state that ends, the daily trend, and a sink
that puts late rows beside the others."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.advisory import COOLDOWN_MS, given
from ..sources.snapshots import Snapshots, ddl

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watch(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]):
    """All that has come since the last run, each batch at least once: batch must be idempotent (a merge by key, or a commit
    that names the batch)."""
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def daily_trend(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Mean duration and count for each day and kind, once the watermark has passed the day."""
    stamped = log.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return stamped.groupBy(F.window("created_at", "1 day").alias("w"), "query_kind").agg(F.avg(F.coalesce("duration_ms", F.lit(0))).alias("avg_ms"), F.count("*").alias("n")).select(F.col("w.start").alias("day"), "query_kind", "avg_ms", "n")


class Cooldown(StatefulProcessor):
    """The state of an agent and tool is the time of the last advice given. A timer ends it when the watermark has passed the
    cooldown: no request that is still to come can fall into it."""

    def __init__(self, ms: int):
        self.ms = ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ts, ids = [], []
        for pdf in rows:  # of one batch and key, two numbers a request
            ts.append(pdf.ts.to_numpy("datetime64[us]").astype(np.int64))
            ids.append(pdf.event_id.to_numpy())
        ts, ids = np.concatenate(ts), np.concatenate(ids)
        order = np.lexsort((ids, ts))
        ts, ids = ts[order], ids[order]
        was = self.last.get()[0] if self.last.exists() else None
        kept, last = given(ts, was, self.ms)
        if last is not None and last != was:
            if was is not None:
                self.handle.deleteTimer(self._end(was))
            self.last.update((last,))
            self.handle.registerTimer(self._end(last))
        agent, tool = key
        yield pd.DataFrame({"event_id": ids[kept], "agent": agent, "tool": tool, "ts": pd.to_datetime(ts[kept], unit="us", utc=True)})

    def _end(self, last: int) -> int:
        return -(-last // 1000) + self.ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def cooldown(requests: DataFrame, ms: int = COOLDOWN_MS, late: str = "1 minute") -> DataFrame:
    """Requests (event_id, agent, tool, ts) that get advice, as they come; held back requests do not prolong the cooldown. Requests
    without a time, or later than the watermark, get none. State is kept only as long as it can still hold a request back."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = requests.where("ts is not null").select("event_id", F.coalesce("agent", F.lit("unknown")).alias("agent"), "tool", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("agent", "tool").transformWithStateInPandas(Cooldown(ms), "event_id long, agent string, tool string, ts timestamp", "append", "eventTime")


def unique_within(rows: DataFrame, keys: list[str], time: str, horizon: str = "30 days") -> DataFrame:
    """The first row of each key; its state ends when the watermark has passed the horizon."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


class TwoWaySink:
    """Rows in time go to the table `rows`, each key once within the horizon; rows behind the watermark go to `late`, all of them.

    The watermark is the stream's own: the latest time of the batches before, less the delay. It is committed with the rows, and
    with the number of the batch, in one snapshot: a batch that runs twice is routed and stored once. Keys are compared with those
    of the horizon only; a null time is late. Of equal keys within a batch the earliest row counts, by time, then by its columns."""

    def __init__(self, path: str, keys: list[str], time: str, late: str = "1 hour", horizon: str = "30 days"):
        self.path, self.keys, self.time, self.late, self.horizon = path, keys, time, late, horizon

    def split(self, batch: DataFrame, watermark: str | None) -> tuple[DataFrame, DataFrame]:
        if watermark is None:
            in_time = F.col(self.time).isNotNull()
        else:
            in_time = F.coalesce(F.col(self.time) >= F.lit(watermark).cast("timestamp_ntz"), F.lit(False))
        return batch.where(in_time), batch.where(~in_time)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        tables = Snapshots(spark, self.path)
        now = tables.latest()
        if now.info.get("done", {}).get(stream, -1) >= number:
            return
        batch = batch.withColumn(self.time, F.col(self.time).cast("timestamp_ntz"))
        rows, late = self.split(batch, now.info.get("watermark"))
        first = rows.groupBy(*self.keys).agg(F.min(F.struct(self.time, *(c for c in rows.columns if c not in (self.time, *self.keys)))).alias("r")).select(*self.keys, "r.*").select(*rows.columns)
        known = now.read(spark, "rows", ddl(batch))
        span = F.expr(f"interval {self.horizon}")
        k, f = known.alias("k"), first.alias("f")
        same = [F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}")) for c in self.keys]
        near = (F.col(f"k.{self.time}") > F.col(f"f.{self.time}") - span) & (F.col(f"k.{self.time}") < F.col(f"f.{self.time}") + span)
        on = near
        for c in same:
            on = on & c
        fresh = f.join(k, on, "left_anti")
        top = rows.agg(F.max(self.time).alias("t")).select((F.col("t") - F.expr(f"interval {self.late}")).cast("string").alias("t")).first().t
        before = now.info.get("watermark")
        ahead = max((x for x in (top, before) if x), key=dt.datetime.fromisoformat, default=None)
        tables.commit(now, add={"rows": fresh, "late": late}, info={"watermark": ahead, "done": {**now.info.get("done", {}), stream: number}})
