"""Sharding by sampled splitters: size-weighted samples of the key, quantile boundaries, range partitioning, and overfull
ranges subdivided.

The key of a document is the 64-bit hash of its text, so copies of one text stand side by side. Boundaries at the sample's
quantiles cut the keys into many more ranges than shards; a range that holds more than its target, and each that a shard's
border falls into, is subdivided evenly by key. Every shard is then a run of neighbouring ranges in the order of the key, cut
where the exact sizes come nearest to equal. Only a key that alone overfills its range is cut by row: equal texts then lie in
neighbouring shards. The law is `bytes`: the sizes of the shards are near equal. A size is the UTF-8 length of the text (null:
none) plus 16.

Only DataFrame functions run here. One pass reads the documents and stages a narrow row for each (id, size, crc, key, a
number); sampling, exact sizes and placing read that. The driver and broadcasts hold one row for each range, whose number is
a parameter (FINE for each shard) plus the subdivisions.

Nulls: a null text has size 16, crc32 0 and its own key; a null doc_id is kept and ordered first. Repeated rows each get a
place. A very long text is one row like any other; it may outweigh a shard. An empty table gives an empty result. Other
columns of the input are ignored unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import literal_array, staged, table
from .splitters import range_of, sample_splitters

SHARDS = 40
#: Ranges for each shard, before subdividing.
FINE = 48
#: Parts of a range that a shard's border falls into.
BORDER = 64
OVERHEAD = 16


def shard(docs: DataFrame, shards: int = SHARDS, fine: int = FINE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text), then the columns in keep."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        *(F.col(c).alias(f"keep_{c}") for c in keep),
    )
    # the number tells repeated rows apart; staged, it stays the same for all that follows
    rows = staged(rows.withColumn("row", F.xxhash64(F.monotonically_increasing_id())), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = max(total / (shards * fine), 1.0)
    bounds, heavy = sample_splitters(rows, F.col("key"), F.col("size"), shards * fine, total=total)
    rows = rows.withColumn("range", range_of(F.col("key"), bounds))
    parts, before = [1] * (len(bounds) + 1), 0
    for r in sorted(rows.groupBy("range").agg(F.sum("size").alias("bytes")).collect()):
        border = before * shards // total != (before + r.bytes) * shards // total
        parts[r["range"]] = max(1, int(-(-r.bytes // target))) * (BORDER if border else 1)
        before += r.bytes
    rows = rows.withColumn("part", _part(F.col("key"), F.col("row"), F.col("range"), bounds, parts))
    sums = rows.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    # a shard is full at its even share of what the shards before it left, so that a huge text costs its own shard only
    plan, filled, to, size, left = [], [0] * shards, 0, 0, total
    pieces = sorted(sums, key=lambda r: (r["range"], r.part))
    for i, r in enumerate(pieces):
        if size and to < shards - 1 and (size + r.bytes / 2 > left / (shards - to) or len(pieces) - i < shards - to):
            left, to, size = left - size, to + 1, 0
        plan.append((r["range"], r.part, to, filled[to]))
        filled[to] += r.n
        size += r.bytes
    places = docs.sparkSession.createDataFrame(plan or [(0, 0, 0, 0)], "range int, part int, shard int, first long")
    ordered = Window.partitionBy("range", "part").orderBy("doc_id", "text_crc32", "size", "row")
    return (
        rows.withColumn("at", F.row_number().over(ordered))
        .join(F.broadcast(places), ["range", "part"])  # bounded: one row for each range
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(F.col(f"keep_{c}").alias(c) for c in keep))
    )


def _part(key: Column, row: Column, at: Column, bounds: list[int], parts: list[int]) -> Column:
    """Which of its range's parts a row belongs to: by the key's place between the range's ends, or, where a range is one key,
    by the row's number."""
    if max(parts) == 1:
        return F.lit(0)
    low, high = [-(2.0**63), *map(float, bounds)], [*map(float, bounds), 2.0**63]
    single = [int(i > 0 and i < len(bounds) and bounds[i] - bounds[i - 1] == 1) for i in range(len(parts))]
    n = F.get(literal_array(parts, "int"), at)
    start, end = F.get(literal_array(low, "double"), at), F.get(literal_array(high, "double"), at)
    # an exact difference of close longs, or a rounded one of far ones: both grow with the key
    by_key = F.floor((key.cast("double") - start) / F.greatest(end - start, F.lit(1.0)) * n)
    by_key = F.greatest(F.lit(0), F.least(by_key, (n - 1).cast("long")))
    return F.when(F.get(literal_array(single, "int"), at) == 1, F.pmod(row, n)).otherwise(by_key).cast("int")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes docs with its shard and slot, one folder for each shard; a shard's rows may come from many tasks."""
    shard(docs, shards, keep=("text",)).write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
