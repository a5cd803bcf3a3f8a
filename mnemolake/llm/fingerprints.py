"""Document fingerprints by consistent weighted sampling (Ioffe 2010), in DataFrame functions only.

A document is a weighted set: its words, lower-cased and cut at white space, with their counts. For each of SLOTS slots and
each word, a hash of both gives r and c, each Gamma(2, 1), and b, uniform. With t = floor(ln(weight) / r + b), the sample is
ln a = ln c - r * (t + 1 - b); the slot keeps the least of all words. Two documents agree in a slot with a probability equal
to their generalised Jaccard similarity (sum of the smaller over sum of the larger weights). A gamma is -ln(u v) of two
uniforms, which is Gamma(2, 1) exactly, with the tails from which the least sample of a long text comes; each takes the halves
of a hash of its own. A signature is the least samples, hashed to 16 bits each: 4 hex digits for each slot. Likeness is the
share of equal slots.

Documents are shuffled once, into cells: ranges of doc_id that sampled splitters make even in bytes. The next document of
each, the counts and the samples are all found within a cell. A word with the same weight has the same samples wherever it
stands, so they are drawn once for each word and weight of a cell and dealt to its documents. The least id of a cell needs a
text from below it: one such row is copied to each cell. An id that alone fills a range is cut into several cells, its rows
dealt by their place in the input, each cell with its copied row. The number of cells is bounded by MAX_RANGES, for what the
driver holds of them; above a terabyte they grow, and spill where they must.

The next document is that of the next smaller doc_id (null: the smallest of all), after the last the first; of several rows
of that id the one whose text has the least hash. Rows that repeat a doc_id thus have the same next document. In a table
of one id that row follows all. Nulls: a null text counts as empty. Texts without words share one signature (all ffff), which
is like itself only. A very long text is rows of words like any other. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .common import literal_array, staged, table
from .splitters import range_of, sample_splitters

SLOTS = 64
RANGE_BYTES, MAX_RANGES = 16 << 20, 1 << 16
_NULL_ID = -(2**63)


def _gamma(h: Column) -> Column:
    """Gamma(2, 1) of a 64-bit hash: each half is a uniform in (0, 1)."""
    unit = lambda bits: (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-32)
    return -F.log(unit(h.bitwiseAND(F.lit(0xFFFFFFFF))) * unit(F.shiftrightunsigned(h, 32)))


def sample(term: Column, log_weight: Column, slot: int) -> Column:
    """ln a of one term in one slot, of three hashes: for r, for c and for b."""
    r, c = (_gamma(F.xxhash64(term, F.lit(3 * slot + k))) for k in (0, 1))
    b = F.shiftrightunsigned(F.xxhash64(term, F.lit(3 * slot + 2)), 11).cast("double") * F.lit(2.0**-53)
    return F.log(c) - r * (F.floor(log_weight / r + b).cast("double") + F.lit(1.0) - b)


def signatures(words: DataFrame, keys: list[str], slots: int = SLOTS) -> DataFrame:
    """keys and s0, s1, ...: the least samples of each key's weighted words (columns term, log_weight).

    Samples are drawn once for each term and weight among the rows that agree in all keys but the last; the caller bounds
    how many those are."""
    *within, owner = keys
    # the term comes first: if the aggregate has to sort, it sorts by it, and its leading bytes tell most rows apart
    drawn = words.groupBy("term", "log_weight", *within).agg(F.collect_list(owner).alias("owners"), *(sample(F.col("term"), F.col("log_weight"), i).alias(f"s{i}") for i in range(slots)))
    dealt = drawn.select(*within, F.explode("owners").alias(owner), *(f"s{i}" for i in range(slots)))
    return dealt.groupBy(*keys).agg(*(F.min(f"s{i}").alias(f"s{i}") for i in range(slots)))


def _lower() -> WindowSpec:
    """The rows of the smaller ids of a cell."""
    return Window.partitionBy("cell").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)


def _celled(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (key, size, more) with cell, and the number of cells: ranges of key, even in size. A key that fills more than
    RANGE_BYTES and more than a range has as many cells as it fills; then the rows are staged, as only a row's place in the
    input tells equal rows apart."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    # at least some for each shuffle partition, so that they fill evenly
    ranges = int(min(MAX_RANGES, max(total // RANGE_BYTES, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)))
    bounds, heavy = sample_splitters(rows, F.col("key"), F.col("size"), ranges, per_range=8, total=total)
    even = total / ranges
    parts = [max(1, int(-(-heavy.get(i, 1) * even // max(RANGE_BYTES, even)))) for i in range(len(bounds) + 1)]
    of = F.coalesce(range_of(F.col("key"), bounds), F.lit(0)).cast("long")
    if max(parts) == 1:
        return rows.withColumn("cell", of), len(parts)
    first = [sum(parts[:i]) for i in range(len(parts))]
    rows = rows.withColumns({"range": of.cast("int"), "salt": F.xxhash64(F.monotonically_increasing_id())})
    cell = F.get(literal_array(first, "bigint"), F.col("range")) + F.pmod("salt", F.get(literal_array(parts, "int"), F.col("range")))
    return staged(rows.withColumn("cell", F.coalesce(cell, F.lit(0).cast("long"))).drop("range", "salt"), "cells"), sum(parts)


def _next_rows(docs: DataFrame) -> DataFrame:
    """cell, at (row number in it), rank (of the id in it), first (of its id), own (false for the copy from below), doc_id,
    text, next (the next document's text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.coalesce("doc_id", F.lit(_NULL_ID)), "hash": F.xxhash64("text"), "size": F.octet_length("text") + F.lit(16)})
    rows, cells = _celled(rows)
    # one row for each cell at most, that of the largest id below its own; the lowest wraps round to the top
    tops = rows.groupBy("cell").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    lows = tops.groupBy("low").agg(F.max("high").alias("high"))  # the cells of one id are one here
    up = Window.partitionBy(F.lit(0)).orderBy("low")
    steps = lows.select("low", F.lag("high").over(up).alias("below"), F.max("high").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("top"))
    copies = tops.join(F.broadcast(steps), "low").select(F.col("cell").alias("to"), F.coalesce("below", "top").alias("key"))
    ghosts = rows.select("key", "hash", "doc_id", "text").join(F.broadcast(copies), "key")  # bounded: a row for each cell
    ghosts = ghosts.groupBy("to").agg(F.min(F.struct("hash", "key", "doc_id", "text")).alias("x"))
    both = rows.select("cell", F.lit(True).alias("own"), "key", "hash", "doc_id", "text").union(
        ghosts.select(F.coalesce("to", F.lit(0).cast("long")), F.lit(False), "x.key", "x.hash", "x.doc_id", "x.text")
    )
    both = both.repartition(max(cells, 1), "cell")
    by_row, by_id = Window.partitionBy("cell").orderBy("own", "key", "doc_id", "hash"), Window.partitionBy("cell").orderBy("own", "key")
    begins = F.lag("key").over(by_row).isNull() | (F.lag("key").over(by_row) != F.col("key")) | ~F.lag("own").over(by_row) & F.col("own")
    placed = both.withColumns({"at": F.row_number().over(by_row), "rank": F.dense_rank().over(by_id), "first": begins})
    return placed.withColumn("next", F.last(F.when(F.col("first"), F.col("text")), ignorenulls=True).over(_lower())).drop("key", "hash")


def _hex(columns: list[Column]) -> Column:
    """16 bits of each least sample; ffff where there is none."""
    return F.concat(*(F.when(c.isNull(), F.lit("ffff")).otherwise(F.lower(F.lpad(F.hex(F.pmod(F.xxhash64(c), F.lit(65535))), 4, "0"))) for c in columns))


def _likeness(a: Column, b: Column, slots: int) -> Column:
    """The share of equal slots of two fingerprints."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), F.lit(0), lambda n, i: n + F.when(F.substr(a, i * 4 + 1, F.lit(4)) == F.substr(b, i * 4 + 1, F.lit(4)), 1).otherwise(0))
    return F.when(a == b, F.lit(1.0)).otherwise(same / F.lit(float(slots)))


def fingerprint_documents(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs (doc_id,
    text): the edited text ends in the next document's beginning, as the module says of order."""
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    rows = _next_rows(docs).withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.left("text", n - half), F.left(F.coalesce("next", F.lit("")), half))})
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.when(F.col("own"), F.col("edited")).alias("t")))
    texts = rows.select("cell", "at", F.explode(sides).alias("x")).select("cell", "at", "x.side", F.split(F.lower("x.t"), r"\s+").alias("words"))
    words = texts.select("cell", "at", "side", F.explode("words").alias("word")).where("word <> ''").select("cell", "at", "side", F.xxhash64("word").alias("term"))
    counted = words.groupBy("term", "cell", "at").agg(F.sum(1 - F.col("side")).alias("n"), F.sum("side").alias("m"))
    # an owner is a row and the sides that have the word with this weight: 1, its own text; 2, its edited text; 3, both
    part = lambda sides, n: F.struct(F.lit(sides).alias("sides"), F.col(n).alias("n"))
    parts = F.when(F.col("n") == F.col("m"), F.array(part(3, "n"))).when(F.col("m") == 0, F.array(part(1, "n"))).when(F.col("n") == 0, F.array(part(2, "m"))).otherwise(F.array(part(1, "n"), part(2, "m")))
    owned = counted.select("term", "cell", "at", F.explode(parts).alias("x")).select("term", "cell", (F.col("at") * 4 + F.col("x.sides")).alias("owner"), F.log(F.col("x.n").cast("double")).alias("log_weight"))
    least = signatures(owned, ["cell", "owner"], slots).withColumn("at", F.shiftright("owner", 2))
    side = F.explode(F.when(F.col("owner") % 4 == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array((F.col("owner") % 4).cast("int")))).alias("side")
    least = least.select("cell", "at", side, *(f"s{i}" for i in range(slots))).groupBy("cell", "at", "side").agg(*(F.min(f"s{i}").alias(f"s{i}") for i in range(slots)))
    prints = least.select("cell", "at", "side", _hex([F.col(f"s{i}") for i in range(slots)]).alias("fp"))
    both = prints.groupBy("cell", "at").agg(F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("fingerprint"), F.max(F.when(F.col("side") == 2, F.col("fp"))).alias("edited_fingerprint"))
    base = rows.select("cell", "at", "rank", "first", "own", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    none = F.lit("ffff" * slots)
    full = base.join(both, ["cell", "at"], "left").withColumns({c: F.coalesce(c, none) for c in ("fingerprint", "edited_fingerprint")})
    full = full.withColumn("next", F.last(F.when(F.col("first"), F.col("fingerprint")), ignorenulls=True).over(_lower())).where("own")
    return full.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        _likeness(F.col("fingerprint"), F.col("edited_fingerprint"), slots).alias("near_edited"), _likeness(F.col("fingerprint"), F.col("next"), slots).alias("near_next"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
