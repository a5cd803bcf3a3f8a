"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits are a ring of eight 8-bit segments. If two fingerprints differ in at most two bits, then from some
segment on every chain of l consecutive segments differs in at most l * 2 / 8 bits (the proportional budget): chains of up
to three segments in none, of up to seven in one, of eight in two. So the first three segments of such a chain are equal,
and of the next four, which differ in one bit at most, either the first two or the last two are equal too. Each fingerprint
therefore emits 16 keys of 40 equal bits; those that share a key are held to the chains' budgets, then to the full Hamming
distance.

Equal fingerprints are one class from the start. A key that more than BUCKET classes share is not paired off: its members
emit themselves and their one-bit changes in the 24 bits that the key leaves open, and those that meet at such a value (at
most 25, all within two bits of each other) are linked to the smallest of them. That finds the same components, exactly, with
linear work and without gathering the bucket in one task.

Components are found by alternating large-star and small-star steps on (doc_id, doc_id) links, staged after each round;
nothing is collected, and joins are told to merge, as a side just under the threshold for broadcasts would pass through the
driver in each round and stay there. component_id is the smallest doc_id reachable. Null doc_ids have no component of their own making: they
take that of their fingerprint's class (null if the class has only nulls).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, staged, table

BITS, SEGMENT, RING, DISTANCE, BUCKET = 64, 8, 8, 2, 48


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 majority bits over the XXH64 hashes (seed 42) of all shingles of `words` words, repeats included; A-Z in lower case,
    words cut at ASCII white space. Fewer words: one shingle of them all; none: zero."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    h = xxhash.xxh64_intdigest
    if len(found) < words:
        return h(b" ".join(found), 42)
    join = b" ".join
    return majority(np.array([h(join(x), 42) for x in zip(*(found[k:] for k in range(words)), strict=False)], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; zero of none."""
    if not len(hashes):
        return 0
    hashes = hashes.astype("<u8", copy=False)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # so that a very long text takes no more memory than a short one
        votes += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _turned(fp: Column, by: int) -> Column:
    """The ring turned so that the segment `by` comes first (in the lowest bits)."""
    n = by * SEGMENT
    return fp if n == 0 else F.shiftrightunsigned(fp, n).bitwiseOR(F.shiftleft(fp, BITS - n))


def _keys(fp: Column) -> Column:
    """16 structs of start, half and the 40 equal bits: the chain's first three segments, then two of the next four."""
    out = []
    for s in range(RING):
        ring = _turned(fp, s)
        head = ring.bitwiseAND(F.lit((1 << 24) - 1))
        for half in (0, 1):
            tail = F.shiftrightunsigned(ring, 24 + 16 * half).bitwiseAND(F.lit((1 << 16) - 1))
            out.append(F.struct(F.lit(2 * s + half).cast("byte").alias("way"), F.shiftleft(tail, 24).bitwiseOR(head).alias("key")))
    return F.array(*out)


def _chain(diff: Column, way: Column) -> Column:
    """Whether the ring's differences, from the key's start on, keep every chain within its proportional budget."""
    start = F.shiftright(way.cast("int"), 1) * SEGMENT
    ring = F.call_function("shiftrightunsigned", diff, start).bitwiseOR(F.when(start == 0, F.lit(0)).otherwise(F.call_function("shiftleft", diff, F.lit(BITS) - start)))
    ok = F.lit(True)
    for length in range(1, RING + 1):
        mask = (1 << (SEGMENT * length)) - 1
        part = ring if length == RING else ring.bitwiseAND(F.lit(mask))
        ok = ok & (F.bit_count(part) <= length * DISTANCE // RING)
    return ok


def links(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: ids of classes (id, fp; fp distinct) such that the links connect exactly the classes that links between
    all fingerprints within two bits connect. Within a small bucket every such pair is linked."""
    keyed = classes.select("id", "fp", F.explode(_keys(F.col("fp"))).alias("k")).select("id", "fp", "k.way", "k.key")
    count = keyed.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(count.hint("merge"), ["way", "key"])
    small, large = shared.where(F.col("n") <= BUCKET), shared.where(F.col("n") > BUCKET)
    members = small.groupBy("way", "key").agg(F.collect_list(F.struct("id", "fp")).alias("m"))  # at most BUCKET each
    one = members.select("way", "m", F.explode("m").alias("x")).select("way", "x", F.explode("m").alias("y")).where("x.id < y.id")
    diff = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    near = one.where(_chain(diff, F.col("way")) & (F.bit_count(diff) <= DISTANCE)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(np.uint64(1 << i).astype(np.int64).item()).cast("long") for i in range(BITS)))
    open_bits = F.filter(flips, lambda f: _free(F.col("way"), f))
    met = large.select("id", "way", "key", F.explode(F.transform(open_bits, lambda f: F.col("fp").bitwiseXOR(f))).alias("v"))
    best = met.groupBy("way", "key", "v").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = met.join(best.hint("merge"), ["way", "key", "v"]).where("a < id").select("a", F.col("id").alias("b"))
    return near.union(star).distinct()


def _free(way: Column, flip: Column) -> Column:
    """Whether the key of this way leaves the flipped bit open (or flips none)."""
    held = []
    for w in range(2 * RING):
        bits = 0
        for k in (0, 1, 2, 3 + 2 * (w % 2), 4 + 2 * (w % 2)):
            bits |= 0xFF << (SEGMENT * ((w // 2 + k) % RING))
        held.append(np.uint64(bits).astype(np.int64).item())
    return F.get(F.array(*(F.lit(h).cast("long") for h in held)), way.cast("int")).bitwiseAND(flip) == 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) for every id on an edge (a, b), root the smallest id reachable; large-star and small-star steps until the
    edges stay the same, each round staged."""
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"), "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    was = mark(edges)
    for _ in range(rounds):
        if not was[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: each larger neighbour of a joins a's smallest neighbour
        large = both.where("b > a").join(least.hint("merge"), "a").where("m < b").select(F.col("m").alias("a"), "b").distinct()
        # small star: each smaller neighbour, and b itself, joins b's smallest
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low.hint("merge"), "b")
        small = small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(low.select(F.col("m").alias("a"), "b")).distinct()
        after = staged(small, "edges")
        now = mark(after)
        discard(edges)
        edges = after
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("id"), "root").union(edges.select("a", "a").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text).

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows each get their row; an empty
    table gives an empty result; other columns are ignored.
    """
    fps = staged(fingerprints(docs), "fingerprints")
    classes = staged(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    roots = components(links(classes))
    named = classes.join(roots.hint("merge"), "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return fps.join(named.hint("merge"), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
