"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is a sequence of words (cut at white space). Two lines are near if one edit (a word put in, taken out or changed)
turns one into the other; lines of fewer than MIN_WORDS words only match when equal. A line goes if it, or a line near it,
occurred earlier, in the order of (doc_id, line number); the earliest stays. Blank lines always stay.

Deletion neighbourhood: each different line emits, as 64-bit keys, itself and all its variants with one word deleted. Lines
meet at equal variants: two variants with the deletion at the same place are a changed word; a variant that equals a whole
line is a word put in. At each key only the earliest is looked up, never pairs of all members: of lines that meet at one
deletion, each is near each. The edit distance to that earliest line is then verified on the words themselves.

Two steps keep this small. Equal lines (by 128 bits of hash of their words) become one first. And of two near lines, the
first or the last floor(n / 2) words are the same (n: words of the shorter): only lines that share such a half with another
line fetch their words and emit variants. Until then only hashes are shuffled.

Rows that repeat both doc_id and text count as one document and get one result each. Nulls: a null text has no line and
stays null; a null doc_id comes first. An empty table gives an empty result; other columns are kept as they are,
but for those called n_lines or n_kept, which come back as doc_n_lines and doc_n_kept. A text is cut into lines once for each
pass, however many lines it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

MIN_WORDS = 8


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, r"\s+"), "")


def _blank(line: Column) -> Column:
    """Whether a line has no word; told without cutting it."""
    return ~line.rlike(r"\S")


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))


def _halves(h: Column, n: Column) -> Column:
    """Keys of the first and last floor(n / 2) words, and of floor((n - 1) / 2) for the part of the longer line."""
    def keys(m: Column) -> Column:
        return F.array(F.xxhash64(F.lit(1), m, F.slice(h, F.lit(1), m)), F.xxhash64(F.lit(2), m, F.slice(h, n - m + 1, m)))

    return F.array_distinct(F.concat(keys(F.floor(n / 2).cast("int")), keys(F.floor((n - 1) / 2).cast("int"))))


def _variants(h: Column, n: Column) -> Column:
    """Structs of key and place: the line whole (place -1), each word changed (the words but one, with n and the place), and
    each word taken out (the shorter line, place as counted from -2 down)."""
    here, left = F.col("here"), F.col("left")  # each hash mixed with its place, and with the place before
    total = F.col("total")
    changed = F.transform(here, lambda x, k: F.struct(F.xxhash64(F.lit(3), n, k, total.bitwiseXOR(x)).alias("key"), k.alias("place")))
    start = F.struct(F.col("left_total").bitwiseXOR(F.get(left, F.lit(0))).alias("x"), F.array().cast("array<bigint>").alias("out"))
    taken = F.aggregate(
        F.sequence(F.lit(0), n - 1), start,
        lambda a, k: F.struct(
            a.getField("x").bitwiseXOR(F.get(here, k)).bitwiseXOR(F.coalesce(F.get(left, k + 1), F.lit(0).cast("long"))).alias("x"),
            F.array_append(a.getField("out"), a.getField("x")).alias("out")),
        lambda a: a.getField("out"),
    )
    shorter = F.transform(taken, lambda x, k: F.struct(F.xxhash64(F.lit(4), n - 1, x).alias("key"), (F.lit(-2) - k).alias("place")))
    whole = F.array(F.struct(F.xxhash64(F.lit(4), n, total).alias("key"), F.lit(-1).alias("place")))
    return F.concat(whole, changed, shorter)


def occurrences(docs: DataFrame) -> DataFrame:
    """A compact row for each line that is not blank: at (doc_id, text_hash, pos), 128 bits of hash of its words, and the
    hashes of its halves (none for lines of fewer than MIN_WORDS words). No text."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    rows = rows.where(~_blank(F.col("raw"))).select("doc_id", "text_hash", "pos", _words(F.col("raw")).alias("w"))
    rows = rows.select("doc_id", "text_hash", "pos", F.xxhash64("w").alias("a"), F.xxhash64(F.lit(7), "w").alias("b"), F.when(F.size("w") >= MIN_WORDS, F.transform("w", lambda x: F.xxhash64(x))).alias("h"))
    return rows.select(F.struct("doc_id", "text_hash", "pos").alias("at"), "a", "b", F.when(F.col("h").isNotNull(), _halves(F.col("h"), F.size("h"))).alias("halves"))


def near_earlier(docs: DataFrame, seen: DataFrame, firsts: DataFrame) -> DataFrame:
    """at of each different line (its first occurrence, in firsts) that is near an earlier line."""
    halves = seen.select("a", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("half")
    some = halves.join(shared, "half").select("a").distinct()
    wanted = firsts.join(some, "a", "left_semi").select("at.*").groupBy("doc_id", "text_hash").agg(F.collect_list("pos").alias("wanted"))
    texts = _with(docs.select("doc_id", "text"), wanted, "inner")
    # the text is cut once for all its wanted lines: the array of one array binds it
    lines = F.transform(F.array(F.split("row.text", "\n")), lambda all: F.transform("wanted", lambda k: F.struct(k.alias("pos"), F.get(all, k).alias("line"))))
    few = texts.select("of_id", "text_hash", F.explode(F.get(lines, F.lit(0))).alias("x"))
    few = few.select(F.struct(F.col("of_id").alias("doc_id"), "text_hash", F.col("x.pos").alias("pos")).alias("at"), _words(F.col("x.line")).alias("w"))
    few = staged(few, "lines")
    n = F.size("h")
    words = few.select("at", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    mixed = words.withColumns({"here": F.transform("h", lambda h, k: F.xxhash64(h, k)), "left": F.transform("h", lambda h, k: F.xxhash64(h, k - 1))})
    mixed = mixed.withColumns({"total": _xor(F.col("here")), "left_total": _xor(F.col("left"))})
    keys = mixed.select("at", F.explode(_variants(F.col("h"), n)).alias("v")).select("at", "v.key", "v.place")
    whole, part = F.col("place") == -1, F.col("place") != -1
    first = keys.groupBy("key").agg(F.min(F.when(whole, F.col("at"))).alias("whole_at"), F.min(F.when(part, F.col("at"))).alias("part_at"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = keys.join(first, "key")
    # a changed word meets changed words; a word taken out meets the whole line, and the whole line meets those
    earliest = F.when(F.col("place") >= 0, F.col("part_at")).when(whole, F.col("part_at")).otherwise(F.col("whole_at"))
    pairs = met.select("at", earliest.alias("other")).where("other < at").distinct()
    joined = pairs.join(few, "at").join(few.select(F.col("at").alias("other"), F.col("w").alias("v")), "other")
    return joined.where(_one_edit(F.col("w"), F.col("v"))).select("at").distinct()


def _with(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """found (doc_id, text_hash, more) and the rows of docs, as structs called row, joined by both; found's id is called of_id."""
    found = found.withColumnRenamed("doc_id", "of_id")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("hash_of_row"))
    return rows.join(found, F.col("row.doc_id").cast("long").eqNullSafe(found.of_id) & (F.col("hash_of_row") == F.col("text_hash")), how)


def _one_edit(a: Column, b: Column) -> Column:
    """Whether at most one word put in, taken out or changed makes a of b: what is left between the words that both begin
    with and the words that both end with is at most one word on either side."""
    short = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), short), lambda k: (k >= F.size(a)) | (k >= F.size(b)) | (F.get(a, k) != F.get(b, k)))
    head = F.least(short, F.get(differs, F.lit(0)))
    rest_a, rest_b = F.slice(a, head + 2, F.greatest(F.size(a) - head - 1, F.lit(0))), F.slice(b, head + 2, F.greatest(F.size(b) - head - 1, F.lit(0)))
    from_a, from_b = F.slice(a, head + 1, F.size(a) - head), F.slice(b, head + 1, F.size(b) - head)
    return (rest_a == rest_b) | (rest_a == from_b) | (from_a == rest_b)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, more) with text less its repeated and near-repeated lines, and n_lines, n_kept (blank ones
    included in both)."""
    seen = staged(occurrences(docs), "occurrences")
    firsts = seen.groupBy("a", "b").agg(F.min("at").alias("at"))
    gone = near_earlier(docs, seen, firsts)
    kept = firsts.select("at").join(gone, "at", "left_anti").select("at.*").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("pos")).alias("kept"))
    # blank lines and kept ones, in their order; the array of one array binds the cut text
    def staying(all: Column) -> Column:
        blank = F.filter(F.sequence(F.lit(0), F.size(all) - 1), lambda k: _blank(F.get(all, k)))
        return F.transform(F.sort_array(F.concat(blank, F.coalesce("kept", F.array().cast("array<int>")))), lambda k: F.get(all, k))

    stays = F.when(F.col("row.text").isNotNull(), F.get(F.transform(F.array(F.split("row.text", "\n")), staying), F.lit(0)))
    out = _with(docs, kept, "left").select("row", stays.alias("stays"))
    n_lines = F.octet_length("row.text") - F.octet_length(F.replace(F.col("row.text"), F.lit("\n"), F.lit(""))) + 1
    name = lambda c: f"doc_{c}" if c in ("n_lines", "n_kept") else c
    own = (F.array_join("stays", "\n").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(name(c)) for c in docs.columns)
    return out.select(*own, F.coalesce(F.when(F.col("row.text").isNotNull(), n_lines), F.lit(0)).alias("n_lines"), F.coalesce(F.when(F.col("row.text").isNotNull(), F.size("stays")), F.lit(0)).alias("n_kept"))


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_kept").cast("long").alias("n_kept"), F.char_length(kept).cast("long").alias("kept_chars"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
with t as (select doc_id, text, string_split(text, chr(10)) as ls from documents where text is not null),
p as (select doc_id, ls, unnest(range(1, len(ls) + 1)) as pos from t),
w as (select doc_id, pos, ls[pos] as line, list_filter(regexp_split_to_array(ls[pos], '\s+'), lambda x: x <> '') as w, doc_id * 1000000 + pos as o from p),
k as (select *, array_to_string(w, ' ') as key, len(w) as n from w),
d as (select key, min(o) as o, any_value(w) as w, any_value(n) as n from k where n > 0 group by key),
v as (select key, o, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:n]), ' ') as rest from (select *, unnest(range(1, n + 1)) as i from d where n >= 8)),
changed as (select o from (select o, min(o) over (partition by n, i, rest) as first from v) where first < o),
pairs as (select v.o as longer, d.o as shorter from v join d on d.key = v.rest where d.n >= 8),
gone as (select o from changed union select longer from pairs where shorter < longer union select shorter from pairs where longer < shorter),
kept as (select k.doc_id, k.pos, k.line from k left join d on d.o = k.o left join gone on gone.o = k.o where k.n = 0 or (d.o is not null and gone.o is null)),
texts as (select doc_id, string_agg(line, chr(10) order by pos) as text, count(*) as n from kept group by doc_id)
select x.doc_id, coalesce(len(t.ls), 0) as n_lines, coalesce(texts.n, 0) as n_kept, length(coalesce(texts.text, '')) as kept_chars, sha256(coalesce(texts.text, '')) as kept_sha256
from documents x left join t on t.doc_id = x.doc_id left join texts on texts.doc_id = x.doc_id
"""
