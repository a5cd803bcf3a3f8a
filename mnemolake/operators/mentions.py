"""Which keys a text mentions: a join by LIKE '%key%', for many keys and many texts.

A theta join has no equal keys to deal rows out by. Here each key is known by one run of GRAM characters that it contains
literally, the one that fewest texts have; a text names the runs that it contains, as hashes. Equal hashes meet, and the text is
fetched for what has met, once for each text, to be held to the key. Keys without such a run (short ones, or with wildcards all
over) are few kinds of strings; they go an exact other way, a packed list against each text. Nothing is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import staged

GRAM = 4
#: Keys without a literal run that one packed row holds.
PACK = 1000


def _grams(text: Column) -> Column:
    """The different runs of GRAM characters, as hashes; none in shorter texts."""
    places = F.sequence(F.lit(1), F.char_length(text) - (GRAM - 1))
    return F.when(F.char_length(text) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substring(text, i, F.lit(GRAM)))))).otherwise(F.array().cast("array<bigint>"))


def _literal(key: Column) -> Column:
    """The runs of a LIKE pattern between its wildcards that can hold a gram. An escape ends a run and takes the character after
    it along: what is left on both sides stands literally in each text that matches."""
    return F.filter(F.split(key, r"\\.|[%_\\]"), lambda x: F.char_length(x) >= GRAM)


def mentions(texts: DataFrame, keys: DataFrame, id: str = "id", how: str = "inner", pack: int = PACK) -> DataFrame:  # noqa: A002
    """texts (id, text, more) with each different key whose text contains it, text dropped; how 'left' keeps texts without any,
    with a null key. id is unique. `%`, `_` and `\\` in keys mean what they mean to LIKE, so that rows can multiply. Null texts
    and null keys match nothing; an empty key matches every text."""
    wanted = staged(keys.select("key").where("key is not null").distinct(), "keys")
    rows = staged(texts.select(id, "text").where("text is not null"), "texts")
    # one row for each different run of a text: hashes, not texts
    named = rows.select(id, F.explode(_grams(F.col("text"))).alias("gram"))
    of_keys = staged(wanted.select("key", F.explode(F.array_distinct(F.flatten(F.transform(_literal(F.col("key")), _grams)))).alias("gram")), "grams")
    asked = of_keys.select("gram").distinct()
    seen = staged(named.join(asked, "gram", "left_semi"), "seen")
    # a key is looked for by its rarest run; a run that no text has rules the key out
    counts = seen.groupBy("gram").agg(F.count("*").alias("n"))
    rare = of_keys.join(counts, "gram", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    rare = rare.where("m.n > 0").select("key", F.col("m.gram").alias("gram"))
    met = seen.join(rare, "gram").groupBy(id).agg(F.collect_set("key").alias("may"))  # keys that one text may hold
    like = lambda k: F.like(F.col("text"), F.concat(F.lit("%"), k, F.lit("%")))
    found = rows.join(met, id).select(id, F.explode(F.filter("may", like)).alias("key"))
    other = wanted.join(of_keys.select("key").distinct(), "key", "left_anti")
    packs = other.groupBy(F.pmod(F.xxhash64("key"), F.lit(max(1, -(-other.count() // pack)))).alias("pack")).agg(F.collect_list("key").alias("few"))
    short = rows.crossJoin(packs).select(id, F.explode(F.filter("few", like)).alias("key"))
    more = texts.drop("text", "key")
    return more.join(found.unionByName(short), id, how)
