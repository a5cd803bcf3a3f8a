"""Storing candidate memories: quality gate, redaction, tags, embedding, dedupe by key or by meaning, merge, pattern rollup.

One batch gives what its rows would give one after another, in the order of their arrival (created_at, then id): a candidate
may match a memory that an earlier candidate of the batch made or changed. That order matters only among candidates that a
chain of likeness or of equal keys connects, so the batch is cut into those groups, without forming all pairs of a dense
group, and each is folded in its order. A group that is only copies of one text, or only candidates of one key, needs no fold:
all go where its first goes. What is folded is narrow (ids, keys, times, a vector for each different text); the stored rows come
from combining aggregates over what the folds decided."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Settings
from ..functions import pii, rules
from ..functions.columns import tier_impact
from ..functions.vectors import Embedder, embed_column, embedding_text
from ..sources.stages import staged
from . import merge
from .graph import connected
from .retrieval import multiplied, scoped_links, scoped_met


def prepare(candidates: DataFrame, settings: Settings = Settings(), embedder: Embedder | None = None) -> DataFrame:
    """Gated, redacted, tagged and, given an embedder, embedded candidates; skip says why one is left out. Under strict settings
    a text that is too short is left out too, which is otherwise stored with the least importance."""
    gate = rules.gate(F.col("content"), F.col("importance"))
    skip = F.coalesce(F.when(gate.length < 20, F.lit("content_too_short")), gate.skip) if settings.strict else gate.skip
    rows = candidates.withColumn("skip", skip).withColumn("importance", gate.importance.cast("int"))
    when = pii.should_scrub(F.col("context"), settings.allowed_contexts, settings.scrub)
    rows = pii.scrub(pii.scrub(rows.withColumn("__when", when), "content", F.col("__when"), settings.replacement), "context", F.col("__when"), settings.replacement)
    reasons = F.array_distinct(F.concat(F.coalesce("content_reasons", F.array().cast("array<string>")), F.coalesce("context_reasons", F.array().cast("array<string>"))))
    rows = rows.withColumn("tags", pii.merge_tags(F.col("tags"), reasons)).drop("content_reasons", "context_reasons", "__when")
    return rows.withColumn("embedding", embed_column(embedder)(embedding_text())) if embedder else rows


def _said(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def defaults(rows: DataFrame) -> DataFrame:
    """What a stored memory says where its candidate says nothing: lifecycle and provenance. Fixed values."""
    blank = {c: _said(c) for c in ("category", "pattern_key", "promoted_to", "resolution_notes", "source_path", "agent") if c in rows.columns}
    given = {"status": "pending", "tier": "warm", "source_kind": "agent_inference", "sensitivity": "normal"}
    rows = rows.withColumns(blank | {c: F.coalesce(_said(c), F.lit(v)) for c, v in given.items() if c in rows.columns})
    numbers = {"importance": 5, "confidence_score": 0.7}
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in numbers.items() if c in rows.columns})


def _scope(df: DataFrame) -> Column:
    return F.md5(F.to_json(F.struct(df["context"], df["category"])))  # a null is a value of its own: its field is left out


def _class(df: DataFrame) -> Column:
    """One for each scope and vector: copies are of one class."""
    return F.md5(F.to_json(F.struct(df["context"], df["category"], df["embedding"].cast("array<double>").alias("embedding"))))


def _open(memories: DataFrame, as_of: Column, settings: Settings) -> Column:
    return F.col("superseded_by").isNull() & (F.col("created_at") >= as_of - F.make_dt_interval(F.lit(settings.dedupe_days)))


def semantic_match(candidates: DataFrame, memories: DataFrame, as_of: Column, settings: Settings = Settings(), block: int = 1024) -> DataFrame:
    """cand_id, match, similarity: of each candidate's scope (context and category, null as a value of its own) and the recent
    days, the nearest open memory other than itself, if it is near enough; of equally near ones the latest seen.

    Different vectors only are compared, in blocks of a scope (a scope with a third of all rows is many blocks); of a pair of
    blocks each candidate keeps its best two and what is as like. Of memories with one vector the two latest seen stand for all."""
    recent = memories.where(_open(memories, as_of, settings) & F.col("embedding").isNotNull())
    seen = F.struct("last_seen", "created_at", "id")
    m = recent.select("id", "last_seen", "created_at", _class(recent).alias("class"), _scope(recent).alias("scope"), "embedding")
    c = candidates.where("embedding is not null").select("cand_id", _class(candidates).alias("class"), _scope(candidates).alias("scope"), "embedding")
    vectors = lambda df: df.groupBy(F.col("class").alias("id")).agg(F.any_value("scope").alias("scope"), F.any_value("embedding").alias("embedding"))

    near = multiplied(scoped_met(vectors(c), vectors(m), block), settings.dedupe_similarity, 2, False, inclusive=True, ties=True)
    one = m.groupBy("class").agg(F.max(seen).alias("a"))
    two = m.join(one, "class").where(F.col("id") != F.col("a.id")).groupBy("class").agg(F.max(seen).alias("b"))
    of = one.join(two, "class", "left").select(F.col("class").alias("other"), "a", "b")
    best = F.when(F.col("a.id") != F.col("cand_id"), F.col("a")).otherwise(F.col("b"))
    found = c.select("cand_id", F.col("class").alias("id")).join(near, "id").join(of, "other").withColumn("best", best).where("best is not null")
    return found.groupBy("cand_id").agg(F.max(F.struct("similarity", "best")).alias("m")).select("cand_id", F.col("m.best.id").alias("match"), F.col("m.similarity").alias("similarity"))


# Rows of the folds, in the order in which a group's are read.
VECTOR, MEMORY, CANDIDATE = 0, 1, 2
FOLDED = "group string, kind int, at timestamp_ntz, id string, key string, class string, scope string, embedding array<double>, open boolean, last_seen timestamp_ntz, created_at timestamp_ntz"
DECIDED = "cand_id string, final_id string, found boolean, method string"


class Live:
    """One group's memories while its candidates come one after another."""

    def __init__(self, threshold: float, replace: bool = True):
        self.threshold, self.replace = threshold, replace
        self.vectors: dict[str, np.ndarray | None] = {}
        self.scope_of: dict[str, str] = {}
        self.members: dict[str, dict[str, set]] = {}  # scope: class: ids of open memories that have that vector now
        self.seen: dict[str, tuple] = {}  # id: last seen, created
        self.now: dict[str, str | None] = {}  # id: class
        self.is_open: dict[str, bool] = {}
        self.keys: dict[str, set] = {}

    def vector(self, name: str, scope: str, values) -> None:
        v = np.array([np.nan if x is None else x for x in values], float)
        norm = np.linalg.norm(v)
        self.vectors[name], self.scope_of[name] = (v / norm if norm > 0 else None), scope

    def put(self, id_: str, name: str | None, key: str | None, is_open: bool, seen: tuple) -> None:
        if (was := self.now.get(id_)) is not None and self.is_open[id_]:
            of = self.members[self.scope_of[was]]
            of[was].discard(id_)
            if not of[was]:
                del of[was]
        self.now[id_], self.is_open[id_], self.seen[id_] = name, is_open, seen
        if name is not None and is_open and self.vectors.get(name) is not None:
            self.members.setdefault(self.scope_of[name], {}).setdefault(name, set()).add(id_)
        elif name is not None:
            self.now[id_] = None
        if key is not None:
            self.keys.setdefault(key, set()).add(id_)

    @staticmethod
    def _rank(t) -> tuple:
        return (t is not None and t == t, t if t is not None and t == t else 0)

    def _latest(self, ids: set) -> str:
        return max(ids, key=lambda i: (*map(self._rank, self.seen[i]), i))

    def nearest(self, name: str) -> str | None:
        v, of = self.vectors.get(name), self.members.get(self.scope_of.get(name, ""), {})
        same = [n for n in of if len(self.vectors[n]) == len(v)] if v is not None else []
        if not same:
            return None
        sim = np.round(np.stack([self.vectors[n] for n in same]) @ v, 9)
        best = sim.max()
        return self._latest(set().union(*(of[same[i]] for i in np.flatnonzero(sim == best)))) if best >= self.threshold else None

    def take(self, id_: str, key: str | None, name: str | None, last, created) -> tuple[str, str | None]:
        """Where a candidate goes, and how it was found (None: it is new)."""
        match = (self._latest(self.keys[key]) if self.keys.get(key) else None) if key is not None else self.nearest(name) if name is not None else None
        old = self.seen.get(match) if match is not None else None
        ranked = max(last, old[0], key=self._rank) if old else last
        if self.replace or match is None:
            self.put(match or id_, name, key, self.is_open[match] if old else True, (ranked, old[1] if old else created))
        return match or id_, None if match is None else "pattern_key" if key is not None else "semantic"


def decide(candidates: DataFrame, memories: DataFrame, as_of: Column, settings: Settings = Settings(), replace: bool = True) -> DataFrame:
    """cand_id, final_id, found, method for each candidate (id, pattern_key, context, category, embedding, created_at, last_seen):
    the memory that it becomes part of, or its own id. replace: a memory found takes the candidate's vector; otherwise it stays as
    it is, and the candidate is left aside."""
    c = staged(
        candidates.select(
            "id", F.coalesce("created_at", as_of).alias("at"), F.col("pattern_key").alias("key"), F.when(F.col("embedding").isNotNull(), _class(candidates)).alias("class"), _scope(candidates).alias("scope"),
            F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce("last_seen", as_of).alias("last_seen"),
        ), "candidates",
    )
    is_open = F.coalesce(_open(memories, as_of, settings), F.lit(False))
    m = memories.select(
        "id", F.col("pattern_key").alias("key"), F.when(F.col("embedding").isNotNull(), _class(memories)).alias("class"), _scope(memories).alias("scope"),
        F.col("embedding").cast("array<double>").alias("embedding"), is_open.alias("open"), "last_seen", "created_at",
    )
    vectors = lambda df: df.where("class is not null").groupBy("class").agg(F.any_value("scope").alias("scope"), F.any_value("embedding").alias("embedding"))
    keyless, keyed = c.where("key is null"), c.where("key is not null")
    every = staged(vectors(m.where("open").select("class", "scope", "embedding").union(c.select("class", "scope", "embedding"))), "vectors")
    as_rows = lambda df: df.select(F.col("class").alias("id"), "scope", "embedding")
    likeness = staged(scoped_links(as_rows(vectors(keyless)), as_rows(every), settings.dedupe_similarity).distinct(), "links")
    reached = likeness.select(F.col("b").alias("class")).distinct()

    # groups: classes that likeness connects, and keys with the classes that their candidates and memories have
    named = F.concat(F.lit("key:"), F.col("key"))
    keys = keyed.select("key").distinct()
    of_keys = m.where("open").select("key", "class").union(keyed.select("key", "class")).join(keys, "key", "left_semi").join(reached, "class", "left_semi")
    links = likeness.union(of_keys.select(named, "class")).union(keys.select(named, named))
    groups = staged(connected(links), "groups").select(F.col("id").alias("node"), F.col("root").alias("group"))
    node = F.when(F.col("key").isNotNull(), named).otherwise(F.col("class"))
    grouped = staged(c.drop("embedding").withColumn("node", node).join(groups, "node", "left").drop("node").withColumn("group", F.coalesce("group", F.concat(F.lit("alone:"), "id"))), "grouped")

    # of groups of copies, and of one key alone, the first is asked for all
    what = grouped.groupBy("group").agg(
        F.min(F.struct("at", "id")).alias("first"), (F.count("key") == 0).alias("no_key"), (F.count("key") == F.count("*")).alias("all_key"), F.min("class").alias("c0"), F.max("class").alias("c1"),
        F.min("key").alias("k0"), F.max("key").alias("k1"),
    )
    simple = F.coalesce((F.col("no_key") & (F.col("c0") == F.col("c1"))) | (F.col("all_key") & (F.col("k0") == F.col("k1"))), F.lit(False))
    what = staged(what.select("group", "first", simple.alias("simple")), "kinds")
    asked = grouped.join(what, "group").where(~F.col("simple") | (F.col("id") == F.col("first.id")))

    # what the folds read
    newest = Window.partitionBy("key").orderBy(F.desc_nulls_last("last_seen"), F.desc_nulls_last("created_at"), F.desc("id"))
    by_key = m.join(keys, "key", "left_semi").select("id", "key", "class", "open", "last_seen", "created_at").withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")
    by_key = by_key.join(groups, named == F.col("node")).drop("node")
    near = m.where("open").drop("embedding", "scope").join(reached, "class", "left_semi").join(groups, F.col("class") == F.col("node")).drop("node")
    # a simple group asks once: of memories with one vector the latest seen is enough
    one = near.join(what.where("simple").select("group"), "group", "left_semi").groupBy("group", "class").agg(F.max(F.struct("last_seen", "created_at", "id", "key", "open")).alias("x")).select("group", "class", "x.*")
    many = near.join(what.where("not simple").select("group"), "group", "left_semi")
    cols = ("group", "id", "key", "class", "open", "last_seen", "created_at")
    held = by_key.select(*cols).unionByName(one.select(*cols)).unionByName(many.select(*cols)).dropDuplicates(["group", "id"])
    nothing = lambda kind: F.lit(None).cast(kind)
    read = every.join(groups, F.col("class") == F.col("node")).select(
        "group", F.lit(VECTOR).alias("kind"), nothing("timestamp_ntz").alias("at"), nothing("string").alias("id"), nothing("string").alias("key"), "class", "scope", "embedding",
        nothing("boolean").alias("open"), nothing("timestamp_ntz").alias("last_seen"), nothing("timestamp_ntz").alias("created_at"),
    )
    read = read.unionByName(held.select(*cols).withColumns({"kind": F.lit(MEMORY), "at": nothing("timestamp_ntz"), "scope": nothing("string"), "embedding": nothing("array<double>")}))
    read = read.unionByName(asked.select("group", F.lit(CANDIDATE).alias("kind"), "at", "id", "key", "class", "scope", nothing("array<double>").alias("embedding"), F.lit(True).alias("open"), "last_seen", F.col("at").alias("created_at")))
    threshold = settings.dedupe_similarity

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, live = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.group != group:
                    group, live = r.group, Live(threshold, replace)
                if r.kind == VECTOR:
                    live.vector(r[5], r.scope, r.embedding)
                    continue
                key, name = (x if isinstance(x, str) else None for x in (r.key, r[5]))
                if r.kind == MEMORY:
                    live.put(r.id, name, key, bool(r.open), (r.last_seen, r.created_at))
                else:
                    final, method = live.take(r.id, key, name, r.last_seen, r.created_at)
                    out.append((r.id, final, method is not None, method))
            yield pd.DataFrame(out, columns=["cand_id", "final_id", "found", "method"])

    rows = read.select(*(x.split()[0] for x in FOLDED.split(", "))).repartition("group").sortWithinPartitions("group", "kind", "at", "id")
    first = staged(rows.mapInPandas(fold, DECIDED), "decided")
    # the others of a simple group follow its first: by then what it made or changed is there
    follow = grouped.join(what.where("simple"), "group").where(F.col("id") != F.col("first.id")).select(F.col("first.id").alias("of"), F.col("id").alias("other"), "key")
    followed = follow.join(first.select(F.col("cand_id").alias("of"), "final_id"), "of")
    return first.union(followed.select("other", "final_id", F.lit(True), F.when(F.col("key").isNotNull(), "pattern_key").otherwise("semantic")))


def recurrences(rows: DataFrame) -> DataFrame:
    """final_id, recurrence_count: what a memory's count becomes through its candidates (final_id, at, cand_id, n: their own count
    or null, old_n: the stored memory's, or null, known: whether the candidate found one), each making it one more, or its own if that is
    more. Long runs of one memory are cut into ranges; a range adds its length and the highest count that ends it."""
    part = rows.repartitionByRange("final_id", "at", "cand_id").withColumn("part", F.spark_partition_id())
    back = Window.partitionBy("final_id", "part").orderBy(F.desc("at"), F.desc("cand_id"))
    left = part.withColumn("later", F.row_number().over(back) - 1)
    ranges = left.groupBy("final_id", "part").agg(
        F.count("*").alias("m"), F.max(F.col("n") + F.col("later")).alias("b"), F.min(F.struct("at", "cand_id")).alias("at"), F.min_by("n", F.struct("at", "cand_id")).alias("n0"),
        F.max("old_n").alias("old_n"), F.min_by("known", F.struct("at", "cand_id")).alias("known"),
    )
    every = ranges.groupBy("final_id").agg(F.sort_array(F.collect_list(F.struct("at", "m", "b"))).alias("r"), F.min_by("n0", "at").alias("n0"), F.max("old_n").alias("old_n"), F.min_by("known", "at").alias("known"))
    # a new memory starts with its first candidate's own count, or 1: as one less would, made one more
    start = F.when(F.col("known"), F.coalesce("old_n", F.lit(1))).otherwise(F.coalesce("n0", F.lit(1)) - 1).cast("long")
    total = F.aggregate("r", start, lambda s, x: F.greatest(s + x.m, F.coalesce(x.b, s + x.m)))
    return every.select("final_id", total.cast("int").alias("recurrence_count"))


class Stored(NamedTuple):
    outcomes: DataFrame  # cand_id, id, dedupe_merged, dedupe_method, reason (why it was left out)
    memories: DataFrame  # the new snapshot
    patterns: DataFrame | None  # the new snapshot of patterns, where one was given


LAST = ("type", "content", "context", "tier", "agent", "importance", "embedding", "tags", "status", "category", "source_session")
FILLED = ("pattern_key", "resolved_at", "promoted_to", "resolution_notes", "source_kind", "source_path", "confidence_score", "expires_at", "sensitivity")


def store_all(candidates: DataFrame, memories: DataFrame, as_of: Column, settings: Settings = Settings(), embedder: Embedder | None = None, patterns: DataFrame | None = None) -> Stored:
    """Stores a batch. candidates have columns of memories, id among them (unique)."""
    absent = {c: F.lit(None).cast(memories.schema[c].dataType) for c in memories.columns if c not in candidates.columns}
    ready = staged(prepare(candidates.withColumns(absent) if absent else candidates, settings, embedder), "prepared")
    kept = defaults(ready.withColumn("said_tier", _said("tier")).where("skip is null").drop("skip"))
    decided = staged(decide(kept, memories, as_of, settings), "decided")
    at = F.struct(F.coalesce("created_at", as_of).alias("t"), F.col("id").alias("i"))
    rows = staged(kept.join(decided.withColumnRenamed("cand_id", "id"), "id").withColumn("order", at), "stored")
    last = [F.max_by(F.struct(c), "order")[c].alias(c) for c in LAST if c in memories.columns]  # a null is a value
    fill = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("order"))).alias(c) for c in FILLED if c in memories.columns]
    first_null = F.min_by(F.struct("first_seen"), "order")["first_seen"].isNull()
    agg = rows.groupBy(F.col("final_id").alias("id")).agg(*last, *fill, F.min("first_seen").alias("first_seen"), first_null.alias("first_null"), F.max(F.coalesce("last_seen", as_of)).alias("last_seen"), F.min(F.struct("order", F.coalesce("created_at", as_of).alias("c"))).getField("c").alias("created_at"))
    old = memories.select(F.col("id").alias("final_id"), F.col("recurrence_count").alias("old_n"), F.col("first_seen").alias("old_first"), F.lit(True).alias("known"))
    counted = rows.select("final_id", F.col("order.t").alias("at"), F.col("id").alias("cand_id"), F.col("recurrence_count").alias("n"), "pattern_key", "found")
    counted = counted.join(old.drop("old_first"), "final_id", "left").withColumn("known", F.coalesce("known", F.lit(False)) & F.col("found")).drop("found")
    times = recurrences(counted.drop("pattern_key")).withColumnRenamed("final_id", "id")
    new = agg.join(times, "id").join(old.drop("old_n").withColumnRenamed("final_id", "id"), "id", "left")
    begun = F.least("first_seen", F.when(F.col("first_null") & F.col("old_first").isNull(), as_of))
    new = new.withColumn("first_seen", begun).drop("old_first", "known", "first_null").withColumn("access_count", F.lit(0))
    snapshot = merge.merge(memories, new, ["id"], merge.MEMORY_RULES)
    reason = ready.where("skip is not null").select(F.col("id").alias("cand_id"), F.lit(None).cast("string").alias("id"), F.lit(False).alias("dedupe_merged"), F.lit(None).cast("string").alias("dedupe_method"), F.col("skip").alias("reason"))
    outcomes = decided.select("cand_id", F.col("final_id").alias("id"), F.col("found").alias("dedupe_merged"), F.col("method").alias("dedupe_method"), F.lit(None).cast("string").alias("reason")).unionByName(reason)
    return Stored(outcomes, snapshot, None if patterns is None else merge.merge(patterns, _pattern_rows(rows, counted, old, as_of), ["pattern_key"], merge.PATTERN_RULES))


def _pattern_rows(rows: DataFrame, counted: DataFrame, old: DataFrame, as_of: Column) -> DataFrame:
    """What the candidates with a key make of their patterns; a memory's count is taken as it was at its last keyed candidate."""
    keyed = rows.where("pattern_key is not null")
    until = keyed.groupBy("final_id").agg(F.max("order").alias("until"))
    told = counted.join(until, "final_id").where(F.struct(F.col("at").alias("t"), F.col("cand_id").alias("i")) <= F.col("until"))
    times = keyed.select("final_id", "pattern_key").distinct().join(recurrences(told.drop("until", "pattern_key")), "final_id").groupBy("pattern_key").agg(F.max("recurrence_count").alias("recurrence_count"))
    impact = F.col("importance") * tier_impact(F.col("said_tier"))
    seen = keyed.join(old.select("final_id", "old_first"), "final_id", "left").withColumn("first", F.coalesce("first_seen", "old_first", as_of))
    agg = seen.groupBy("pattern_key").agg(
        F.min("first").alias("first_seen"), F.max(F.coalesce("last_seen", as_of)).alias("last_seen"), F.max(impact.cast("double")).alias("impact_score"), F.min_by("final_id", "order").alias("representative_memory_id"),
        F.max_by("final_id", "order").alias("last_memory_id"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("order"))).alias(n) for c, n in (("category", "last_category"), ("status", "last_status"), ("promoted_to", "promoted_to"))),
    )
    return agg.join(times, "pattern_key")


def store(candidates: DataFrame, memories: DataFrame, as_of: Column, settings: Settings = Settings(), embedder: Embedder | None = None) -> DataFrame:
    """The new snapshot of memories."""
    return store_all(candidates, memories, as_of, settings, embedder).memories


def novel(candidates: DataFrame, memories: DataFrame, as_of: Column, threshold: float = 0.92) -> DataFrame:
    """candidates (id, created_at, embedding) with `twin`: the open memory of any scope and age, or the earlier novel candidate, that
    is as like as the threshold; null if there is none."""
    nothing = {c: F.lit(None).cast("string") for c in ("context", "category", "pattern_key")}
    rows = candidates.select("id", "created_at", "embedding").withColumns(nothing).withColumn("last_seen", F.col("created_at"))
    known = memories.select("id", "embedding", "superseded_by", "last_seen").withColumns(nothing).withColumn("created_at", as_of)
    got = decide(rows, known, as_of, Settings(dedupe_similarity=threshold), replace=False)
    return candidates.join(got.select(F.col("cand_id").alias("id"), F.when(F.col("found"), F.col("final_id")).alias("twin")), "id")
