"""A batch stored at once against the same rows stored one after another, in plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake import schemas
from mnemolake.config import Settings
from mnemolake.schemas import TIER_IMPACT
from mnemolake.operators import ingest
from mnemolake.operators.retrieval import forest

NOW = dt.datetime(2024, 4, 1)
DAY = dt.timedelta(days=1)
SETTINGS = Settings(scrub=False, dedupe_similarity=0.92, dedupe_days=30)
COLUMNS = [c.split()[0] for c in schemas.MEMORIES.replace("\n", " ").split(", ")]


def unit(v):
    n = np.linalg.norm(v) if v is not None else 0
    return np.array(v, float) / n if n > 0 else None


def one_after_another(memories, patterns, candidates):
    """What the store does with each candidate in turn."""
    held, told, outcome = {m["id"]: dict(m) for m in memories}, {p["pattern_key"]: dict(p) for p in patterns}, {}
    low = lambda t: (t is not None, t or NOW)
    for c in sorted(candidates, key=lambda c: (c["created_at"], c["id"])):
        text = c["content"].strip()
        if text.lower() in ("ok", "no"):
            outcome[c["id"]] = (None, False, None, "noise_pattern")
            continue
        importance = min(c["importance"] or 1, 1) if len(text) < 20 else c["importance"]
        key, found, method = c["pattern_key"] or None, None, None
        rank = lambda m: (*low(m["last_seen"]), *low(m["created_at"]), m["id"])
        if key:
            same = [m for m in held.values() if m["pattern_key"] == key]
            found, method = (max(same, key=rank), "pattern_key") if same else (None, None)
        elif (v := unit(c["embedding"])) is not None:
            near = []
            for m in held.values():
                recent = m.get("made_now") or (m["created_at"] is not None and m["created_at"] >= NOW - 30 * DAY)
                if m["superseded_by"] is None and recent and m["context"] == c["context"] and m["category"] == (c["category"] or None) and (w := unit(m["embedding"])) is not None and len(w) == len(v):
                    near.append((round(float(v @ w), 9), rank(m), m))
            if near and max(near)[0] >= 0.92:
                found, method = max(near, key=lambda x: x[:2])[2], "semantic"
        n = max((found["recurrence_count"] if found["recurrence_count"] is not None else 1) + 1, c["recurrence_count"] or 0) if found else (1 if c["recurrence_count"] is None else c["recurrence_count"])
        first = c["first_seen"] or (found and found["first_seen"]) or NOW
        last = c["last_seen"] or NOW
        m = found or {"id": c["id"], "made_now": True, "created_at": c["created_at"], "superseded_by": None, "access_count": 0}
        m |= {x: c[x] for x in ("type", "content", "context", "embedding", "tags")} | {"tier": c["tier"] or "warm", "agent": c["agent"] or None, "importance": 5 if importance is None else importance}
        m |= {"status": c["status"] or "pending", "category": c["category"] or None, "pattern_key": key or m.get("pattern_key"), "recurrence_count": max(n, m.get("recurrence_count") or n)}
        m |= {"first_seen": min(filter(None, (m.get("first_seen"), first))), "last_seen": max(filter(None, (m.get("last_seen"), last)))}
        m |= {"promoted_to": c["promoted_to"] or m.get("promoted_to"), "source_kind": c["source_kind"] or "agent_inference", "sensitivity": "normal", "confidence_score": 0.7 if c["confidence_score"] is None else c["confidence_score"]}
        held[m["id"]] = m
        outcome[c["id"]] = (m["id"], found is not None, method, None)
        if key:
            p = told.setdefault(key, {"pattern_key": key})
            most = lambda x, y: y if x is None else max(x, y)
            p["recurrence_count"], p["last_seen"] = most(p.get("recurrence_count"), n), most(p.get("last_seen"), last)
            p["first_seen"] = min(filter(None, (p.get("first_seen"), first)))
            p["impact_score"] = most(p.get("impact_score"), m["importance"] * TIER_IMPACT.get(c["tier"], 0.5))
            p["representative_memory_id"] = p.get("representative_memory_id") or m["id"]
            p["last_memory_id"], p["last_status"], p["last_category"] = m["id"], m["status"], m["category"] or p.get("last_category")
            p["promoted_to"] = c["promoted_to"] or p.get("promoted_to")
    return held, told, outcome


def blank(**said):
    return {c: None for c in COLUMNS} | said


def batch(seed, n_old, n_new, keys=4, scopes=2, dims=3, copies=False):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]

    def row(id_, old):
        v = rng.choice(centres)
        v = [float(np.float32(x + rng.gauss(0, 0.25))) for x in v] if not copies or rng.random() < 0.4 else [float(np.float32(x)) for x in v]
        v = rng.choice([v, v, v, v, v, v, [0.0] * dims, None, v[:2]])
        when = lambda: rng.choice([None, NOW - rng.randrange(60) * DAY])
        text = f"text of {id_} that is long enough" if rng.random() < 0.8 else rng.choice(["short", "ok", "no"]) if not old else "short"
        return blank(
            id=id_, type="note", content=text, context=rng.choice([None, "c"][:scopes]), tier=rng.choice([None, "hot", "cold", "odd"]), agent=rng.choice(["a", "", None]), importance=rng.choice([None, 2, 9]),
            embedding=v, created_at=NOW - rng.randrange(45) * DAY, superseded_by=rng.choice([None] * 6 + ["x"]) if old else None, tags=[id_], status=rng.choice([None, "resolved"]),
            category=rng.choice([None, "", "k"]) if not old else rng.choice([None, "k"]), pattern_key=rng.choice([None, None, *(f"p{i}" for i in range(keys))]) if keys else None,
            recurrence_count=rng.choice([None, 1, 3, 12]), first_seen=when(), last_seen=when(), promoted_to=rng.choice([None, None, "T.md"]), source_kind="tool_verified" if old else rng.choice([None, "", "consolidated"]),
            sensitivity="normal", confidence_score=rng.choice([None, 0.2]),
        )

    return [row(f"m{i:03}", True) for i in range(n_old)], [row(f"n{i:03}", False) for i in range(n_new)]


def frames(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], schemas.MEMORIES).repartition(3)


COMPARED = ("type", "content", "context", "tier", "agent", "importance", "tags", "status", "category", "pattern_key", "recurrence_count", "first_seen", "last_seen", "promoted_to", "source_kind", "confidence_score")


@pytest.mark.parametrize(("seed", "old", "new", "options"), [
    (1, 25, 60, {}), (4, 30, 90, {"copies": True}), (6, 12, 70, {"copies": True, "keys": 0, "scopes": 1}), (7, 20, 0, {}),
])
def test_batch_is_one_after_another(spark, seed, old, new, options):
    memories, candidates = batch(seed, old, new, **options)
    patterns = [{"pattern_key": "p1", "recurrence_count": 7, "first_seen": NOW - 50 * DAY, "last_seen": NOW - 40 * DAY, "impact_score": 3.5, "representative_memory_id": "m000", "last_memory_id": "m001", "last_category": "k", "last_status": "pending", "promoted_to": None}]
    held, told, outcome = one_after_another(memories, patterns, candidates)
    names = ["pattern_key", "recurrence_count", "first_seen", "last_seen", "impact_score", "representative_memory_id", "last_memory_id", "last_category", "last_status", "promoted_to"]
    known = spark.createDataFrame([(*(p[c] for c in names), None, None) for p in patterns], schemas.PATTERNS)
    got = ingest.store_all(frames(spark, candidates), frames(spark, memories), F.lit(NOW).cast("timestamp_ntz"), SETTINGS, patterns=known)
    assert {r.cand_id: (r.id, r.dedupe_merged, r.dedupe_method, r.reason) for r in got.outcomes.collect()} == outcome
    rows = {r.id: r for r in got.memories.collect()}
    assert rows.keys() == held.keys()
    touched = {o[0] for o in outcome.values()}
    for i in held:
        for c in COMPARED if i in touched else ("content", "last_seen"):
            assert rows[i][c] == held[i][c], (i, c)
    assert {r.pattern_key: tuple(r[c] for c in names) for r in got.patterns.collect()} == {k: tuple(p.get(c) for c in names) for k, p in told.items()}


def test_equal_candidates_of_one_batch_are_one_memory(spark):
    rows = [blank(id=f"n{i}", type="note", content="the same text, twice and more", embedding=[1.0, 2.0], created_at=NOW, tags=[]) for i in range(5)]
    got = ingest.store_all(frames(spark, rows), frames(spark, []), F.lit(NOW).cast("timestamp_ntz"), SETTINGS)
    (m,) = got.memories.collect()
    assert m.id == "n0" and m.recurrence_count == 5 and m.source_kind == "agent_inference" and m.confidence_score == 0.7 and m.status == "pending"


def test_strict_settings_refuse_what_is_too_short(spark):
    rows = [blank(id=i, type="note", content=t, embedding=[1.0, 2.0], created_at=NOW, tags=[]) for i, t in (("a", "short"), ("b", "ok"), ("c", "a text that is long enough"))]
    got = ingest.store_all(frames(spark, rows), frames(spark, []), F.lit(NOW).cast("timestamp_ntz"), Settings(strict=True))
    assert {r.cand_id: r.reason for r in got.outcomes.collect()} == {"a": "content_too_short", "b": "content_too_short", "c": None}
    assert [r.id for r in got.memories.collect()] == ["c"]


def test_a_hot_scope_and_a_hot_key_are_many_tasks(spark):
    """A third of all candidates are copies in the null scope, a third have one key: the folds get one of each."""
    rows = [blank(id=f"h{i:04}", type="note", content="a text that is long enough", embedding=[3.0, 4.0], created_at=NOW, tags=[]) for i in range(600)]
    rows += [blank(id=f"k{i:04}", type="note", content="another text, long enough", embedding=[-4.0, 3.0], created_at=NOW, tags=[], pattern_key="hot") for i in range(600)]
    rng = np.random.default_rng(1)
    rows += [blank(id=f"r{i:04}", type="note", content="one more text, long enough", context="x", embedding=rng.normal(0, 1, 2).tolist() + [float(i)], created_at=NOW, tags=[]) for i in range(300)]
    got = ingest.store_all(frames(spark, rows), frames(spark, []), F.lit(NOW).cast("timestamp_ntz"), SETTINGS)
    found = {r.id: r.recurrence_count for r in got.memories.where("id like 'h%' or id like 'k%'").collect()}
    assert found == {"h0000": 600, "k0000": 600}


def test_forest_connects_what_is_connected():
    rng = np.random.default_rng(3)
    for p in (0.0, 0.01, 0.05, 0.5, 1.0):
        near = rng.random((40, 30)) < p
        i, j = forest(near)
        assert near[i, j].all() and len(i) <= 70

        def parts(links):
            root = list(range(70))
            find = lambda x: x if root[x] == x else find(root[x])
            for a, b in links:
                root[find(a)] = find(40 + b)
            return [find(x) for x in range(70)]

        one, all_ = parts(zip(i, j)), parts(zip(*np.nonzero(near)))
        assert len(set(zip(one, all_))) == len(set(one)) == len(set(all_))


def test_semantic_match_of_the_latest_seen(spark):
    rows = [blank(id=i, context=x, embedding=v, created_at=NOW, last_seen=NOW - d * DAY) for i, x, v, d in (("a", None, [1.0, 0.0], 3), ("b", None, [1.0, 0.0], 1), ("c", "x", [1.0, 0.0], 0), ("d", None, [2.0, 0.0], 2), ("e", None, [0.0, 1.0], 0), ("f", None, [1.0, 0.0, 0.0], 0))]
    m = frames(spark, rows)
    got = {r.cand_id: (r.match, r.similarity) for r in ingest.semantic_match(m.withColumnRenamed("id", "cand_id"), m, F.lit(NOW).cast("timestamp_ntz"), SETTINGS, block=2).collect()}
    assert got == {"a": ("b", 1.0), "b": ("d", 1.0), "d": ("b", 1.0)}
