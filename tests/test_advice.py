"""Advice, its cooldown across batches, packs beyond their budget, and what contradictions change."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from mnemolake.operators import advisory, curation, metrics

T0 = dt.datetime(2024, 1, 1)
MEMORY = "id string, type string, content string, context string, tier string, importance int, created_at timestamp_ntz, superseded_by string"


def plain_cooldown(rows, ms=300_000):
    last, out = {}, []
    for i, agent, tool, ts in sorted((r for r in rows if r[3]), key=lambda r: (r[3], r[0])):
        key = (agent or "unknown", tool)
        if key not in last or (ts - last[key]).total_seconds() * 1000 >= ms:
            last[key] = ts
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_cooldown_is_the_same_whatever_the_batches(spark, batch):
    rows = [(i, [None, "a", "unknown"][i % 3], [None, "exec"][i % 2], T0 + dt.timedelta(seconds=37 * (i * i % 101))) for i in range(200)]
    rows += [(900 + i, "a", "exec", None) for i in range(3)] + [rows[5], rows[5]]
    rows += [(1000 + i, "hot", "exec", T0 + dt.timedelta(seconds=i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id long, agent string, tool string, ts timestamp_ntz")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(r.event_id for r in advisory.cooldown(df).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == plain_cooldown(rows)
    assert not advisory.cooldown(df.where("false")).collect()


def test_cooldown_counts_whole_milliseconds_as_its_sql_does(spark):
    us = [0, 299_999_499, 299_999_500, 599_999_600, 900_000_100, 1_200_000_099, 1_200_001_000]
    rows = [(i, "a", "exec", T0 + dt.timedelta(microseconds=x)) for i, x in enumerate(us)]
    got = sorted(r.event_id for r in advisory.cooldown(spark.createDataFrame(rows, "event_id long, agent string, tool string, ts timestamp_ntz")).collect())
    last, want = None, []
    for i, *_, ts in rows:
        (ms,) = duckdb.execute("select epoch_ms($1::timestamp)", [ts]).fetchone()
        if last is None or ms - last >= 300_000:
            last = ms
            want.append(i)
    assert got == want == [0, 2, 3, 4, 5]


def plain_pack(context, rows, budget=800):
    """rows: (type, content) in order."""
    lines = []
    for kind, content in rows:
        text = (content or "").replace("\n", " ").strip()
        lines.append(f"- [{kind or 'note'}] " + (text if len(text) <= 200 else text[:199] + "…"))
    head = f"### {context} ({len(rows)} memories, avg importance 5.0)\n"
    if len(head + "\n".join(lines)) <= budget:
        return head + "\n".join(lines)
    out = head
    for line in lines:
        if len(out + line + "\n") > budget - 20:
            return out + f"- ... (+{len(lines) - lines.index(line)} more)"
        out += line + "\n"
    raise AssertionError


def test_packs_hold_all_lines_that_fit(spark):
    groups = {
        "few": [("fact", "one"), (None, None), ("", " \n two \n")], "short": [("a", "")] * 300, "long": [("note", "x" * 500)] * 6,
        "repeats": [("note", "same " * 8)] * 40, "mixed": [("note", "word " * (k % 30)) for k in range(50)],
        "edge": [("note", "y" * 150)] * 4 + [("note", "z" * 61)],
    }
    rows = [(f"{c}{k:04}", kind, text, c, "hot", 5, T0, None) for c, g in groups.items() for k, (kind, text) in enumerate(g)]
    rows += [("n0", "fact", "no context", None, "warm", 5, T0, None), ("n1", "fact", "blank context", "", "warm", 5, T0, None)]
    rows += [("cold", "fact", "cold", "few", "cold", 9, T0, None), ("gone", "fact", "gone", "few", "hot", 9, T0, "x"), ("old", "fact", "old", "few", "hot", 9, T0 - dt.timedelta(days=9), None)]
    df = spark.createDataFrame(rows, MEMORY)
    got = {r.context: r.pack for r in metrics.context_packs(df, F.lit(T0 + dt.timedelta(days=1)).cast("timestamp_ntz")).collect()}
    want = {c: plain_pack(c, g) for c, g in groups.items()} | {"unknown": plain_pack("unknown", [("fact", "no context"), ("fact", "blank context")])}
    assert got == want
    assert not metrics.context_packs(df.where("false"), F.lit(T0).cast("timestamp_ntz")).collect()


def test_no_source_no_advice(spark):
    memories = spark.createDataFrame([], "id string, type string, content string, importance int, score double, similarity double")
    paths = spark.createDataFrame([], "id string, problem string, solution string, outcome string, similarity double")
    found = spark.createDataFrame([], "pattern_key string, recurrence_count int, impact_score double, representative_content string")
    assert not advisory.advice(memories, paths, found).collect()
    found = spark.createDataFrame([("k", 4, None, None), ("j", 4, 2.0, "text")], found.schema)
    paths = spark.createDataFrame([("p", None, "s" * 120, "partial", 0.5)], paths.schema)
    (r,) = advisory.advice(memories, paths, found).collect()
    assert r.advisory_text == "🔄 Similar Past Paths (1):\n  • [partial|sim:0.50] N/A → " + "s" * 100 + "\n\n🔁 Recurring Patterns (2):\n  • [×4|impact:0.0] k\n  • [×4|impact:2.0] text"
    assert (r.confidence, r.source_memory_ids, r.sources) == (0.367, [], 3)


def test_a_keeper_takes_the_tags_of_its_last_loser(spark):
    memories = spark.createDataFrame([("a", None, ["x"]), ("b", None, ["y", "x"]), ("c", None, None), ("d", "e", ["z"])], "id string, superseded_by string, tags array<string>")
    judged = spark.createDataFrame([("b", "a", 0.9, 1, 2), ("c", "a", 0.9, 1, 3), ("a", "d", 0.9, 1, 4)], "loser string, keeper string, similarity double, ra int, rb int")
    got = {r.id: (r.superseded_by, r.tags) for r in curation.supersede_contradicted(memories, judged).collect()}
    assert got == {"a": ("d", ["x", "dedup_contradiction"]), "b": ("a", ["y", "x"]), "c": ("a", None), "d": ("e", ["z", "x", "dedup_contradiction"])}
