"""Session files found by metadata alone; only those that are wanted are read."""

import os

import pytest
from pyspark.sql import functions as F

from mnemolake.sources import discovery


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    root = tmp_path_factory.mktemp("agents")
    for k, (agent, name, size) in enumerate([("main", "a.jsonl", 900), ("main", "b.jsonl", 100), ("dev", "c.jsonl", 700), ("heartbeat", "d.jsonl", 800), ("dev", "e.ndjson", 600), ("dev", "f.txt", 600)]):
        folder = root / agent / "sessions"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("x" * (size - 2) + "\ny")
        os.utime(folder / name, (1_700_000_000 + 1000 * k,) * 2)
    other = tmp_path_factory.mktemp("other")
    (other / "deep").mkdir()
    (other / "deep" / "g.ndjson").write_text('{"a":1}\n\n{"b":2}\n')
    os.utime(other / "deep" / "g.ndjson", (1_700_100_000,) * 2)
    return str(root), str(other)


def names(df):
    return [r.path.rsplit("/", 1)[1] for r in df.collect()]


def test_by_time_size_number_and_agent(spark, roots):
    found = lambda *a, **k: names(discovery.discover(spark, *a, **k))
    assert found(roots[0]) == ["c.jsonl", "b.jsonl", "a.jsonl"]  # the newest first, no heartbeat
    assert found(roots[0], since=F.timestamp_seconds(F.lit(1_700_001_000))) == ["c.jsonl", "b.jsonl"]
    assert found(roots[0], above=500) == ["c.jsonl", "a.jsonl"] and found(roots[0], above=500, newest=1) == ["c.jsonl"]
    assert found(roots[0], agent="main") == ["b.jsonl", "a.jsonl"] and found(roots[0], agent="none") == []
    assert found([*roots, "/none/such"], pattern="*.{jsonl,ndjson}") == ["g.ndjson", "e.ndjson", "c.jsonl", "b.jsonl", "a.jsonl"]
    assert found(roots[0], skipped=()) == ["d.jsonl", "c.jsonl", "b.jsonl", "a.jsonl"] and found("/none/such") == []
    done = discovery.discover(spark, roots[0], agent="dev").select("path")
    assert found(roots[0], done=done) == ["b.jsonl", "a.jsonl"]


def test_content_is_not_read(spark, roots):
    plan = discovery.discover(spark, roots[0], above=10)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan and "content" not in plan.replace("contents", "")


def test_only_found_files_are_read(spark, roots):
    lines = discovery.read_found(spark, discovery.discover(spark, roots, pattern="*.{jsonl,ndjson}", newest=2))
    assert sorted(f.rsplit("/", 1)[1] for f in lines.inputFiles()) == ["e.ndjson", "g.ndjson"]
    got = sorted((r.session_id, r.agent, r.pos, r.line[:7]) for r in lines.collect())
    assert got == [("e", "dev", 0, "xxxxxxx"), ("e", "dev", 1, "y"), ("g", "", 0, '{"a":1}'), ("g", "", 2, '{"b":2}')]
    assert discovery.read_found(spark, discovery.discover(spark, "/none/such")).count() == 0
    assert len(discovery.read_found(spark, discovery.discover(spark, roots[0]), most=1).inputFiles()) == 1
