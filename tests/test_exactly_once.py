"""Numbered snapshots, sessions distilled exactly once, the cooldown's state, late rows beside the others."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mnemolake import schemas
from mnemolake.functions.vectors import HashingEmbedder
from mnemolake.operators import advisory
from mnemolake.sources import snapshots
from mnemolake.sources.snapshots import Snapshots
from mnemolake.streaming import jobs, sessions

NOW = dt.datetime(2024, 4, 1)


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_a_reader_keeps_its_snapshot(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t")
    assert t.latest().number == 0 and t.latest().read(spark, "a", "id long").count() == 0
    one = t.commit(t.latest(), {"a": spark.range(3)})
    held = one.read(spark, "a")
    two = t.commit(one, {"a": spark.range(5)}, {"log": spark.range(1)}, {"x": 1})
    assert ids(held) == [0, 1, 2] and ids(t.latest().read(spark, "a")) == [0, 1, 2, 3, 4]
    three = t.commit(two, add={"log": spark.range(7, 9)})
    assert ids(t.latest().read(spark, "log")) == [0, 7, 8] and ids(t.at(2).read(spark, "log")) == [0] and three.info == {"x": 1}
    with pytest.raises(RuntimeError, match="another writer"):
        t.commit(two, {"a": spark.range(1)})
    t.vacuum(keep=2)
    assert ids(t.latest().read(spark, "a")) == [0, 1, 2, 3, 4] and t._numbers() == [2, 3]
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        held.count()


def test_a_lost_writer_leaves_the_snapshot_as_it_was(spark, tmp_path, monkeypatch):
    t = Snapshots(spark, f"file://{tmp_path}/t")
    t.commit(t.latest(), {"a": spark.range(3)})
    monkeypatch.setattr(snapshots.Snapshots, "_publish", lambda self, made: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        t.commit(t.latest(), {"a": spark.range(9)})
    monkeypatch.undo()
    assert ids(t.latest().read(spark, "a")) == [0, 1, 2]
    t.vacuum(1)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1 and t.commit(t.latest(), {"a": spark.range(1)}).number == 2


def session(folder, name, texts, agent="main"):
    path = folder / agent / "sessions"
    path.mkdir(parents=True, exist_ok=True)
    head = [{"type": "session", "cwd": f"/work/{name}"}]
    rows = [{"type": "message", "message": {"role": r, "content": [{"type": "text", "text": t}]}} for r, t in texts]
    (path / f"{name}.jsonl").write_text("\n".join(json.dumps(x) for x in head + rows) + "\n{broken\n")


def logs(folder):
    session(folder, "s1", [("user", "please build it all for me"), ("tool", "Error: build failed for the parser module"), ("assistant", "looking at the parser"), ("assistant", "fixed it by pinning the lexer"), ("user", "we decided to keep the lexer pinned from now on")])
    session(folder, "s2", [("tool", "Error: disk quota exceeded on the cache volume")] * 3 + [("user", "hm"), ("assistant", "I see")])
    session(folder, "s3", [("user", f"turn number {i}") for i in range(21)], "dev")
    session(folder, "short", [("user", "we decided to use spark")])
    session(folder, "beat", [("user", "we decided to go")] * 9, "heartbeat")


@pytest.fixture(scope="module")
def undisturbed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    logs(root)
    return root, run(spark, root, tmp_path_factory.mktemp("out"))


def sink(out):
    return sessions.SessionSink(f"file://{out}/tables", F.lit(NOW).cast("timestamp_ntz"), HashingEmbedder(64))


def run(spark, root, out, checkpoint="ck", batch=None):
    jobs.run_available(sessions.watch_sessions(spark, str(root)), f"{out}/{checkpoint}", batch or sink(out))
    return state(spark, out)


def state(spark, out):
    now = Snapshots(spark, f"file://{out}/tables").latest()
    memories = {r.id: (r.type, r.content, r.agent, r.recurrence_count, tuple(r.tags)) for r in now.read(spark, "memories", schemas.MEMORIES).collect()}
    return memories, sorted((r.path.rsplit("/", 1)[1], r.memories_created, r.memories_skipped) for r in now.read(spark, "ledger", sessions.LEDGER).collect())


def test_sessions_become_memories(undisturbed):
    memories, ledger = undisturbed[1]
    assert [x[0] for x in ledger] == ["s1.jsonl", "s2.jsonl", "s3.jsonl"] and ledger[0][1:] == (2, 0) and ledger[2][1:] == (1, 0)
    told = {m[1]: m for m in memories.values()}
    assert "Error: Error: build failed for the parser module\nFix: fixed it by pinning the lexer" in told
    assert told["Complex session (21 turns, 0 tool calls) in /work/s3. File: s3.jsonl"][2] == "dev"
    assert any(c.startswith("Repeated failure (×3): error  disk quota") for c in told) and not any("spark" in c or "to go" in c for c in told)


@pytest.mark.parametrize("when", ["before the record", "after the record"])
def test_a_batch_that_runs_twice_changes_nothing(spark, undisturbed, tmp_path, monkeypatch, when):
    root, want = undisturbed
    own = sink(tmp_path)
    if when == "before the record":
        monkeypatch.setattr(snapshots.Snapshots, "_publish", lambda self, made: (_ for _ in ()).throw(OSError("lost")))

    def dies(batch, number):
        own(batch, number)
        raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        run(spark, root, tmp_path, batch=dies)
    monkeypatch.undo()
    assert state(spark, tmp_path) == (({}, []) if when == "before the record" else want)
    assert run(spark, root, tmp_path) == want  # the same stream goes on
    assert run(spark, root, tmp_path, "another") == want  # and one that has lost its checkpoint adds nothing


def requests(spark, rows):
    return spark.createDataFrame(rows, "event_id long, agent string, tool string, ts timestamp_ntz")


def test_cooldown_over_many_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "a" if i % 3 else None, None if i % 7 == 0 else f"t{i // 120}", t + dt.timedelta(seconds=40 * i)) for i in range(600)]
    want = ids(advisory.cooldown(requests(spark, rows)))
    for k in range(12):
        requests(spark, rows[k * 50 : k * 50 + 50]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    import os
    import time

    for k, f in enumerate(sorted((f for f in os.listdir(f"{tmp_path}/in") if f.endswith(".parquet")), key=lambda f: spark.read.parquet(f"{tmp_path}/in/{f}").agg(F.min("event_id")).first()[0])):
        os.utime(f"{tmp_path}/in/{f}", (time.time() - 1000 + 10 * k,) * 2)  # files are taken in the order of their times
    seen = []
    q = jobs.run_available(jobs.cooldown(jobs.watch(spark, f"{tmp_path}/in", "event_id long, agent string, tool string, ts timestamp_ntz", max_files=1)), f"{tmp_path}/ck", lambda b, _: seen.extend(r.event_id for r in b.collect()))
    assert sorted(seen) == want and len(q.recentProgress) >= 12
    # ten keys in all; those of tools no longer used have ended with their cooldown
    rows_held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert len({r[1:3] for r in rows}) >= 12 and rows_held[-1] <= 6


def test_late_rows_land_beside_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    row = lambda i, k, h: (i, k, t + dt.timedelta(hours=h) if h is not None else None)
    batches = [[row(1, "a", 10), row(2, "a", 9), row(3, "b", 1), row(4, None, 10), row(5, "n", None)], [row(6, "c", 2), row(7, "c", 9.5), row(8, "a", 12)], [row(9, "z", 10.5), row(10, "d", 11), row(11, None, 12), row(12, "a", 9.2)], [row(13, "a", 60 * 24)]]
    df = [spark.createDataFrame(b, "event_id long, k string, ts timestamp_ntz") for b in batches]
    own = jobs.TwoWaySink(f"file://{tmp_path}/t", ["k"], "ts", "1 hour", "30 days")
    for n, b in enumerate(df):
        own(b, n)
        own(b, n)  # again, as after a lost checkpoint
    now = Snapshots(spark, f"file://{tmp_path}/t").latest()
    assert ids(now.read(spark, "rows").select("event_id")) == [2, 3, 4, 7, 10, 13]
    assert ids(now.read(spark, "late").select("event_id")) == [5, 6, 9, 12]
    assert now.number == 4


def test_two_way_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    own = jobs.TwoWaySink(f"file://{tmp_path}/t", ["event_id"], "ts")
    for hours in ([5, 6, 7], [2, 8], [6.5, 7.5]):
        spark.createDataFrame([(int(h * 10), t + dt.timedelta(hours=h)) for h in hours], "event_id long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.run_available(jobs.watch(spark, f"{tmp_path}/in", "event_id long, ts timestamp_ntz"), f"{tmp_path}/ck", own)
    now = Snapshots(spark, f"file://{tmp_path}/t").latest()
    assert ids(now.read(spark, "rows").select("event_id")) == [50, 60, 70, 75, 80] and ids(now.read(spark, "late").select("event_id")) == [20, 65]


def test_unique_within_the_horizon(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t), (1, t + dt.timedelta(days=3)), (2, t)], "k long, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = []
    jobs.run_available(jobs.unique_within(jobs.watch(spark, f"{tmp_path}/in", "k long, ts timestamp_ntz"), ["k"], "ts"), f"{tmp_path}/ck", lambda b, _: out.extend(r.k for r in b.collect()))
    assert sorted(out) == [1, 2]
