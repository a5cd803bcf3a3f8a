"""Chat trees, classifiers, exact search and the pipeline."""

import collections
import hashlib
import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from mnemolake.llm import chat, classify, nbsvm, topk

TURNS = "conv_id long, turn long, role string, text string, path string"


@given(st.one_of(st.text(), st.text("<\\|im_startend>", max_size=30), st.sampled_from(["<|im_end|>", "<\\|im_end|>", "<<|im_start|>\\"])))
def test_escapes_turn_back(text):
    assert chat.unescape(chat.escape(text)) == text and chat.START not in chat.escape(text) and chat.END not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


@pytest.fixture(scope="module")
def turns(spark):
    rows = []
    for c in range(60):
        rows += [(c, 0, "system", "be brief", "p"), (c, 1, "user", f"question {c % 4}", "p")]
        rows += [(c, 2, "assistant", f"answer {c % 8} <|im_end|> <\\|im_start|>", "p"), (c, 3, None, None, "p")] * (c % 3 > 0)
    rows += [(None, 0, "user", "nobody", "p"), (7, 1, "user", "question 3", "p"), (61, None, "a\nb\\", "", "p"), (62, 0, "assistant", "only", "p")]
    return spark.createDataFrame(rows, TURNS)


@pytest.mark.parametrize("limits", [{}, {"max_chars": 200}, {"max_members": 3}])
def test_chat_reads_back(turns, limits):
    talks = collections.defaultdict(list)
    for r in turns.collect():
        talks[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.read_back(chat.sequences(turns, **limits)).collect()}
    assert got.keys() == talks.keys()
    for c, own in talks.items():
        own = [x[2:] for x in sorted(own)]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(chat.turn_text(r, t)[0]) for r, t in own)


def test_shared_turns_stand_once(turns):
    (s,) = [r for r in chat.sequences(turns.coalesce(1)).collect() if len(r.conv_id) > 50] or [None]
    assert s.text.count("be brief") == 1 and s.text.count("question 1") == 1
    for k, spans in enumerate(s.attends):
        assert spans[-1] == s.node_end[k] and all(a < b for a, b in zip(spans, spans[1:]))
        up, length = k, 0
        while s.node_parent[up] >= 0:
            up = s.node_parent[up]
            length += s.node_end[up] - s.node_start[up]
        assert s.node_position[k] == length == sum(b - a for a, b in zip(spans[::2], spans[1::2])) - (s.node_end[k] - s.node_start[k])


def test_no_turns(spark):
    assert chat.sequences(spark.createDataFrame([], TURNS)).count() == 0


def plain_top(rows, k, every):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q in sorted({i for i, _ in whole if i % every == 0}):
        vector = min(v for i, v in whole if i == q)
        out[q] = sorted(((-sum(a * b for a, b in zip(vector, v)), i) for i, v in whole if i != q))[:k]
    return [(q, n, i, -s) for q, best in out.items() for n, (s, i) in enumerate(best, 1)]


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.1, 6).tolist()) for i in range(300)] + [(i, [0.1, 0.2, -0.1, 0.0, 0.0, 0.5]) for i in range(300, 400)]
    rows += [(400, None), (420, [0.1, None, 0.2]), (440, [float("nan")] * 6), (460, [float("inf")] * 6), (None, [0.1] * 6), (480, [0.0] * 6), (500, [0.5, 0.5]), (500, [0.1, 0.1]), (7, [0.3] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int").repartition(5)
    got = sorted(tuple(r) for r in topk.top_k(df).collect())
    assert got == sorted(plain_top(rows, 20, 20))
    few = df.where("vec_id < 8")
    assert sorted(tuple(r) for r in topk.top_k(few).collect()) == sorted(plain_top([r for r in rows if r[0] is not None and r[0] < 8], 20, 20))
    assert topk.top_k(df.where("false")).count() == 0


def test_huge_components(spark):
    """A finite component may be as large as it likes: its row is ranked, no row is left out, and the query does not stop."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, 3).tolist()) for i in range(60)] + [(60, [1e300, 1.0, -1e300]), (61, [-1e300, 0.0, 0.0]), (62, [1e15, 1.0, 1.0]), (80, [2e15, -1.0, 3.0])]
    end = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = [(i, [end(math.floor(64 * x)) for x in v]) for i, v in rows]
    want = []
    for q, v in whole:
        if q % 20 == 0:
            best = sorted((-end(sum(a * b for a, b in zip(v, w))), i) for i, w in whole if i != q)[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k=5)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(200):
        y.append(i % 2)
        rows.append(np.unique(np.append(rng.integers(10, 200, 20), i % 2)).astype(np.int32))
    model = nbsvm.fit(rows, np.array(y), 8)
    s = np.array([model.score(x) for x in rows])
    assert ((s > 0.5) == (np.array(y) == 1)).mean() > 0.97
    again = nbsvm.Model.unpack(model.pack())
    assert [again.score(x) for x in rows[:5]] == pytest.approx(s[:5])


@pytest.mark.parametrize("y", [[], [1, 1, 1], [0]])
def test_one_class_only(y):
    model = nbsvm.fit([np.array([1, 2])] * len(y), np.array(y), 8)
    assert 0 < model.score(np.zeros(0, np.int32)) < 1


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_classifiers(spark, kind, docs, none):
    import random

    rng = random.Random(3)
    bad = {"toxicity": " you utter blockhead ", "quality": " BUY!!! NOW!!! $$$ BUY!!! NOW!!! $$$ "}[kind]
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(60)]
        toxic = rng.random() < 0.3
        rows.append((i, " ".join(words[:30]) + (bad if toxic else " ") + " ".join(words[30:])))
        labels.append((i, int(not toxic), int(toxic)))
    data = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in getattr(classify, kind)(data, known).collect()}
    held = [i for i in got if got[i].held_out]
    assert 60 < len(held) < 200
    truth = {i: (t if kind == "toxicity" else q) for i, q, t in labels}
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    odd = getattr(classify, kind)(docs, known, keep=("text", "lang", "line"))
    assert odd.count() == docs.count() and all(0 <= r.score <= 1 for r in odd.collect())
    assert getattr(classify, kind)(none, known).count() == 0
    assert {r.score for r in getattr(classify, kind)(data.limit(5), known.where("false")).collect()} == {0.5}


def test_pipeline_keeps_and_drops(spark, tmp_path):
    import random

    import corpus_pipeline

    rng = random.Random(4)
    talk = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        kind = "toxic" if i % 10 == 1 else "junk" if i % 10 == 2 else "good"
        text = talk(80)
        text = text[:200] + " you utter blockhead " + text[200:] if kind == "toxic" else "BUY!!! NOW!!! $$$ " * 30 if kind == "junk" else text
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    shared = talk(40)
    rows += [(1000, rows[0][1], "en", "s", 5), (1001, talk(50) + "\n" + shared, "en", "s", 5), (1002, shared + "\n" + talk(50), "en", "s", 5), (1003, None, "en", "s", None), (1004, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {i for i in range(300) if i % 10 not in (1, 2)}
    assert not any(i % 10 == 1 for i in ids[0] if i < 300) and not any(i % 10 == 2 for i in ids[1] if i < 300)
    assert good <= ids[1] and good <= ids[3]
    assert 1000 not in ids[2]
    kept = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/line_dedup").where("doc_id in (1001, 1002)").collect()}
    assert shared in kept[1001] and shared not in kept[1002]
    total = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert total == spark.read.parquet(f"{tmp_path}/packing").count()


def test_simhash_rounds_send_nothing_through_the_driver(spark, monkeypatch):
    """Sides of joins that grow with the table merge, however small they are here."""
    from mnemolake.llm import simhash

    plans, stage = [], simhash.staged

    def told(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return stage(df, name)

    monkeypatch.setattr(simhash, "staged", told)
    docs = spark.createDataFrame([(k, f"a b c d e f {k // 3}") for k in range(30)], "doc_id long, text string")
    plans.append(simhash.near_duplicates(docs)._jdf.queryExecution().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
