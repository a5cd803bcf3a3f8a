"""Canned answers in, rows out, errors as rows."""

import json

import pytest

from mnemolake.operators import extract_model as x


class Canned:
    """Answers by the prompt's first word; some only after a failure or two, some never."""

    def ask(self, prompts):
        out = []
        for p in prompts:
            word = p.split()[0]
            if word == "refuse":
                raise x.Refused("401")
            if word == "break":
                raise TimeoutError("too slow")
            out.append({
                "list": json.dumps([{"content": f"c{i}", "importance": str(i)} for i in range(20)]), "object": json.dumps({"facts": [{"content": "f", "type": "fact", "tier": "odd", "category": "error"}, "no object"]}),
                "fence": '```json\n{"memories": [{"content": "m", "type": "weird", "importance": 99}]}\n```', "one": json.dumps({"content": "single"}), "prose": "I found nothing", "number": "5", "none": '{"items": []}', "blank": '[{"content": " "}]',
            }[word])
        return out


def ask(spark, prompts, **limits):
    df = spark.createDataFrame(list(prompts.items()), "key string, prompt string").coalesce(1)
    return x.ask_all(df, Canned(), limits=x.Limits(**{"batch": 1, "first_pause": 0.0} | limits))


def test_items_of_any_shape(spark):
    got = {}
    for r in ask(spark, {"a": "list", "b": "object", "c": "fence", "d": "one", "e": "none", "f": None}).collect():
        assert r.error is None and r.attempts == 1
        got.setdefault(r.key, []).append(json.loads(r.item)["content"])
    assert got == {"a": [f"c{i}" for i in range(15)], "b": ["f"], "c": ["m"], "d": ["single"]}


def test_errors_are_rows(spark):
    got = {r.key: (r.item, r.error.split(":")[0], r.attempts) for r in ask(spark, {"a": "prose", "b": "number", "c": "break it", "d": "one", "e": "refuse", "f": "one"}).where("error is not null").collect()}
    assert got == {"a": (None, "no JSON", 1), "b": (None, "no JSON", 1), "c": (None, "TimeoutError", 3), "e": (None, "refused", 1), "f": (None, "refused", 0)}
    assert x.ask_all(spark.createDataFrame([], "key string, prompt string"), Canned()).count() == 0


def test_attempts_and_pauses():
    class Third:
        n = 0

        def ask(self, prompts):
            self.n += 1
            if self.n < 3:
                raise OSError("busy")
            return ["ok"] * len(prompts) if self.n > 2 else []

    slept = []
    assert x.with_retries(Third(), ["p"], x.Limits(), slept.append) == (["ok"], None, 3) and slept == [1.0, 2.0]

    class Short:
        def ask(self, prompts):
            return []

    slept = []
    assert x.with_retries(Short(), ["p", "q"], x.Limits(attempts=5), slept.append)[1] == "0 answers to 2 prompts" and slept == [1.0, 2.0, 4.0, 8.0]


def test_answers_become_candidates(spark):
    answers = ask(spark, {"s1": "fence", "s2": "object", "s3": "blank", "s4": "prose"})
    sessions = spark.createDataFrame([(f"s{i}", "main") for i in range(1, 5)], "session_id string, agent string")
    got = {r.content: r for r in x.extracted_memories(sessions, answers).collect()}
    assert got.keys() == {"m", "f"}
    assert got["m"].type == "note" and got["m"].importance == 10 and got["f"].tier == "warm" and got["f"].category == "error" and got["f"].context == "agent:main"


@pytest.mark.parametrize("n", [0, 3, 9])
def test_trajectories_and_details(spark, n):
    steps = [{"action": f"a{i}", "result": "r"} for i in range(n)]
    rows = [("s", 0, json.dumps({"problem": "p", "outcome": "odd", "steps": steps})), ("t", 0, json.dumps({"solution": "x"}))]
    answers = spark.createDataFrame(rows, "key string, pos int, item string")
    (r,) = x.extracted_trajectories(answers).collect()
    assert r.session_id == "s" and r.outcome == "success" and [a.action for a in r.steps] == [f"a{i}" for i in range(min(n, 5))]
    details = spark.createDataFrame([("m", 0, json.dumps({"category": "odd", "complexity": "complex", "suggested_fix": "f"}))], "key string, pos int, item string")
    (d,) = x.extracted_details(details).collect()
    assert (d.category, d.complexity, d.frequency, d.suggested_fix) == ("learning", "complex", "first_time", "f")
