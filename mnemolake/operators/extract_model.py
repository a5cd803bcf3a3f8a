"""Extraction by a language model behind a protocol: prompts in, answers out; answers parsed and held to the data model, errors as
rows. The calls are the caller's: nothing here knows a service. A task asks for a bounded number of prompts at a time, tries a
bounded number of times with growing pauses, and turns what still fails into a row that says so, so that one bad answer neither
stops a job nor is lost."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import adapters

#: Kinds of extraction, the prompts' instructions, and how many items an answer may have. Fixed values.
MOST_MEMORIES, MOST_STEPS = 15, 5
LISTS = ("memories", "facts", "items")
ANSWERS = "key string, pos int, item string, error string, attempts int"


class Refused(Exception):
    """The service does not let this caller in: trying again is no use."""


class Model(Protocol):
    def ask(self, prompts: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class Limits:
    batch: int = 16
    attempts: int = 3
    first_pause: float = 1.0
    longest_pause: float = 10.0


def parse_items(answer: str | None, most: int) -> list[dict]:
    """The objects of an answer: a list, an object with one of LISTS, or one object; a fence of three backticks around it does not
    count. More than `most` are cut. Raises ValueError where there is none."""
    text = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", answer or "")
    found = json.loads(text)
    if isinstance(found, dict):
        found = next((found[k] for k in LISTS if isinstance(found.get(k), list)), [found])
    if not isinstance(found, list):
        raise ValueError("neither a list nor an object")
    return [x for x in found if isinstance(x, dict)][:most]


def with_retries(model: Model, prompts: list[str], limits: Limits, sleep: Callable[[float], None] = time.sleep) -> tuple[list[str | None], str | None, int]:
    """The answers, or what went wrong with all of them, and the attempts made."""
    said = None
    for attempt in range(1, limits.attempts + 1):
        try:
            answers = model.ask(prompts)
            if len(answers) == len(prompts):
                return answers, None, attempt
            said = f"{len(answers)} answers to {len(prompts)} prompts"
        except Refused as e:
            return [None] * len(prompts), f"refused: {e}", attempt
        except Exception as e:  # noqa: BLE001  whatever a client raises becomes a row
            said = f"{type(e).__name__}: {e}"
        if attempt < limits.attempts:
            sleep(min(limits.first_pause * 2 ** (attempt - 1), limits.longest_pause))
    return [None] * len(prompts), said, limits.attempts


def ask_all(prompts: DataFrame, model: Model, most: int = MOST_MEMORIES, limits: Limits = Limits()) -> DataFrame:
    """key, pos, item (JSON), error, attempts of prompts (key, prompt): a row for each item, or one with the error; none for a null
    prompt. A refusal is not asked again within the task: its later prompts are refused rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refused = None
        for whole in batches:
            for at in range(0, len(whole), limits.batch):
                part = whole.slice(at, limits.batch)
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                answers, error, tries = ([None] * len(keys), refused, 0) if refused else with_retries(model, texts, limits)
                refused = error if error and error.startswith("refused") else refused
                out = []
                for key, answer in zip(keys, answers, strict=True):
                    if error:
                        out.append((key, None, None, error, tries))
                        continue
                    try:
                        out += [(key, i, json.dumps(x, ensure_ascii=False), None, tries) for i, x in enumerate(parse_items(answer, most))]
                    except ValueError as e:
                        out.append((key, None, None, f"no JSON: {e}", tries))
                cols = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "pos", "item", "error", "attempts"])

    return prompts.where("prompt is not null").select(F.col("key").cast("string").alias("key"), "prompt").mapInArrow(run, ANSWERS)


def extracted_memories(sessions: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates from answers (ask_all; key: session_id) about sessions (session_id, agent): what a model may not say becomes the
    default (adapters.from_extraction); items without content are left out."""
    item = F.from_json("item", "type string, content string, context string, tier string, importance string, category string")
    rows = answers.where("item is not null").select(F.col("key").alias("session_id"), item.alias("x")).select("session_id", "x.*").where(F.trim(F.coalesce("content", F.lit(""))) != "")
    return adapters.from_extraction(rows.join(sessions.select("session_id", "agent"), "session_id"))


def extracted_trajectories(answers: DataFrame) -> DataFrame:
    """session_id, problem, solution, outcome, steps (MOST_STEPS at most) of answers; without a problem there is no trajectory."""
    item = F.from_json("item", "problem string, solution string, outcome string, steps array<struct<action: string, result: string>>")
    rows = answers.where("item is not null").select(F.col("key").alias("session_id"), item.alias("x")).select("session_id", "x.*").where(F.trim(F.coalesce("problem", F.lit(""))) != "")
    outcome = F.when(F.col("outcome").isin("success", "partial", "failed"), F.col("outcome")).otherwise("success")
    return rows.withColumns({"outcome": outcome, "steps": F.slice(F.coalesce("steps", F.array().cast("array<struct<action: string, result: string>>")), 1, MOST_STEPS)})


def extracted_details(answers: DataFrame) -> DataFrame:
    """Learning details of answers (key: memory_id), cleaned as adapters.clean_detail does."""
    item = F.from_json("item", "category string, what_was_wrong string, what_is_correct string, error_message string, command_attempted string, suggested_fix string, complexity string, frequency string")
    rows = answers.where("item is not null").select(F.col("key").alias("memory_id"), item.alias("x")).select("memory_id", "x.*")
    known = lambda c, allowed: adapters.one_of(F.col(c), allowed, allowed[0])
    return rows.withColumns({"category": known("category", adapters.DETAIL_CATEGORIES), "complexity": known("complexity", adapters.COMPLEXITIES), "frequency": known("frequency", adapters.FREQUENCIES)})
