"""What texts mention: addresses, files, errors; and texts made of several."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PATH = r"(/[A-Za-z0-9_./-]+\.[A-Za-z0-9_]{1,10})"
URL = r"""(https?://[^\s"'<>\])+]+)"""
ERROR = r"((?:error|Error|ERROR|fail|FAIL|exception|Exception)[:\s].{10,120})"


def paths(text: Column) -> Column:
    """Different file paths in the order they come, without those of packages and overlong ones."""
    found = F.regexp_extract_all(text, F.lit(PATH), F.lit(1))
    return F.array_distinct(F.filter(found, lambda p: ~p.contains("node_modules") & (F.char_length(p) <= 120)))


def urls(text: Column) -> Column:
    """Different addresses without the punctuation that ends them."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:)]+$", "")))


def errors(text: Column, most: int = 5) -> Column:
    """The first errors that a text tells of."""
    return F.transform(F.slice(F.regexp_extract_all(text, F.lit(ERROR), F.lit(1)), 1, most), lambda e: F.trim(e))


def compressed(messages: Column, each: int = 800, most: int = 12_000) -> Column:
    """An array of structs (role, text) as one text: each message cut, ended once it is longer than `most`, then cut."""
    line = lambda m: F.concat(F.when(m["role"] == "user", "USER: ").otherwise("ASSISTANT: "), F.left(F.coalesce(m["text"], F.lit("")), F.lit(each)), F.lit("\n\n"))
    # every message adds 8 characters at least, so no more than this many can matter
    return F.left(F.array_join(F.transform(F.slice(messages, 1, most // 8 + 1), line), ""), F.lit(most))


def session_summary(agent: Column, turns: Column, texts: Column, found: Column, blockers: Column) -> Column:
    """What a session was about: turns, the last texts of middling length, first errors and blockers."""
    fit = F.filter(texts, lambda t: (F.char_length(t) > 80) & (F.char_length(t) < 2000))
    last = F.transform(F.slice(fit, F.greatest(F.size(fit) - 2, F.lit(1)), F.lit(3)), lambda t: F.left(t, F.lit(300)))
    named = lambda name, items: F.when(F.size(items) > 0, F.concat(F.lit(name), F.array_join(F.slice(items, 1, 2), "; ")))
    head = F.concat(F.lit("Agent "), agent, F.lit(" session with "), turns.cast("string"), F.lit(" turns."))
    return F.left(F.concat_ws(" ", head, F.when(F.size(fit) > 0, F.left(F.array_join(last, " "), F.lit(600))), named("Errors: ", found), named("Blockers: ", blockers)), F.lit(1200))
