"""Column helpers: text, hashes, time, arrays and conditions, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import HIGH_RISK_TOOLS, TIER_BONUS, TIER_IMPACT


def truncate(text: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis if any were cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def truncate_lines(text: Column, n: int) -> Column:
    lines = F.split(text, "\r?\n")
    return F.when(F.size(lines) > n, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n…"))).otherwise(text)


def truncate_dots(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def truncate_flat(text: Column, n: int) -> Column:
    """On one line, trimmed, then cut."""
    return truncate_dots(F.trim(F.regexp_replace(text, r"\r?\n", " ")), n)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_key(type_: Column, content: Column, context: Column, agent: Column) -> Column:
    """The fingerprint of exact duplicates."""
    none = lambda c: F.coalesce(c, F.lit(""))
    return F.md5(F.concat_ws("|", none(type_), none(content), none(context), none(agent)).cast("binary"))


def sha_prefix(text: Column, n: int) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, n)


def sha1_id(prefix: str, *parts: Column, n: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, n))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "_")


def sentences(text: Column) -> Column:
    """The set of lower-cased sentences."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(text), r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != ""))


def first_rule(text: Column) -> Column:
    """The first sentence of more than 10 characters if it has at most 150, else the first 150 characters and dots."""
    first = F.get(F.filter(F.split(text, r"[.\n]"), lambda s: F.length(F.trim(s)) > 10), F.lit(0))
    return F.when(F.length(first) <= 150, F.trim(first)).otherwise(F.concat(F.trim(F.substring(text, 1, 150)), F.lit("...")))


def mask_credentials(url: Column) -> Column:
    return F.regexp_replace(url, "//[^@]+@", "//***@")


def word_overlap(a: Column, b: Column) -> Column:
    """Of the different words of a, the share that b has."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(words(a)), F.lit(1))


def add_tag(tags: Column, tag: Column) -> Column:
    known = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when(F.array_contains(known, tag), known).otherwise(F.array_append(known, tag))


def active(as_of: Column | None = None) -> Column:
    """Not superseded and, given a time, not expired by it."""
    ok = F.col("superseded_by").isNull()
    return ok if as_of is None else ok & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))) / F.lit(86400.0)


def tier_bonus(tier: Column) -> Column:
    out = F.lit(0.0)
    for name, value in TIER_BONUS.items():
        out = F.when(tier == name, F.lit(value)).otherwise(out)
    return out


def tier_impact(tier: Column) -> Column:
    out = F.lit(0.5)
    for name, value in TIER_IMPACT.items():
        out = F.when(tier == name, F.lit(value)).otherwise(out)
    return out


def high_risk(tool: Column) -> Column:
    return F.coalesce(tool.isin(*HIGH_RISK_TOOLS) | F.get(F.split(tool, " "), F.lit(0)).isin(*HIGH_RISK_TOOLS), F.lit(False))


def search_string(tool: Column, args: Column, project: Column, agent: Column) -> Column:
    """tool:, each string argument of fewer than 200 characters (or args as they are if they are no object), project:, agent:."""
    parsed = F.from_json(args, "map<string,string>")
    pairs = F.transform(F.filter(F.map_entries(parsed), lambda e: F.length(e.value) < 200), lambda e: F.concat(e.key, F.lit(":"), e.value))
    labelled = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}:"), c))
    return F.concat_ws(" ", labelled("tool", tool), F.when(F.size(pairs) > 0, F.concat_ws(" ", pairs)).otherwise(F.when(parsed.isNull(), args)), labelled("project", project), labelled("agent", agent))


def any_time(text: Column) -> Column:
    """ISO text or epoch milliseconds."""
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_millis(text.try_cast("long")))
