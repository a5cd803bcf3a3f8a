"""Redaction of personal data and secrets, one expression after another."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_A, _Z = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Reasons and patterns, in the order in which they apply. \b is written out as ASCII look-arounds where Java's
# own would be aware of other letters.
PATTERNS = (
    ("email", rf"(?iu)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{_Z}"),
    ("phone", r"(?<!\w)(?:\+?1[\s.\-]?)?(?:\(?\d{3}\)?[\s.\-]?)?\d{3}[\s.\-]?\d{4}(?!\w)"),
    ("openai_key", rf"{_A}sk-[A-Za-z0-9]{{16,}}{_Z}"),
    ("github_token", rf"{_A}(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{{20,}}{_Z}"),
    ("github_pat", rf"{_A}github_pat_[A-Za-z0-9_]{{20,}}{_Z}"),
    ("aws_access_key", rf"{_A}AKIA[0-9A-Z]{{16}}{_Z}"),
    ("slack_token", rf"{_A}xox(?:b|p|a|r|s)-[A-Za-z0-9-]{{10,}}\b"),
    ("bearer_token", rf"(?iu){_A}Bearer\s+[A-Za-z0-9._\-]{{16,}}\b"),
    ("api_key_assignment", rf"(?iu){_A}(?:api|access|secret)[_-]?key\s*[:=]\s*['\"]?[A-Za-z0-9._\-]{{12,}}['\"]?"),
    ("jwt_token", rf"{_A}eyJ[A-Za-z0-9_\-]{{10,}}\.[A-Za-z0-9_\-]{{10,}}\.[A-Za-z0-9_\-]{{10,}}\b"),
    ("private_key_block", r"-----BEGIN(?: RSA| EC| OPENSSH)? PRIVATE KEY-----[\s\S]*?-----END(?: RSA| EC| OPENSSH)? PRIVATE KEY-----"),
    ("iban", rf"{_A}[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}{_Z}"),
    ("credit_card", rf"{_A}(?:\d[ -]*?){{13,19}}{_Z}"),
    ("ipv4", rf"{_A}(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d){_Z}"),
)




def _possible(reason: str, text: Column) -> Column:
    """A cheap condition that every text with a match meets: most texts are spared the pattern itself. Of letters that match in
    either case only those without a third form (long s, dotless i, Kelvin sign) are asked for."""
    has = lambda *xs: functools.reduce(lambda a, b: a | b, (text.contains(x) for x in xs))
    match reason:
        case "email":
            return has("@")
        case "phone":
            return text.rlike(r"\d{3}[\s.\-]?\d{4}")
        case "bearer_token":
            return F.lower(text).contains("bearer")
        case "api_key_assignment":
            return has(":", "=") & F.lower(text).contains("ey")
        case "iban":
            return text.rlike(r"[A-Z]{2}\d{2}[A-Z0-9]{11}")
        case "credit_card":
            return text.rlike(r"\d[\d -]{11,}\d")
        case "ipv4":
            return text.rlike(r"\d\.\d{1,3}\.\d")
    known = {"openai_key": "sk-", "github_token": "gh", "github_pat": "github_pat_", "aws_access_key": "AKIA", "slack_token": "xox", "jwt_token": "eyJ", "private_key_block": "-----BEGIN"}
    return has(known[reason])


def should_scrub(context: Column, allowed: tuple[str, ...] = (), enabled: bool = True) -> Column:
    """Off when disabled or when the trimmed context is on the allow list; an empty context is scrubbed."""
    ctx = F.trim(F.coalesce(context, F.lit("")))
    return F.lit(enabled) & ((ctx == "") | ~ctx.isin(*allowed) if allowed else F.lit(enabled))


def _step(reason: str, pattern: str, when: Column, replacement: str) -> Callable[[Column], Column]:
    def run(x: Column) -> Column:
        text, hit = x["text"], when & _possible(reason, x["text"]) & x["text"].rlike(pattern)
        replaced = F.struct(F.regexp_replace(text, pattern, replacement).alias("text"), F.concat(x["reasons"], F.array(F.lit(reason))).alias("reasons"))
        return F.when(hit, replaced).otherwise(x)  # only what matches is replaced

    return run


def scrub(df: DataFrame, column: str, when: Column | None = None, replacement: str = "[REDACTED]", reasons: tuple[str, ...] | None = None) -> DataFrame:
    """df with the column redacted, and <column>_reasons (in pattern order). A null text stays null."""
    when = F.lit(True) if when is None else when
    safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
    state = F.struct(F.col(column).alias("text"), F.array().cast("array<string>").alias("reasons"))
    for reason, pattern in PATTERNS:
        if reasons is None or reason in reasons:
            # each step reads what the one before left by a lambda's name: as columns over a constant text, the optimizer would put
            # the steps into each other, four times each, 4^14 in all
            state = F.transform(F.array(state), _step(reason, pattern, when, safe)).getItem(0)
    df = df.withColumn("__scrubbed", state)
    return df.withColumns({f"{column}_reasons": F.col("__scrubbed.reasons"), column: F.col("__scrubbed.text")}).drop("__scrubbed")


def merge_tags(tags: Column, reasons: Column) -> Column:
    """tags, then pii:redacted and pii:<reason> if anything was redacted, without repeats."""
    known = F.coalesce(tags, F.array().cast("array<string>"))
    new = F.concat(F.array(F.lit("pii:redacted")), F.transform(reasons, lambda r: F.concat(F.lit("pii:"), r)))
    return F.when(F.size(reasons) > 0, F.concat(known, F.array_except(new, known))).otherwise(known)


def python_pattern(reason: str) -> re.Pattern:
    return re.compile(dict(PATTERNS)[reason].replace("(?iu)", "(?i)"))
