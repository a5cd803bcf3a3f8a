"""Settings as a frozen record, read from a mapping of strings; nothing here touches the environment by itself."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

_TRUE, _FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def parse_bool(text: str | None, default: bool) -> bool:
    word = (text or "").strip().lower()
    return True if word in _TRUE else False if word in _FALSE else default


@dataclass(frozen=True)
class Settings:
    scrub: bool = True
    replacement: str = "[REDACTED]"
    allowed_contexts: tuple[str, ...] = ()
    dedupe_similarity: float = 0.92
    dedupe_days: int = 30
    strict: bool = False

    @classmethod
    def of(cls, values: Mapping[str, str]) -> Settings:
        d = cls()
        number = lambda k, f, x: f(values[k]) if values.get(k, "").strip() else x
        return cls(
            parse_bool(values.get("scrub"), d.scrub), values.get("replacement") or d.replacement, tuple(x.strip() for x in values.get("allowed_contexts", "").split(",") if x.strip()),
            number("dedupe_similarity", float, d.dedupe_similarity), number("dedupe_days", int, d.dedupe_days), parse_bool(values.get("strict"), d.strict),
        )


def parse_args(argv: list[str]) -> dict[str, str | bool]:
    """--name value, --name=value, and --flag."""
    out: dict[str, str | bool] = {}
    i = 0
    while i < len(argv):
        word = argv[i]
        if word.startswith("--"):
            name, eq, value = word[2:].partition("=")
            if not eq and i + 1 < len(argv) and not argv[i + 1].startswith("--"):
                i += 1
                value, eq = argv[i], "="
            out[name] = value if eq else True
        i += 1
    return out
