"""Candidates of every source as rows of one shape, ready to be stored: one select for each source.

Ids are hashes of where a candidate comes from, so that a source read twice gives the same ids. Nulls: an absent column is
null; a null text is empty; an empty input gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import TIERS

CANDIDATE = "id, type, content, context, tier, agent, importance, category, tags, status, source_kind, source_path, confidence_score"
# What an extraction may say, and how distilled kinds are stored.
EXTRACTED_TYPES = ("fact", "decision", "learning", "gotcha", "note")
EXTRACTED_CATEGORIES = (
    "learning", "error", "feature_request", "correction", "knowledge_gap", "best_practice", "infrastructure", "project_registry", "personal", "financial",
    "contact", "preference", "goal", "relationship", "health", "business", "client", "deadline", "routine", "context",
)
DISTILLED_TYPE = {"error_fix": "gotcha", "decision": "decision", "complex_session": "note", "repeated_failure": "gotcha"}
DISTILLED_CATEGORY = {"error_fix": "error", "decision": "best_practice", "complex_session": "context", "repeated_failure": "error"}
# What a learning detail may say, its default first.
DETAIL_CATEGORIES = ("learning", "error", "feature_request", "correction", "knowledge_gap", "best_practice")
COMPLEXITIES, FREQUENCIES = ("medium", "simple", "complex"), ("first_time", "recurring")


def _rows(df: DataFrame, prefix: str, key: list[Column], **columns) -> DataFrame:
    """df as candidates: the named columns, null for the others."""
    columns["id"] = F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("\x1f", *(c.cast("string") for c in key))), 1, 16))
    kinds = {"importance": "int", "tags": "array<string>", "confidence_score": "double"}
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(*(as_column(columns.get(c)).cast(kinds.get(c, "string")).alias(c) for c in CANDIDATE.split(", ")))


def _tier(importance: Column) -> Column:
    return F.when(importance >= 7, "hot").otherwise("warm")


def _session_tag(session_id: Column) -> Column:
    return F.concat(F.lit("session:"), F.substring(session_id, 1, 8))


def one_of(value: Column, allowed: tuple[str, ...], default: str | None) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def agent_of(tags: Column) -> Column:
    """The agent that the first such tag names."""
    return F.get(F.transform(F.filter(tags, lambda t: t.startswith("agent:")), lambda t: F.substring(t, 7, 1 << 20)), F.lit(0))


def from_sessions(found: DataFrame) -> DataFrame:
    """found: session_id, agent, type, content, importance, category."""
    cut = F.when(F.char_length("content") > 1500, F.concat(F.left("content", F.lit(1499)), F.lit("…"))).otherwise(F.col("content"))
    tags = F.array(F.lit("auto-harvested"), F.concat(F.lit("agent:"), "agent"), _session_tag(F.col("session_id")))
    return _rows(found, "m_", [F.col("session_id"), F.col("content")], type=F.col("type"), content=cut, context=F.concat(F.lit("agent:"), "agent"),
                 tier=_tier(F.col("importance")), agent=agent_of(tags), importance=F.col("importance"), category=F.col("category"), tags=tags, status="pending")


def from_blocks(blocks: DataFrame) -> DataFrame:
    """blocks: workspace, heading, content, type, importance, category."""
    return _rows(blocks, "mb_", [F.col("workspace"), F.col("heading"), F.col("content")], type=F.col("type"), content=F.col("content"), context=F.col("workspace"), agent=F.col("workspace"),
                 tier=_tier(F.col("importance")), importance=F.col("importance"), category=F.col("category"), tags=F.array(F.lit("memory-bridge"), F.col("heading")), status="pending")


def from_entries(entries: DataFrame) -> DataFrame:
    """entries: path, agent, heading, text, type, importance (see `entries`)."""
    return _rows(entries, "m_md_", [F.col("path"), F.col("heading"), F.col("text")], type=F.col("type"), content=F.concat(F.lit("["), "heading", F.lit("] "), "text"), context=F.concat(F.lit("agent:"), "agent"),
                 agent=F.col("agent"), tier=_tier(F.col("importance")), importance=F.col("importance"), tags=F.array(F.lit("markdown-import")), status="pending", source_kind="markdown_import", source_path=F.col("path"))


def from_facts(facts: DataFrame) -> DataFrame:
    """facts: session_id, agent, type, content, context, tier, importance, category, tags."""
    return _rows(facts, "fact_", [F.col("session_id"), F.col("content")], type=F.col("type"), content=F.col("content"), context=F.coalesce("context", F.lit("project:global")), agent=F.col("agent"),
                 tier=F.coalesce("tier", F.lit("hot")), importance=F.coalesce("importance", F.lit(8)), category=F.coalesce("category", F.lit("infrastructure")),
                 tags=F.array_append(F.coalesce("tags", F.array().cast("array<string>")), _session_tag(F.col("session_id"))), status="pending")


def from_extraction(found: DataFrame) -> DataFrame:
    """found: session_id, agent, type, content, context, tier, importance (text), category, as a model wrote them: what it may
    not say becomes the default, importance is clamped to 1..10, texts are cut."""
    whole = F.regexp_extract(F.coalesce(F.col("importance").cast("string"), F.lit("")), r"^\s*([+-]?\d{1,9})", 1)
    n = F.try_to_number(F.when(whole != "", whole), F.lit("S999999999")).cast("int")
    n = F.greatest(F.lit(1), F.least(F.lit(10), F.when(n.isNull() | (n == 0), 5).otherwise(n)))
    context = F.when(F.coalesce("context", F.lit("")) == "", F.concat(F.lit("agent:"), "agent")).otherwise(F.col("context"))
    return _rows(found, "dist_", [F.col("session_id"), F.col("content")], type=one_of(F.col("type"), EXTRACTED_TYPES, "note"), content=F.left(F.coalesce("content", F.lit("")), F.lit(2000)), context=F.left(context, F.lit(200)),
                 tier=one_of(F.col("tier"), TIERS, "warm"), agent=F.col("agent"), importance=n, category=one_of(F.col("category"), EXTRACTED_CATEGORIES, None),
                 tags=F.array(F.lit("distilled"), F.concat(F.lit("agent:"), "agent"), _session_tag(F.col("session_id"))), status="pending")


def from_distilled(found: DataFrame) -> DataFrame:
    """found: session_file, agent, kind, content, importance."""
    of = lambda values, other: F.coalesce(F.get(F.array(*(F.lit(v) for v in values.values())), F.array_position(F.array(*(F.lit(k) for k in values)), F.col("kind")).cast("int") - 1), F.lit(other))
    return _rows(found, "m_distill_", [F.col("session_file"), F.col("content")], type=of(DISTILLED_TYPE, "note"), content=F.col("content"), tier="warm", agent=F.col("agent"), importance=F.coalesce("importance", F.lit(5)),
                 category=of(DISTILLED_CATEGORY, None), tags=F.array(F.lit("auto-distilled"), F.col("kind")), status="pending", source_kind="llm_distilled", source_path=F.col("session_file"), confidence_score=0.6)


def from_errors(errors: DataFrame) -> DataFrame:
    """errors: session_id, agent, command, code, pattern, message, snippet; what is too short to mean anything is left out."""
    no_code = F.col("code").isNull() | (F.col("code") == 0)
    command = F.concat(F.lit("Command failed (exit "), F.when(no_code, "?").otherwise(F.col("code").cast("string")), F.lit("): "), "command", F.lit("\n"), "snippet")
    other = F.concat(F.coalesce("pattern", F.lit("Error")), F.lit(": "), F.coalesce("message", F.lit("undefined")), F.lit("\n"), "snippet")
    rows = errors.withColumn("content", F.when(F.coalesce("command", F.lit("")) != "", command).otherwise(other)).where(F.char_length("content") >= 20)
    return _rows(rows, "m_err_", [F.col("session_id"), F.col("content")], type="gotcha", content=F.left("content", F.lit(2000)), tier="warm", agent=F.col("agent"), importance=6, category="error",
                 tags=F.array(F.lit("auto-harvested"), F.lit("error")), status="pending", source_kind="tool_verified")


def from_suggestions(suggestions: DataFrame) -> DataFrame:
    """suggestions: source, file, rule, reason, recurrence, ref. Without embedding."""
    content = F.concat(F.lit("[PROMOTION SUGGESTION] → "), "file", F.lit("\nRule: "), "rule", F.lit("\nReason: "), "reason", F.lit("\nRecurrence: "), F.col("recurrence").cast("string"), F.lit("x\nSource: "), "source", F.lit(" ("), F.coalesce("ref", F.lit("unknown")), F.lit(")"))
    return _rows(suggestions, "m_promo_", [F.col("source"), F.col("ref"), F.col("rule")], type="decision", content=content, tier="warm", agent="system", importance=7, category="best_practice",
                 tags=F.array(F.lit("promotion-suggestion"), F.lit("auto-promoter")), status="pending", source_kind="agent_inference")


def uncovered(memories: DataFrame, patterns: DataFrame) -> DataFrame:
    """Memories whose content no pattern's description says already."""
    return memories.join(patterns.select(F.col("description").alias("content")).distinct(), "content", "left_anti")


def parse_suggestion(content: Column, recurrence: Column) -> Column:
    """Struct of target_file, description, recurrence: read back from a suggestion's text, with defaults."""
    file = F.regexp_extract(content, r"→\s*(AGENTS\.md|TOOLS\.md|SOUL\.md)", 1)
    rule, n = F.regexp_extract(content, r"Rule:\s*(.+)", 1), F.regexp_extract(content, r"Recurrence:\s*(\d{1,9})x", 1)
    n = F.when(n != "", n).cast("int")
    return F.struct(
        F.when(file != "", file).otherwise("AGENTS.md").alias("target_file"), F.when(rule != "", rule).otherwise(F.left(content, F.lit(200))).alias("description"),
        F.coalesce(F.when(n != 0, n), F.when(recurrence != 0, recurrence), F.lit(3)).alias("recurrence"),
    )


def clean_detail(details: DataFrame) -> DataFrame:
    """Learning details with what they may not say set to the defaults."""
    out = details
    for c, allowed in (("category", DETAIL_CATEGORIES), ("complexity", COMPLEXITIES), ("frequency", FREQUENCIES)):
        out = out.withColumn(c, one_of(F.col(c), allowed, allowed[0]))
    return out.withColumn("related_files", F.coalesce("related_files", F.array().cast("array<string>")))


def entries(files: DataFrame, skip: str = r"(?i)^index$") -> DataFrame:
    """path, at, heading, text of files (path, content): a section starts at `## `; a bullet or a plain line starts an entry,
    an indented line goes on with it, an empty line ends it. Sections whose heading matches `skip` or starts with # are left
    out. Lines of one file are ordered within it."""
    cut = files.where("content is not null").select("path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    starts = F.col("line").startswith("## ")
    by_line = Window.partitionBy("path").orderBy("at")
    cut = cut.withColumn("section", F.sum(starts.cast("int")).over(by_line))
    in_section = Window.partitionBy("path", "section").orderBy("at")
    cut = cut.withColumns({"n": F.row_number().over(in_section), "heading": F.trim(F.regexp_replace(F.first("line").over(in_section), "^## ", ""))})
    body = cut.where((F.col("n") > 1) & ~F.col("heading").rlike(skip) & ~F.col("heading").startswith("#"))
    on = F.col("line").rlike(r"^\s{2,}\S")
    blank = F.col("line").rlike(r"^\s*$")
    body = body.withColumn("entry", F.sum((blank | ~on).cast("int")).over(in_section))
    text = F.when(on, F.trim("line")).otherwise(F.trim(F.regexp_replace("line", r"^[-•*]\s+", "")))
    parts = body.withColumn("text", text).where("text <> ''").groupBy("path", "section", "entry").agg(F.min("at").alias("at"), F.first("heading").alias("heading"), F.sort_array(F.collect_list(F.struct("at", "text"))).alias("all"))
    return parts.select("path", "at", "heading", F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("text"))
