"""Texts for people and prompts: topic files, sections between markers, rule lists, evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import collapse, truncate_dots


def topic_texts(memories: DataFrame, limits: dict[str, int], title: str = "# {type}") -> DataFrame:
    """type, text: for each wanted type a heading and its best memories, or a heading that says there are none."""
    from .retrieval import per_type_top

    head = lambda t: title.replace("{type}", t)
    wanted = memories.sparkSession.createDataFrame([(t, head(t)) for t in limits], "type string, head string")
    best = per_type_top(memories, limits)
    block = F.concat(F.lit("- [imp:"), F.col("importance").cast("string"), F.lit("] "), truncate_dots(collapse(F.col("content")), 200))
    texts = best.groupBy("type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x.b), "\n").alias("body"))
    return wanted.join(texts, "type", "left").select("type", F.when(F.col("body").isNull(), F.concat("head", F.lit(" — None found"))).otherwise(F.concat_ws("\n", "head", "body")).alias("text"))


def replace_section(text: str, section: str, start: str, end: str) -> str:
    """The text with what stands between the last start marker and the end marker after it replaced, or with the section
    appended."""
    block = f"{start}\n{section}\n{end}"
    at = text.rfind(start)
    stop = text.find(end, at) if at >= 0 else -1
    if at < 0 or stop < 0:
        return f"{text.rstrip()}\n\n{block}\n" if text.strip() else f"{block}\n"
    return text[:at] + block + text[stop + len(end) :]


def add_rules(text: str, rules: list[str], header: str, footer: str) -> str:
    """Rules appended under the header, before the footer; one whose first 60 characters the text has already is left out."""
    low = text.lower()
    new = [r for r in dict.fromkeys(rules) if r[:60].lower() not in low]
    if not new:
        return text
    lines = "\n".join(f"- {r}" for r in new)
    if header in text and footer in text:
        at = text.rindex(footer)
        return f"{text[:at].rstrip()}\n{lines}\n{text[at:]}"
    return f"{text.rstrip()}\n\n{header}\n{lines}\n{footer}\n"


def eval_rows(memories: DataFrame, n: int = 80) -> DataFrame:
    """query (the first 120 characters on one line), expected_id and context of the most important active memories."""
    rows = memories.where("superseded_by is null").orderBy(F.desc("importance"), F.desc_nulls_last("last_seen"), "id").limit(n)
    return rows.select(F.left(collapse(F.col("content")), F.lit(120)).alias("query"), F.col("id").alias("expected_id"), "context")


def bootstrap_section(slots: DataFrame, own: int = 5, cross: int = 3) -> DataFrame:
    """One row of text from bootstrap slots (source, content, boosted): own ones first, each source cut to its number."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("boosted"), "id"))
    rows = slots.withColumn("rank", rank).where((F.col("rank") <= own) & (F.col("source") == "own") | (F.col("rank") <= cross) & (F.col("source") == "cross"))
    line = F.concat(F.lit("- "), truncate_dots(collapse(F.col("content")), 120))
    made = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((F.col("source") != "own").alias("late"), "rank", line.alias("l")))), lambda x: x.l), "\n")
    return rows.agg(F.when(F.count("*") == 0, F.lit("No memories yet.")).otherwise(made).alias("section"))
