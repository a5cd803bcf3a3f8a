"""Capped breadth-first walks over links, as if one start after another had taken its members, in rounds over all starts.

What a walk gives depends only on which nodes earlier starts took. So each node carries its claim, the earliest start whose
walk holds it; in a round every start walks around the nodes that the claims of the round before give to earlier starts,
and new claims follow. The earliest start is right after the first round, and each start is right one round after all it
depends on; where no claim changes any more, all walks are those of the sequence, which is the only solution. After the
first round only starts walk again that a changed claim touches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import discard, staged
from .graph import connected


def _claims(walks: DataFrame) -> DataFrame:
    """member, claim: the key of the earliest start whose walk holds the member; combined before the shuffle."""
    return walks.select("key", F.explode("own").alias("member")).groupBy("member").agg(F.min("key").alias("claim"))


def _free(claim: Column, key: Column) -> Column:
    return claim.isNull() | (claim >= key)


def _walk(starts: DataFrame, out: DataFrame, claims: DataFrame, most: int) -> DataFrame:
    """id, key, own: the walk of each of starts (id, key) that no earlier one holds. A step takes the next member of each walk
    and joins its links; walks that are done meet their own start's row instead, so that they stay spread."""
    state = starts.join(claims.select(F.col("member").alias("id"), "claim"), "id", "left").where(_free(F.col("claim"), F.col("key")))
    state = state.select("id", "key", F.array("id").alias("own"))
    links = out.withColumnRenamed("id", "node")
    for at in range(most - 1):
        state = state.withColumn("node", F.coalesce(F.get("own", F.lit(at)), "id")).join(links, "node", "left")
        fresh = F.filter("links", lambda x: _free(x.claim, F.col("key")) & ~F.array_contains("own", x.other))
        grown = F.slice(F.concat("own", F.array_distinct(F.transform(fresh, lambda x: x.other))), 1, most)
        open_ = (F.size("own") > at) & (F.size("own") < most) & F.col("links").isNotNull()
        state = state.select("id", "key", F.when(open_, grown).otherwise(F.col("own")).alias("own"))
    return state


def _fold(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """id, own: the same walks of edges with a root, one connected component (root) a task."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        links = {k: g.sort_values(["rank", "other"]).other.tolist() for k, g in pdf.groupby("id")}
        seen, out = set(), []
        for start in pdf.sort_values(["order", "id"]).id.drop_duplicates():
            if start in seen:
                continue
            own, at = [start], 0
            seen.add(start)
            while at < len(own) < most:
                for x in links.get(own[at], []):
                    if x not in seen and len(own) < most:
                        seen.add(x), own.append(x)
                at += 1
            out.append((start, own))
        return pd.DataFrame(out, columns=["id", "own"])

    kind = edges.schema["id"].dataType.simpleString()
    rows = edges.join(starts, "id").select("root", "id", "other", "rank", "key.order")
    return rows.groupBy("root").applyInPandas(fold, f"id {kind}, own array<{kind}>")


def capped_walks(edges: DataFrame, order: DataFrame, most: int = 7, rounds: int = 40) -> DataFrame:
    """id, own: for each start its members in the order they were taken, itself first; walks of one are given too.

    edges (id, other, rank) are the links to walk, a bounded number for each id and tried by rank; order (id, order long) says
    which id starts earlier (smaller first, then the smaller id; null last). Every id with links is a start unless an earlier
    walk holds it; an id without links can only be a member. A repeated link counts once, a link to itself not at all; no edges
    give no rows.

    The number of rounds is that of the longest chain of starts that wait for each other: few where order and links have
    little to do with each other, many where each row is like the one just before it. Components that have not settled after
    `rounds` rounds are folded, each in one task, with the same result."""
    edges = staged(edges.select("id", "other", "rank").where("id <> other").groupBy("id", "other").agg(F.min("rank").alias("rank")), "walk-edges")
    key = F.struct(F.coalesce("order", F.lit(2**63 - 1)).alias("order"), "id").alias("key")
    starts = staged(edges.select("id").distinct().join(order.select("id", "order"), "id", "left").select("id", key), "walk-starts")
    walks = claims = None
    todo = starts
    for _ in range(rounds):
        told = claims if claims is not None else starts.select(F.col("id").alias("member"), F.col("key").alias("claim")).limit(0)
        entry = F.struct("rank", "other", "claim")
        out = staged(edges.join(told.withColumnRenamed("member", "other"), "other", "left").groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("links")), "walk-links")
        new = _walk(todo, out, told, most)
        if walks is not None:
            new = walks.join(todo.select("id"), "id", "left_anti").unionByName(new)
        new = staged(new, "walks")
        now = staged(_claims(new), "walk-claims")
        # a claim matters to a start if it has become, or is no longer, that of an earlier one
        was = told.withColumnRenamed("claim", "old")
        changed = now.join(was, "member", "full").where(~F.col("old").eqNullSafe(F.col("claim"))).withColumnRenamed("member", "other")
        asked = new.select("key", F.explode("own").alias("id")).join(edges, "id").select("key", "other").unionByName(starts.select("key", F.col("id").alias("other")))
        earlier = lambda c: F.coalesce(F.col(c) < F.col("key"), F.lit(False))
        next_ = staged(asked.join(changed, "other").where(earlier("old") != earlier("claim")).select(F.col("key.id").alias("id"), "key").distinct(), "walk-todo")
        for old in (out, walks, claims, todo if todo is not starts else None):
            if old is not None:
                discard(old)
        walks, claims, todo = new, now, next_
        if todo.isEmpty():
            return walks.select("id", "own")
    roots = staged(connected(edges.select(F.col("id").alias("a"), F.col("other").alias("b"))), "walk-roots")
    late = roots.join(todo, "id").select("root").distinct()
    open_ = staged(roots.join(late, "root", "left_semi"), "walk-open")
    return walks.join(open_, "id", "left_anti").select("id", "own").unionByName(_fold(edges.join(open_, "id"), starts, most))
