"""Connected components of links, by rounds of least labels; each round is written out, so that lost executors cost one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import discard, staged


def connected(links: DataFrame, rounds: int = 100) -> DataFrame:
    """id, root (the least id reachable) for each end of links (a, b). A round takes the least root of all neighbours, then
    that root's own root, so that long chains shrink by more than one step."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    now = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).select(F.col("a").alias("id"), F.lit(None).cast(both.schema["a"].dataType).alias("was"), "root"), "labels")
    for _ in range(rounds):
        near = both.join(now.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("r"))
        least = now.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        jump = now.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = staged(least.join(jump, "root", "left").select("id", "was", F.least("root", F.coalesce("up", "root")).alias("root")), "labels")
        discard(now)  # the round before is not needed any more
        if new.where("root <> was").isEmpty():
            discard(both)
            return new.select("id", "root")
        now = new
    raise RuntimeError("components did not settle")
