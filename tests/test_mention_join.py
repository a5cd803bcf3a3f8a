"""Keys that texts mention, against a plain LIKE join."""

import random

import pytest
from pyspark.sql import functions as F

from mnemolake.operators.mentions import mentions
from mnemolake.sources import stages


def frames(spark, texts, keys):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), spark.createDataFrame([(k,) for k in keys], "key string")


def plain(texts, keys, how):
    k = keys.where("key is not null").distinct()
    return texts.join(k, F.expr("text like concat('%', key, '%')"), how).select("id", "key")


def rows(df):
    return sorted(((r.id, r.key) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_as_a_like_join(spark, how):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(12)) for _ in range(150)] + [None, "", "abc", "50% of_it", "a\\b", "x" * 3000, "ünï çödé word"]
    keys = [word() for _ in range(120)] + [None, "", "abc", "abc", "0% o", "of_it", "ofXit", "a_ca", "ab%ca bc", "%", "____", "nowhere at all", "çödé", "x" * 500]
    t, k = frames(spark, texts, keys)
    assert rows(mentions(t, k, how=how)) == rows(plain(t, k, how))


def test_nothing(spark):
    t, k = frames(spark, ["some text"], ["some"])
    assert mentions(t, k.where("false")).count() == 0 and mentions(t.where("false"), k).count() == 0
    assert rows(mentions(t, k.where("false"), how="left")) == [(0, None)]


def test_many_keys(spark):
    """100,000 keys and texts that hold some of them: each text is shuffled once, whatever the number of keys."""
    n = 100_000
    keys = spark.range(n).select(F.concat(F.lit("pattern.key."), F.lpad(F.col("id").cast("string"), 6, "0")).alias("key"))
    texts = spark.range(400).select("id", F.concat(F.lit("seen pattern.key."), F.lpad((F.col("id") * 211 % n).cast("string"), 6, "0"), F.lit(" and more words")).alias("text"))
    got = mentions(texts, keys)
    assert {(r.id, int(r.key[-6:])) for r in got.collect()} == {(i, i * 211 % n) for i in range(400)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("texts-") <= 3 and stages.shared_dir(spark)
