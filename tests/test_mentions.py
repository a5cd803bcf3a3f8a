"""Mentions of more keys than one block holds."""

from mnemolake.plans.analytics import mentions


def test_no_key_is_dropped(spark):
    n = 12_000
    keys = spark.range(n).selectExpr("concat('<', id, '>') as key").union(spark.sql("select cast(null as string)"))
    texts = spark.createDataFrame([(k // 400, " ".join(f"<{i}>" for i in range(k, k + 400))) for k in range(0, n, 400)] + [(99, None), (98, "none")], "event_id long, text string")
    got = mentions(texts, keys.union(keys), block=3000)
    assert {(r.event_id, r.key) for r in got.collect()} == {(i // 400, f"<{i}>") for i in range(n)}
    assert got.count() == n
    assert mentions(texts, keys.limit(0)).count() == 0
