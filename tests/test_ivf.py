"""The inverted file: recall, pruned cells, rows without a direction, mixed lengths, a hot vector."""

import numpy as np
import pytest

from mnemolake.operators import ivf, retrieval

SCHEMA = "id string, embedding array<double>, cell int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (30, 24))
    rows = [(f"{i:05}", (centres[i % 30] + rng.normal(0, 0.25, 24)).tolist()) for i in range(3000)]
    rows += [(f"hot{i:04}", centres[3].tolist()) for i in range(1500)]  # a third of all rows are equal
    df = frame(spark, rows).repartition(6)
    path = f"{tmp_path_factory.mktemp('ivf')}/ix"
    return df, ivf.build(df, path, 32, sample=1000)


def test_recall_with_few_cells(spark, clustered):
    df, index = clustered
    asked = df.where("id like '%0' and id not like 'hot%'")
    truth = retrieval.nearest(asked, df, 10)
    probes = ivf.tuned_probes(df.where("id not like 'hot%'"), index, 10, 0.95)
    assert probes <= 8
    got = ivf.nearest(asked, index, 10, probes).cache()
    assert ivf.recall(got, truth).first().recall >= 0.9
    # a similarity found is the exact one
    both = got.join(truth.withColumnRenamed("similarity", "s"), ["id", "other"]).where("abs(similarity - s) > 1e-9")
    assert both.count() == 0


def test_all_cells_are_exact(spark, clustered):
    df, index = clustered
    asked = df.where("id like '%7'")
    key = lambda d: sorted((r.id, r.rank, r.other) for r in d.collect())
    assert key(ivf.nearest(asked, index, 5, 32)) == key(retrieval.nearest(asked, df, 5))


def test_cells_not_probed_are_not_read(spark, clustered):
    df, index = clustered
    few = index.rows(spark, [2, 5])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:60]
    scan = few._jdf.queryExecution().executedPlan().collectLeaves().head()
    few.count()
    files = {r.f for r in few.select("_metadata.file_path").distinct().toDF("f").collect()}
    assert scan.relation().partitionSchema().fieldNames()[0] == "cell" and files and all("cell=2/" in f or "cell=5/" in f for f in files)


def test_every_row_is_stored(spark, clustered):
    df, index = clustered
    assert index.rows(spark).select("id").distinct().count() == df.count() == index.rows(spark).count()


def test_rows_without_a_direction(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"{i:03}", rng.normal(0, 1, 4).tolist()) for i in range(200)]
    rows += [("zero", [0.0] * 4), ("short", [1.0, 2.0]), ("null", None), ("hole", [1.0, None, 2.0, 3.0]), ("nan", [float("nan")] * 4), ("empty", [])]
    df = frame(spark, rows).repartition(3)
    index = ivf.build(df, f"{tmp_path}/ix", 8)
    assert sorted(r.id for r in index.rows(spark, [ivf.REST]).collect()) == ["empty", "hole", "nan", "short", "zero"]
    got = ivf.nearest(df.where("id in ('short', '004', 'zero')"), index, 3, 8).collect()
    assert {r.other for r in got if r.id == "short" and r.rank == 1} == {"short"} and all(r.similarity == 0 for r in got if r.id == "zero")
    nothing = ivf.build(df.where("false"), f"{tmp_path}/none", 4)
    assert ivf.nearest(df, nothing, 3).count() == 0 and ivf.tuned_probes(df.where("false"), nothing) == 1
    odd = ivf.build(df.where("id in ('zero', 'null')"), f"{tmp_path}/odd", 4)
    assert ivf.nearest(df.where("id = '004'"), odd, 3).count() == 1


def test_mixed_lengths_are_unlike(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [1.0, 0.0, 0.0]), ("d", [-1.0, 0.0]), ("e", [1.0, None])]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "id string, embedding array<double>, superseded_by string, expires_at timestamp_ntz").coalesce(1)
    near = {(r.id, r.other): r.similarity for r in retrieval.nearest(df.where("id in ('a', 'c')"), df, 9).collect()}
    assert near["a", "c"] == 0 == near["c", "b"] and near["a", "d"] == -1 and near["c", "c"] == 1 and ("a", "e") not in near
    assert {(r.id, r.other) for r in retrieval.neighbours(df, 0.5).collect()} == {("a", "b"), ("b", "a")}
