"""Fingerprints of long texts of unequal counts are as alike as the texts."""

import numpy as np
from pyspark.sql import functions as F

from mnemolake.llm import fingerprints


def test_no_bias_on_long_texts(spark):
    # 100,000 words; on the other side every second one ten times: 100,000 / 550,000
    n, slots = 100_000, 256
    rows = spark.range(n).selectExpr("xxhash64(id) as term", "id", "explode(array(0, 1)) as side")
    rows = rows.select("term", "side", F.when((F.col("side") == 1) & (F.col("id") % 2 == 0), F.log(F.lit(10.0))).otherwise(0.0).alias("log_weight"))
    least = {r.side: r for r in fingerprints.signatures(rows, ["side"], slots).collect()}
    likeness = np.mean([least[0][f"s{i}"] == least[1][f"s{i}"] for i in range(slots)])
    assert abs(likeness - 100_000 / 550_000) < 0.06
