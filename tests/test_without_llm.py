"""The engine without the training-data operators: it imports, and answers its queries."""

import os
import shutil
import subprocess
import sys

from .conftest import HERE

PROGRAM = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = set(e.queries())
assert not any(n.startswith("op") or n == "pipeline" for n in names) and set(e.oracle_sql()) <= names and len(names) > 100
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0 and e.queries()["a1_by_status"](spark, "/root/testdata/sf0.001").count() > 0
print("whole")
"""


def test_without_the_training_data_operators(tmp_path):
    root = tmp_path / "repo"
    shutil.copytree(HERE, root, ignore=lambda d, names: [n for n in names if n in (".git", "llm", "__pycache__", "corpus_pipeline.py")])
    assert not os.path.exists(root / "mnemolake" / "llm") and not os.path.exists(root / "tests" / "llm")
    env = os.environ | {"PYTHONPATH": str(root)}
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=root, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "whole" in done.stdout, done.stderr[-2000:]
