"""The driver's JVM lives on after a query: what planning and compiling the query freed must not stay with it."""

import re

import pytest

from mnemolake.llm import common


def test_staging_gives_the_drivers_freed_memory_back(spark):
    if not common.give_back_driver(spark):
        pytest.skip("this JVM can't be asked for it")
    for k in range(30):  # code of their own for each
        wide = spark.range(1000).selectExpr(*(f"id + {40 * k + j} as x{j}" for j in range(40)))
        common.discard(common.staged(wide.groupBy("x1").count(), "wide"))
    left, unit = re.search(r"\(([-+]?\d+)([BKMG])\)", common.give_back_driver(spark)).groups()
    assert -int(left) * 1024 ** "BKMG".index(unit) < 20 << 20


def test_a_jvm_without_the_command_keeps_its_memory(spark, monkeypatch):
    class Without:
        def __getattr__(self, name):
            raise common.Py4JError("no such class")

    monkeypatch.setattr(spark.sparkContext, "_jvm", Without())
    assert common.give_back_driver(spark) == ""
