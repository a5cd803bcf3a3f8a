"""Every query against its SQL on DuckDB at the smallest scale."""

import math
import os

import duckdb
import pytest

from mnemolake import catalog

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return f"{float(x):.6g}" if isinstance(x, float) else str(list(x) if isinstance(x, (list, tuple)) else x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if sql := catalog.ORACLE_SQL.get(name):
        got = duck.execute(sql)
        names = [d[0] for d in got.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        assert sorted(names) == sorted(df.columns)
        want = [tuple(r[i] for i in order) for r in got.fetchall()]
        assert sorted(tuple(map(cell, r)) for r in rows) == sorted(tuple(map(cell, r)) for r in want)
