"""Every registered query with an oracle gives DuckDB's answer."""

import math
import os

import duckdb
import pytest

from hinterland.catalogue import ORACLE, QUERIES

NAMES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for name in NAMES:
        path = os.path.join(tables, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, tables, name):
    got = QUERIES[name](spark, tables)
    columns = sorted(got.columns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted([cell(r[i]) for i in order] for r in want.fetchall())
    actual = sorted([cell(r[c]) for c in columns] for r in got.collect())
    assert actual == expected


def test_rest_give_rows(spark, tables):
    from pyspark.sql import DataFrame

    assert set(ORACLE) < set(QUERIES)
    out = QUERIES["normal_draws"](spark, tables)
    assert isinstance(out, DataFrame) and out.count() == 5
