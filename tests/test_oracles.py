"""Registered queries against their DuckDB oracles on the smallest test tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as E
from codeskel.session import TABLES

SF = "/root/testdata/sf0.001"
#: Every query of the library's own operators; the training-data operators have tests of their own.
NAMES = [n for n in E.oracle_sql() if not re.match(r"op\d+_|pipeline$", n)]


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(tuple(repr(fix(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(rel.fetchall(), rel.columns)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[0] == "repo" and df.count() >= 0
