"""The synthetic corpus is byte-identical in Spark and DuckDB (the premise of every code oracle)."""

import hashlib
import os

import duckdb
import pytest

from codeskel.sources.fixtures import build_code_files, code_files_sql
from codeskel.sources.tree import read_tree, write_tree

SF = "/root/testdata/sf0.001"


def _digest(rows):
    h = hashlib.sha256()
    for r in sorted(rows):
        h.update("\x00".join(r).encode())
    return h.hexdigest()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_code_files_identical_in_both_engines(spark):
    s_rows = [tuple(r) for r in build_code_files(spark, SF).select("repo", "path", "ext", "content").collect()]
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    d_rows = con.sql(code_files_sql("duckdb")).fetchall()
    assert len(s_rows) == len(d_rows) > 0
    assert _digest(s_rows) == _digest(d_rows)


def test_tree_round_trip_through_uri(spark, tmp_path):
    files = spark.createDataFrame([("r", "a/__init__.py", ""), ("r", "b/x.ts", "let y = 1;\n")],
                                  "repo string, path string, content string")
    root = f"file://{tmp_path}/tree"
    write_tree(files, root)
    got = sorted((r.repo, r.path, r.content) for r in read_tree(spark, root).collect())
    assert got == [("r", "a/__init__.py", ""), ("r", "b/x.ts", "let y = 1;\n")]
