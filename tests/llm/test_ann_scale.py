"""Cosines of vectors whose squares leave the range of doubles."""

import numpy as np

from codeskel.llm import ann


def test_very_large_and_very_small_vectors(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e200, 1e200]), (50, [1e-200, 0.0]), (2, [3.0, 0.0]), (100, [1e300, -1e300]), (3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = ann._vectors(df, "vec_id", "embedding").filter("vec_id % 50 = 0")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(ann.build_index(df), queries).collect()}
    assert got[0, 1][0] == 1 and abs(got[0, 1][1] - 1) < 1e-12
    assert got[50, 1] == (2, 1.0)
    assert abs(got[100, 1][1] - np.sqrt(0.5)) < 1e-12 and len(got) == 12


def test_scaling_changes_no_bit():
    x = np.random.default_rng(1).normal(size=(50, 9))
    s = ann._scaled(x)
    assert (np.frexp(s)[0] == np.frexp(x)[0]).all() and (np.abs(s).max(axis=1) <= 1).all()
