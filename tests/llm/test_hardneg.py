"""Hard negatives against brute force and SQL; intervals hold what they promise."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeskel.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, score double, anchor string, dim int"


@pytest.mark.parametrize("dim", [1, 5, 64, 100])
def test_intervals_hold_every_score(dim):
    g = np.random.default_rng(dim)
    v = np.floor(g.normal(0, 100, (300, dim))).astype(np.int64)
    v[0] = 0
    assert np.allclose(hardneg.rotate(v.astype(float)) @ hardneg.rotate(v.astype(float)).T, v @ v.T)
    norm, codes, aligned, rest = hardneg.encode(v)
    assert (rest <= 1).all() and rest[1:].mean() < 0.2
    a = hardneg.Anchor(v[7])
    total = np.zeros(300)
    for t in range(hardneg.LEVELS):
        total += aligned[:, t] * a.products(codes[:, t].copy().view(np.uint64))
    half = norm * (a.error + a.length * (rest + 1e-9)) + 1e-6
    assert (np.abs(norm * total - v @ v[7]) <= half).all()
    some = norm > 0
    assert np.median(half[some] / (norm[some] * np.linalg.norm(v[7]))) < 0.2


def brute(rows):
    seen = set()
    for i, v, lab, *_ in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen.add((i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * x) for x in v)))
    out = []
    for a in seen:
        if a[0] % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in seen if b[0] != a[0] and len(b[2]) == len(a[2])]
        scored.sort()
        for ps, pid, _ in [s for s in scored if s[2] == a[1]][:5]:
            fit = [s for s in scored if s[2] != a[1] and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:10]
            out += [(a[0], pid, k + 1, s[1], -ps, -s[0]) for k, s in enumerate(fit)]
    return sorted(out)


def make(n, dim, labels, seed):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    rows = []
    for i in range(n):
        lab = r.randrange(labels)
        v = [0.1 * (c + r.gauss(0, 1.5)) for c in centre[lab]]
        if i % 9 == 0 and rows:
            v = rows[-1][1]  # ties
        rows.append((i * 2, v, lab, 0.1, "x", 3))
    odd = [None, [], [0.0] * dim, [math.nan] + [0.0] * (dim - 1), [None] * dim, [math.inf] * dim, [1.0], [1e200] * dim]
    rows += [(20000 + i, v, 1, None, None, None) for i, v in enumerate(odd)] + [(None, rows[0][1], 1, 0.0, "", 0), (30000, rows[1][1], None, 0.0, "", 0)]
    return rows + rows[:5] + [(200, [0.1] * dim, 2, 0.0, "", 0)]


@pytest.mark.parametrize("n,dim,labels,chunk,block", [(700, 16, 3, 100, 3), (500, 64, 10, 4096, 4096), (300, 3, 1, 50, 1)])
def test_equals_brute_force(spark, monkeypatch, n, dim, labels, chunk, block):
    monkeypatch.setattr(hardneg, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(hardneg, "BLOCK_ANCHORS", block)
    rows = make(n, dim, labels, n)
    df = spark.createDataFrame(rows, SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hardneg.hard_negatives(hardneg.integer_vectors(df, "vec_id", "embedding", label), F.col("vec_id") % 100 == 0)
    want = brute([r for r in rows if r[1] is None or 1e200 not in r[1]])
    assert sorted(tuple(r) for r in got.collect()) == want and (want or labels == 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = hardneg.hard_negatives(hardneg.integer_vectors(df, "vec_id", "embedding", F.col("label")), F.col("vec_id") % 100 == 0)
    assert out.count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    rel = con.sql(hardneg.OP13_SQL)
    got = hardneg.op13_hard_negatives(spark, sf)
    assert got.columns == rel.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(rel.fetchall())
