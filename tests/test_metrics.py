"""Running totals over range partitions equal plain cumulative sums, also for a hot repo."""

from itertools import accumulate

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeskel.operators import metrics as M
from codeskel.operators.metrics import repo_summary, scan_running_totals


def test_running_totals_with_hot_repo(spark):
    rows = [("hot", f"f{i:04d}", i % 17 + 1, i % 5 + 1) for i in range(600)]
    rows += [(f"r{k}", f"g{i:03d}", i + 2, 1) for k in range(3) for i in range(7)]
    df = spark.createDataFrame(rows, "repo string, path string, raw_tokens_est int, skeleton_tokens_est int")
    got = {(r.repo, r.path): (r.files_scanned, r.raw_tokens_cum, r.skeleton_tokens_cum)
           for r in scan_running_totals(df, n_ranges=7).collect()}
    want = {}
    for repo in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == repo)
        raws = list(accumulate(r[2] for r in mine))
        skels = list(accumulate(r[3] for r in mine))
        for k, r in enumerate(mine):
            want[(repo, r[1])] = (k + 1, raws[k], skels[k])
    assert got == want


def test_repo_summary_ratio_and_pct(spark):
    df = spark.createDataFrame([("a", "x", 100, 10), ("a", "y", 50, 60)],
                               "repo string, path string, raw_tokens_est int, skeleton_tokens_est int")
    r = repo_summary(df).first()
    assert (r.total_raw_tokens, r.total_skeleton_tokens, r.saved_tokens) == (150, 70, 80)
    assert r.reduction_pct == 53.3 and r.compression_ratio == "2.1x"


def test_running_totals_when_range_bounds_are_sampled(spark):
    """Few ranges over many rows: bounds are sampled, and still no row is lost or counted twice."""
    rows = [("hot" if i % 3 else f"r{i % 7}", f"p{(i * 7919) % 20000:05d}", i % 101, i % 13) for i in range(20000)]
    m = spark.createDataFrame(rows, "repo string, path string, raw_tokens_est int, skeleton_tokens_est int").repartition(8)
    w = Window.partitionBy("repo").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = {
        tuple(r)
        for r in m.select(
            "repo", "path", F.count("*").over(w), F.sum("raw_tokens_est").over(w), F.sum("skeleton_tokens_est").over(w)
        ).collect()
    }
    for n in (2, 4, 2):
        got = [tuple(r) for r in M.scan_running_totals(m, n).collect()]
        assert len(got) == len(rows) and set(got) == want
