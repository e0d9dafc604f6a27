"""Token metrics: per-file history (P7), repo summaries (A1-A3, P8), windows.

Repo aggregates are plain ``groupBy`` aggregations, so Spark combines partial
sums map-side and a repo holding a third of all files costs one small row per
task before the shuffle.  The last-N history uses ``row_number() <= N`` which
Spark plans as a ``WindowGroupLimit`` (per-task top-N before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio_string, saved_pct
from ..session import ensure_checkpoint_dir

# --- fixed values ---------------------------------------------------------
HISTORY_SIZE = 20
# --------------------------------------------------------------------------

SUMMARY_COLUMNS = [
    "repo",
    "total_files_scanned",
    "total_raw_tokens",
    "total_skeleton_tokens",
    "selective_method_fetches",
    "method_tokens_fetched",
    "total_consumed_tokens",
    "saved_tokens",
    "reduction_pct",
    "compression_ratio",
]


def scan_history(metrics: DataFrame) -> DataFrame:
    """One history entry per scanned file: raw, skeleton, saved tokens and pct."""
    saved = F.greatest(F.lit(0), F.col("raw_tokens_est") - F.col("skeleton_tokens_est"))
    return metrics.select(
        "repo",
        F.col("path").alias("filename"),
        F.col("raw_tokens_est").alias("raw_tokens"),
        F.col("skeleton_tokens_est").alias("skeleton_tokens"),
        saved.alias("saved_tokens"),
        saved_pct(saved, F.col("raw_tokens_est")).alias("reduction_pct"),
    )


def repo_totals(metrics: DataFrame) -> DataFrame:
    """A1: files, raw and skeleton tokens per repo."""
    return metrics.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files_scanned"),
        F.sum("raw_tokens_est").cast("long").alias("total_raw_tokens"),
        F.sum("skeleton_tokens_est").cast("long").alias("total_skeleton_tokens"),
    )


def method_fetch_totals(fetches: DataFrame, found: str | None = None) -> DataFrame:
    """A3: number of fetched bodies and their tokens per repo.

    With ``found`` (a boolean column name) only those rows count; the test is
    folded into the aggregate instead of a filter, so an expensive upstream
    projection is not pushed into (and evaluated again by) a filter.
    """
    if found is None:
        return fetches.groupBy("repo").agg(
            F.count(F.lit(1)).alias("selective_method_fetches"),
            F.sum("tokens").cast("long").alias("method_tokens_fetched"),
        )
    agg = fetches.groupBy("repo").agg(
        F.count(F.when(F.col(found), F.lit(1))).alias("selective_method_fetches"),
        F.sum(F.when(F.col(found), F.col("tokens"))).cast("long").alias("method_tokens_fetched"),
    )
    return agg.filter(F.col("selective_method_fetches") > 0)


def _finish_summary(df: DataFrame) -> DataFrame:
    consumed = F.col("total_skeleton_tokens") + F.col("method_tokens_fetched")
    saved = F.greatest(F.lit(0), F.col("total_raw_tokens") - F.col("total_consumed_tokens"))
    return (
        df.withColumn("total_consumed_tokens", consumed)
        .withColumn("saved_tokens", saved)
        .withColumn("reduction_pct", saved_pct(F.col("saved_tokens"), F.col("total_raw_tokens")))
        .withColumn("compression_ratio", ratio_string(F.col("total_raw_tokens"), F.col("total_consumed_tokens")))
        .select(*SUMMARY_COLUMNS)
    )


def repo_summary(metrics: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """A2: the summary per repo; ``fetches`` (repo, tokens) adds fetched method tokens."""
    totals = repo_totals(metrics)
    if fetches is None:
        df = totals.withColumn("selective_method_fetches", F.lit(0).cast("long")).withColumn(
            "method_tokens_fetched", F.lit(0).cast("long")
        )
    else:
        # both sides are one row per repo: the join shuffles aggregates only
        df = totals.join(method_fetch_totals(fetches), "repo", "left").fillna(
            0, ["selective_method_fetches", "method_tokens_fetched"]
        )
    return _finish_summary(df)


def repo_summary_rollup(metrics: DataFrame) -> DataFrame:
    """Per-repo summaries plus a grand total row (repo null) via ``rollup``."""
    totals = metrics.rollup("repo").agg(
        F.count(F.lit(1)).alias("total_files_scanned"),
        F.sum("raw_tokens_est").cast("long").alias("total_raw_tokens"),
        F.sum("skeleton_tokens_est").cast("long").alias("total_skeleton_tokens"),
    )
    df = totals.withColumn("selective_method_fetches", F.lit(0).cast("long")).withColumn(
        "method_tokens_fetched", F.lit(0).cast("long")
    )
    return _finish_summary(df)


def summary_json(summary: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The summary of each repo as a JSON document (history = last 20 entries)."""
    cols = [c for c in SUMMARY_COLUMNS if c != "repo"]
    body = summary
    fields = [F.col(c) for c in cols]
    if history is not None:
        last = scan_history_last(history).groupBy("repo").agg(
            F.sort_array(F.collect_list(F.struct("seq", "filename", "raw_tokens", "skeleton_tokens", "saved_tokens",
                                                 "reduction_pct"))).alias("_h")
        )
        body = summary.join(last, "repo", "left")
        fields.append(F.transform(F.coalesce(F.col("_h"), F.array()), lambda e: e.dropFields("seq")).alias("history"))
    return body.select("repo", F.to_json(F.struct(*fields)).alias("summary_json"))


def scan_running_totals(metrics: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """Cumulative counters after each file, files in path order within a repo.

    A plain ``Window.partitionBy("repo")`` would put a repo holding a third of
    all files into one task.  Instead the rows are range-partitioned on
    ``(repo, path)`` (a hot repo spans many ranges), running sums are taken
    within each (range, repo), and each range adds the totals of the earlier
    ranges of the same repo (a table of at most ranges + repos rows).
    """
    spark = metrics.sparkSession
    n = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = metrics.select("repo", "path", "raw_tokens_est", "skeleton_tokens_est").repartitionByRange(n, "repo", "path")
    # written once: range bounds are sampled anew by every plan, so both branches must read one assignment
    ensure_checkpoint_dir(spark)
    base = base.withColumn("_rg", F.spark_partition_id()).checkpoint(eager=True)
    local = Window.partitionBy("_rg", "repo").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = base.select(
        "_rg", "repo", "path",
        F.count(F.lit(1)).over(local).alias("_n"),
        F.sum("raw_tokens_est").over(local).cast("long").alias("_raw"),
        F.sum("skeleton_tokens_est").over(local).cast("long").alias("_skel"),
    )
    totals = base.groupBy("_rg", "repo").agg(
        F.count(F.lit(1)).alias("_tn"),
        F.sum("raw_tokens_est").cast("long").alias("_traw"),
        F.sum("skeleton_tokens_est").cast("long").alias("_tskel"),
    )
    before = Window.partitionBy("repo").orderBy("_rg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_rg", "repo",
        F.coalesce(F.sum("_tn").over(before), F.lit(0)).alias("_on"),
        F.coalesce(F.sum("_traw").over(before), F.lit(0)).alias("_oraw"),
        F.coalesce(F.sum("_tskel").over(before), F.lit(0)).alias("_oskel"),
    )
    # one row per (range, repo) present: at most n_ranges + repos rows; AQE
    # broadcasts it when the measured size is small, else it is a shuffle join
    return cum.join(offsets, ["_rg", "repo"]).select(
        "repo",
        "path",
        (F.col("_n") + F.col("_on")).alias("files_scanned"),
        (F.col("_raw") + F.col("_oraw")).cast("long").alias("raw_tokens_cum"),
        (F.col("_skel") + F.col("_oskel")).cast("long").alias("skeleton_tokens_cum"),
    )


def scan_history_last(history: DataFrame, n: int = HISTORY_SIZE) -> DataFrame:
    """The last ``n`` history entries per repo in scan (path) order, ``seq`` 1..n."""
    w = Window.partitionBy("repo").orderBy(F.col("filename").desc())
    last = history.withColumn("_rd", F.row_number().over(w)).filter(F.col("_rd") <= n)
    cnt = F.count(F.lit(1)).over(Window.partitionBy("repo"))
    return last.withColumn("seq", (cnt - F.col("_rd") + 1).cast("int")).drop("_rd")
