"""Incremental scans on Structured Streaming.

Files arrive as parquet in a folder; ``readStream`` with an explicit schema
picks them up.  Skeletonization is row-local, so it runs unchanged on a stream
(T2, append).  Running repo totals (T1) are merged per micro-batch with
``foreachBatch``; a new scan of a repo replaces its earlier totals.  Sinks and checkpoints live
in the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skeleton import METRIC_COLUMNS, skeletonize
from ..session import ensure_checkpoint_dir
from ..sources.files import scan_supported_files

FILES_SCHEMA = "repo string, path string, ext string, content string, scan_id long"


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/codeskel/{name}/{uuid.uuid4().hex}"


def stage_files(files: DataFrame, folder: str | None = None, scan_id: int = 0) -> str:
    """Write a files table, partitioned as it comes, in the shared folder (the arriving files of one scan)."""
    path = folder or _scratch(files.sparkSession, "stream_src")
    files.select("repo", "path", "ext", "content", F.lit(scan_id).cast("long").alias("scan_id")).write.mode("append").parquet(path)
    return path


def read_files_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The arriving files; all that are there make one batch unless the caller limits it."""
    reader = spark.readStream.schema(FILES_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_skeletons(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Skeletons and metrics of the supported files, appended to a parquet table as files arrive."""
    out = _scratch(spark, "stream_skeletons")
    files = scan_supported_files(read_files_stream(spark, folder, files_per_trigger))
    df = skeletonize(files, keep_content=False).select("repo", "path", "skeleton", *METRIC_COLUMNS)
    q = (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", out + "_ckpt")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(out)


def stream_scan_totals(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Running totals per repo, of its latest scan: a new ``scan_id`` resets what an earlier one counted.

    Each batch is aggregated per (repo, scan) with partial aggregation and merged
    with the table that the batch before left in the shared folder (one row per
    repo).  A batch that is repeated after a failure starts from the same table and
    overwrites only its own folder.  Rows of a scan older than the repo's latest are
    ignored.
    """
    out = _scratch(spark, "stream_totals")
    files = scan_supported_files(read_files_stream(spark, folder, files_per_trigger))
    counts = ["total_files_scanned", "total_raw_tokens", "total_skeleton_tokens"]
    schema = "repo string, scan_id long, " + ", ".join(f"{c} long" for c in counts)

    epochs: list[int] = []

    def merge(batch: DataFrame, epoch: int) -> None:
        new = batch.groupBy("repo", F.coalesce("scan_id", F.lit(0)).alias("scan_id")).agg(
            F.count(F.lit(1)).alias(counts[0]),
            F.sum("raw_tokens_est").cast("long").alias(counts[1]),
            F.sum("skeleton_tokens_est").cast("long").alias(counts[2]),
        )
        both = new if epoch == 0 else new.unionByName(batch.sparkSession.read.schema(schema).parquet(f"{out}/epoch={epoch - 1}"))
        summed = both.groupBy("repo", "scan_id").agg(*[F.sum(c).cast("long").alias(c) for c in counts])
        latest = summed.groupBy("repo").agg(F.max_by(F.struct("scan_id", *counts), "scan_id").alias("s"))
        latest.select("repo", "s.*").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        epochs.append(epoch)

    q = (
        skeletonize(files, keep_content=False).select("repo", "scan_id", "raw_tokens_est", "skeleton_tokens_est")
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", out + "_ckpt")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if not epochs:
        return spark.createDataFrame([], schema).drop("scan_id")
    return spark.read.schema(schema).parquet(f"{out}/epoch={max(epochs)}").drop("scan_id")
