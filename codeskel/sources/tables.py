"""Reading the input tables.

At cluster scale a table scan has thousands of splits and is used as is.  The
test tables are single-row-group parquet files, which Spark scans in one task;
for CPU-heavy row-local work (skeletons, line explosion) such a scan is spread
over the available cores with a hash repartition on the row key.  The check
only plans the scan (no job) and never fires on a large input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition ``df`` over the cores when it has fewer partitions than cores."""
    sc = df.sparkSession.sparkContext
    cores = sc.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2, *keys) if keys else df.repartition(cores * 2)


def read_table(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, *keys) if keys else df
