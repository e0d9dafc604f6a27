"""Shared helpers, above all cutting lineage in shared storage; ``ship`` comes from the session module."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship

#: ASCII white space that separates words, as a character class body (Java, RE2 and Python alike).
SPACE = r"\x20\x09-\x0D"

__all__ = ["SPACE", "cut", "drop", "fold_of", "forget", "kept", "lower_ascii", "shared_path", "ship", "small_batches", "table", "text_tag", "without"]

_written: list[tuple[SparkSession, str]] = []
_kept: dict = {}


def kept(key: Hashable, make: Callable):
    """What tasks of one worker share, made once; a worker keeps only what was asked for last."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Free what earlier tasks of this worker keep: workers outlive their stage, and the next one needs the memory."""
    _kept.clear()
    pa.default_memory_pool().release_unused()


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared checkpoint folder; removed when the driver exits."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later steps start from the files, so a lost executor costs only the
    unfinished tasks, and each consumer reads only its columns.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._llm_path = path  # for drop()
    return back


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in jobs run inside, where single rows are large (sets of shingles)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that :func:`cut` wrote and nothing reads any more."""
    path = getattr(df, "_llm_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: nothing left to delete with
            return


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (null ids count as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_tag(text: Column) -> Column:
    """A digest of a text (null counts as empty)."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def without(docs: DataFrame, bad: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows whose id and text are those of a row of ``bad (doc_id, tag)``."""
    gone = cut(bad.select(F.col("doc_id").alias("_bad_id"), F.col("tag").alias("_bad_tag")).distinct(), name)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_bad_id")) & (text_tag(F.col("text")) == F.col("_bad_tag"))
    return docs.join(gone, same, "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
