"""Read a directory tree of repositories as a files table.

Spark's file sources skip names starting with ``_`` or ``.`` (so every
``__init__.py`` would be lost) and the DataFrame readers skip empty files, so the
tree is read in two steps:

1. A small Python Data Source lists the files.  The driver lists only the
   repositories; each repository is walked inside a partition, which yields Arrow
   batches of names.  Directories in ``skipDirs`` are not entered, and filters on
   ``repo`` and ``ext`` are pushed into the walk.
2. The listed names are dealt anew over all tasks, which read the bytes, so a
   repository with a third of all files is read by many tasks.

A file that cannot be read gives a row with its error (S6), never a failed job.
Decoding and newline normalisation are column expressions (S4).

The root is qualified by Hadoop's file systems on the driver, so a path without a
scheme means the cluster's default file system; workers open it through
``pyarrow.fs`` (``hdfs://``, ``s3://``, or ``file:`` for a folder that all mount).
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..session import ship
from .files import decode_content, relative_path

LISTING_SCHEMA = "repo string, full_path string, ext string"
#: Names per Arrow batch, and repositories that one partition walks.
BATCH, REPOS_PER_PARTITION = 4096, 16
#: Bytes after which a batch of contents is handed on.
BATCH_BYTES = 16 << 20

OK, REPAIRED, UNREADABLE = "ok", "repaired", "unreadable"


def open_tree(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified root and the root's path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` with the scheme of the file system that Hadoop resolves it to."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return path.getFileSystem(conf).makeQualified(path).toString().rstrip("/")


def extension(name: str) -> str:
    return posixpath.splitext(name)[1].lower()


def _children(filesystem: pafs.FileSystem, folder: str) -> Iterator[tuple[str, str, bool]]:
    """``(name, path, is a directory)`` in a directory; links to directories are not followed and left out."""
    if isinstance(filesystem, pafs.LocalFileSystem):  # pyarrow hides links without a target
        with os.scandir(folder) as entries:
            for e in entries:
                if not e.is_symlink() or not os.path.isdir(e.path):
                    yield e.name, e.path, e.is_dir(follow_symlinks=False)
    else:
        for info in filesystem.get_file_info(pafs.FileSelector(folder)):
            yield info.base_name, info.path, info.type == pafs.FileType.Directory


class _Repos(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Listing(DataSourceReader):
    """Lists files; ``repo`` and ``ext`` filters and ``skipDirs`` prune the walk."""

    def __init__(self, options):
        self.root = options["path"]
        self.skip = {d for d in options.get("skipDirs", "").split("/") if d}
        self.per_partition = int(options.get("reposPerPartition", REPOS_PER_PARTITION))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            value = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if value is not None and f.attribute in (("repo",), ("ext",)):
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, value) & value
            else:
                yield f

    def _takes(self, column: str, value: str) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def partitions(self):
        filesystem, root = open_tree(self.root)
        found = filesystem.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        repos = sorted(i.base_name for i in found if i.type == pafs.FileType.Directory and self._takes("repo", i.base_name))
        n = self.per_partition
        return [_Repos(repos[i : i + n]) for i in range(0, len(repos), n)] or [_Repos([])]

    def _walk(self, filesystem, folder: str) -> Iterator[str]:
        todo = [folder]
        while todo:
            try:
                found = list(_children(filesystem, todo.pop()))
            except OSError:  # a directory that cannot be listed holds no files to scan
                continue
            for name, path, is_folder in found:
                if not is_folder:
                    # links without a target are listed, too: reading them tells the error
                    if self._takes("ext", extension(name)):
                        yield path
                elif name not in self.skip:
                    todo.append(path)

    def read(self, partition):
        filesystem, root = open_tree(self.root)
        names: list[tuple[str, str, str]] = []

        def batch():
            return pa.record_batch([pa.array(c, pa.string()) for c in zip(*names)], names=["repo", "full_path", "ext"])

        for repo in partition.names:
            if repo in self.skip:
                continue
            for path in self._walk(filesystem, posixpath.join(root, repo)):
                names.append((repo, path, extension(posixpath.basename(path))))
                if len(names) >= BATCH:
                    yield batch()
                    names = []
        if names:
            yield batch()


class RepoTreeSource(DataSource):
    """``spark.read.format("codeskel_tree").load(root)``: the names of all files under ``root/<repo>/``."""

    @classmethod
    def name(cls):
        return "codeskel_tree"

    def schema(self):
        return LISTING_SCHEMA

    def reader(self, schema):
        return _Listing(self.options)


def list_tree(spark: SparkSession, root: str, skip_dirs=()) -> DataFrame:
    """``(repo, full_path, ext)`` of the files below ``root``; filters on ``repo`` and ``ext`` prune the walk."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepoTreeSource)
    return spark.read.format("codeskel_tree").option("skipDirs", "/".join(skip_dirs)).load(qualified(spark, root))


def _read_bytes(root: str):
    """Batches of ``(repo, full_path)`` with each file's bytes, or the error of reading it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem = open_tree(root)[0]
        rows: list[tuple] = []
        held = 0

        def flush():
            kinds = [pa.string(), pa.string(), pa.binary(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.record_batch(columns, names=["repo", "full_path", "content_bytes", "error"])

        for b in batches:
            for repo, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = error = None
                try:
                    with filesystem.open_input_stream(path) as f:
                        data = f.read()
                except OSError as e:
                    error = str(e).split(". Detail:")[0]
                rows.append((repo, path, data, error))
                held += len(data or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    return run


def read_tree(spark: SparkSession, root: str, extensions=None, skip_dirs=()) -> DataFrame:
    """Files table ``(repo, path, content, status, error)`` from ``root/<repo>/<path>``.

    ``status`` is ``ok``, ``repaired`` (bytes that are not UTF-8 were dropped, as the
    decoder of the scan does) or ``unreadable`` (``content`` is null, ``error`` says
    why).  ``extensions`` and ``skip_dirs`` leave files and whole subtrees unread.
    """
    names = list_tree(spark, root, skip_dirs)
    if extensions is not None:
        names = names.filter(F.col("ext").isin(*extensions))
    base = open_tree(qualified(spark, root))[1]
    dealt = names.select("repo", "full_path").repartition("repo", "full_path")
    raw = dealt.mapInArrow(_read_bytes(qualified(spark, root)), "repo string, full_path string, content_bytes binary, error string")
    whole = F.coalesce(F.is_valid_utf8(F.col("content_bytes").cast("string")), F.lit(True))
    return raw.select(
        "repo",
        relative_path("full_path", F.concat(F.lit(base + "/"), F.col("repo"))).alias("path"),
        decode_content("content_bytes").alias("content"),
        F.when(F.col("error").isNotNull(), UNREADABLE).when(whole, OK).otherwise(REPAIRED).alias("status"),
        "error",
    )


def write_tree(files: DataFrame, root: str) -> None:
    """Materialise a files table as ``root/<repo>/<path>`` files, written by the executors.

    A file is written whole under its own name, so a repeated task writes the same files again.
    """
    spark = files.sparkSession
    ship(spark)
    target = qualified(spark, root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = open_tree(target)
        made: set[str] = set()
        for b in batches:
            for i in range(b.num_rows):  # one content at a time: a batch may hold large files
                repo, path, content = (c[i].as_py() for c in b.columns)
                full = posixpath.join(base, repo, path)
                folder = posixpath.dirname(full)
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                with filesystem.open_output_stream(full) as f:
                    f.write((content or "").encode("utf-8"))
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    files.select("repo", "path", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()
