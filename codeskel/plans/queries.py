"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Inputs are the driver tables; source code comes from ``code_files`` (derived
from ``part`` and ``lineitem``), prose from ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import indent_width, py_strip, split_lines, tokens_ceil, tokens_floor
from ..operators import metrics as M
from ..operators.skeleton import METRIC_COLUMNS, skeleton_generic, skeletonize
from pyspark import StorageLevel

from ..session import ensure_checkpoint_dir
from ..sources.files import IGNORED_DIRS, SUPPORTED_EXTS, scan_filter, scan_supported_files
from ..sources.tree import read_tree, write_tree
from ..sources.fixtures import code_files, code_files_once, is_kept, method_requests
from ..operators import search as S
from ..operators import prompts as P
from ..operators.brace import c_ranges, js_ranges, shared_c_features, shared_js_features
from ..operators.python import collapse_dropped
from ..functions.arrays import memo_column
from ..operators.skeleton import file_ext, language
from ..sources.files import repo_ref_normalise as _refs
from ..functions.arrays import let
from . import report as R
from ..operators.lookup import fetch_tokens, method_bodies as _method_bodies
from ..sources.tables import read_table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents", "doc_id")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/codeskel/{name}/{uuid.uuid4().hex}"


_METRICS: dict[tuple, DataFrame] = {}


def _file_metrics(spark: SparkSession, sf: str, scanned: bool) -> DataFrame:
    """K0 output of the corpus, computed once per session and kept persisted.

    Every report reads the same per-file skeletons and metrics, so they are
    materialised once (the skeleton is the expensive part) and reused.
    """
    key = (spark.sparkContext.applicationId, sf)
    full = _METRICS.get(key)
    if full is None:
        full = skeletonize(code_files(spark, sf), keep_content=False).persist(StorageLevel.MEMORY_AND_DISK)
        _METRICS[key] = full
    return full.filter(scan_filter("path")) if scanned else full


def _metrics_once(spark: SparkSession, sf: str, wanted) -> DataFrame:
    """K0 output of the ``wanted`` files, for a query that needs no others.

    Nothing is skeletonized or kept beyond them, unless it already is.
    """
    full = _METRICS.get((spark.sparkContext.applicationId, sf))
    if full is not None:
        return full.filter(wanted)
    files = code_files_once(spark, sf).filter(wanted)
    return skeletonize(files if is_kept(spark, sf) else files.repartition("path"), keep_content=False)


def file_skeleton_metrics(spark, sf):
    return _file_metrics(spark, sf, scanned=False).select("repo", "path", *METRIC_COLUMNS)


def _skeleton_of(name: str):
    def q(spark, sf):
        df = _metrics_once(spark, sf, language(file_ext("path")) == name)
        return df.select("repo", "path", "skeleton", "method_count", "class_count")

    q.__name__ = f"skeleton_{name}"
    return q


skeleton_js_ts = _skeleton_of("js_ts")
skeleton_c_like = _skeleton_of("c_like")
skeleton_python = _skeleton_of("python")


def code_structure_counts(spark, sf):
    df = _file_metrics(spark, sf, scanned=False)
    return df.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("class_count").cast("long").alias("class_count"),
        F.sum("method_count").cast("long").alias("method_count"),
    )


def repo_summary(spark, sf):
    return M.repo_summary(_file_metrics(spark, sf, scanned=True))


def repo_summary_rollup(spark, sf):
    return M.repo_summary_rollup(_file_metrics(spark, sf, scanned=True))


def summary_json(spark, sf):
    m = _file_metrics(spark, sf, scanned=True)
    return M.summary_json(M.repo_summary(m), M.scan_history(m))


def scan_history(spark, sf):
    return M.scan_history(_file_metrics(spark, sf, scanned=True))


def scan_running_totals(spark, sf):
    return M.scan_running_totals(_file_metrics(spark, sf, scanned=True))


def scan_history_last20(spark, sf):
    return M.scan_history_last(M.scan_history(_file_metrics(spark, sf, scanned=True)))


def scan_supported_files_q(spark, sf):
    return scan_supported_files(code_files(spark, sf)).select("repo", "path", "ext")


def skeleton_generic_docs(spark, sf):
    d = _docs(spark, sf).withColumn("_lines", split_lines(F.col("text")))
    return d.select(
        "doc_id",
        F.col("source").alias("repo"),
        F.size("_lines").alias("original_lines"),
        skeleton_generic(F.col("text"), F.col("_lines")).alias("skeleton"),
    )


def file_token_estimates(spark, sf):
    d = _docs(spark, sf)
    n = F.length("text")
    return d.select("doc_id", n.alias("n_chars"), tokens_floor(n).alias("tokens_floor"),
                    tokens_ceil(F.col("text")).alias("tokens_ceil"))


def file_lines(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    return d.select(
        "doc_id",
        (F.col("pos") + 1).cast("int").alias("line_no"),
        "line",
        py_strip(F.col("line")).alias("stripped"),
        indent_width(F.col("line")).cast("int").alias("indent"),
    )


# ------------------------------------------------------------------ search

SEARCH_SYMBOL = "ther"


def _doc_files(spark, sf):
    d = _docs(spark, sf)
    return d.select(
        F.col("source").alias("repo"), F.format_string("docs/%08d.txt", F.col("doc_id")).alias("path"),
        F.col("text").alias("content"),
    )


def _benchmark_symbols(spark, sf):
    """Distinct lower-case words of the benchmark texts."""
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    words = b.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("symbol"))
    return words.filter(F.col("symbol") != "").distinct()


def find_references(spark, sf):
    lines = S.search_lines(_doc_files(spark, sf))
    syms = spark.range(1).select(F.lit(SEARCH_SYMBOL).alias("symbol"))
    return S.reference_report(S.find_references(lines, SEARCH_SYMBOL), syms)


def find_references_multi(spark, sf):
    lines = S.search_lines(_doc_files(spark, sf))
    syms = _benchmark_symbols(spark, sf)
    return S.reference_report(S.match_symbols(lines, syms), syms, lines=lines)


CODE_SYMBOL = "helper"


def find_references_code(spark, sf):
    """J3 over the source files, directories of installed or built code left out."""
    lines = S.search_lines(S.searched_files(code_files(spark, sf)))
    syms = spark.range(1).select(F.lit(CODE_SYMBOL).alias("symbol"))
    return S.reference_report(S.find_references(lines, CODE_SYMBOL), syms)


def find_references_header(spark, sf):
    """A4: the header line the search prints per (symbol, repo), or the no-match message."""
    return S.reference_header(find_references_multi(spark, sf))


# ------------------------------------------------------------------ lookups

def method_bodies(spark, sf):
    return _method_bodies(code_files_once(spark, sf), method_requests(spark, sf))


def method_fetch_totals(spark, sf):
    return M.method_fetch_totals(fetch_tokens(code_files(spark, sf), method_requests(spark, sf)))


def repo_summary_with_fetches(spark, sf):
    """A2 with the bodies that every line item's request fetches."""
    # the corpus is read twice, the skeletons once: only the corpus is kept
    fetches = fetch_tokens(code_files(spark, sf), method_requests(spark, sf))
    return M.repo_summary(_metrics_once(spark, sf, scan_filter("path")), fetches)


# ------------------------------------------------------------------ gaps, ranges

GAP_KEEP_MIN_CHARS = 40


def skeleton_gaps(spark, sf):
    """K5 on documents: lines shorter than 40 stripped characters are dropped."""
    d = _docs(spark, sf).withColumn("_lines", split_lines(F.col("text")))
    keep = F.transform(F.col("_lines"), lambda ln: F.length(py_strip(ln)) >= GAP_KEEP_MIN_CHARS)
    return d.select("doc_id", collapse_dropped(F.col("_lines"), keep).alias("skeleton"))


def body_ranges(spark, sf):
    """K6: compressed body ranges of brace-language files, 1-based lines."""
    cf = code_files(spark, sf).select(
        "repo", "path", split_lines(F.col("content")).alias("_lines"), language(file_ext(F.col("path"))).alias("_lang")
    )

    def build():
        lang = F.col("_lang")
        return F.when(lang == "js_ts", let(shared_js_features("_lines"), js_ranges)).when(
            lang == "c_like", let(shared_c_features("_lines"), c_ranges)
        )

    rng = memo_column("body_ranges:_lines:_lang", build)
    return cf.select("repo", "path", F.explode(rng).alias("r")).select(
        "repo", "path", (F.col("r.o") + 1).alias("body_start"), (F.col("r.c") + 1).alias("body_end")
    )


# ------------------------------------------------------------------ prompts, refs

COMPRESS_ROLE = "assistant"


def compress_messages(spark, sf):
    conv = read_table(spark, sf, "conversations", "conv_id").withColumnRenamed("text", "content")
    out = P.compress_messages(conv, role=COMPRESS_ROLE, limit=P.COMPRESS_MIN_CHARS)
    return out.select("conv_id", "turn", "role", "content", "compressed")


def prompt_assembly(spark, sf):
    """Every document's generic skeleton with the system turns of the conversation of its id (else an empty one)."""
    conv = read_table(spark, sf, "conversations", "conv_id").filter(F.col("role") == "system")
    docs = _docs(spark, sf).withColumn("_lines", split_lines(F.col("text")))
    docs = docs.select(F.col("doc_id").alias("conv_id"), skeleton_generic(F.col("text"), F.col("_lines")).alias("skeleton"))
    pairs = docs.join(conv.select("conv_id", "turn", F.col("text").alias("system")), "conv_id", "left").fillna("", ["system"])
    return P.assemble_prompts(pairs).select("conv_id", "turn", "cached_prompt", "system_tokens", "skeleton_tokens")


def repo_ref_normalise(spark, sf):
    pages = read_table(spark, sf, "pages").select(F.col("url").alias("ref"))
    return _refs(pages)


# ------------------------------------------------------------------ reports

def _scanned(spark, sf):
    return _file_metrics(spark, sf, scanned=True)


def skeleton_map(spark, sf):
    return R.skeleton_map(_scanned(spark, sf))


def sequence_diagram(spark, sf):
    return R.sequence_diagram(_scanned(spark, sf), code_files(spark, sf))


def callable_candidates(spark, sf):
    from ..sources.files import scan_supported_files as _scan

    return R.callable_candidates(_scan(code_files(spark, sf)))


def deep_dive_samples(spark, sf):
    return R.deep_dive_samples(_scanned(spark, sf), code_files(spark, sf))


def sample_file_pair(spark, sf):
    return R.sample_file_pair(_scanned(spark, sf), code_files(spark, sf))


def _bundle(spark, sf):
    return R.repo_report(code_files(spark, sf), _scanned(spark, sf))


def repo_report(spark, sf):
    """R5 with the map of bodies (J4) and the sample file spelled out in plain columns."""
    entry = lambda e: F.concat(e["key"], F.lit("\n"), e["value"])
    df = _bundle(spark, sf)
    return df.select(
        *[c for c in df.columns if c not in ("method_bodies", "sample_file")],
        F.size("method_bodies").alias("n_bodies"),
        F.array_join(F.transform(F.array_sort(F.map_entries("method_bodies")), entry), "\n\n").alias("method_bodies"),
        F.col("sample_file.filename").alias("sample_filename"),
        F.col("sample_file.original").alias("sample_original"),
        F.col("sample_file.skeleton").alias("sample_skeleton"),
        F.col("sample_file.raw_tokens").alias("sample_raw_tokens"),
        F.col("sample_file.skeleton_tokens").alias("sample_skeleton_tokens"),
    )


def repo_report_snippet(spark, sf):
    return R.repo_report_snippet(_bundle(spark, sf))


def skeleton_map_sink(spark, sf):
    """The maps written as text by repo and read back; lines, characters and a checksum per repo."""
    root = _scratch(spark, "map")
    # the header, the ranges' bounds and the entries read the skeletons: only the scanned files' are made, once
    metrics = _metrics_once(spark, sf, scan_filter("path")).persist(StorageLevel.DISK_ONLY)
    R.write_map(R.skeleton_map(metrics), root)
    metrics.unpersist()
    digest = F.conv(F.substring(F.md5(F.col("value").cast("binary")), 1, 8), 16, 10).cast("long")
    return R.read_map(spark, root).groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars"), F.sum(digest).alias("checksum")
    )


# ------------------------------------------------------------------ streaming, tree source

def stream_skeletons(spark, sf):
    from ..streaming import stream as ST

    return ST.stream_skeletons(spark, ST.stage_files(code_files_once(spark, sf)))


def stream_scan_totals(spark, sf):
    from ..streaming import stream as ST

    return ST.stream_scan_totals(spark, ST.stage_files(code_files_once(spark, sf)))


def scan_tree(spark, sf):
    """S1 round trip: the corpus written as a directory tree, read back by the tree source."""
    root = _scratch(spark, "tree")
    write_tree(code_files_once(spark, sf), root)
    return read_tree(spark, root).select("repo", "path", "content")


def scan_tree_supported(spark, sf):
    """S1 with S2, S3 and S6: ignored subtrees and other extensions are not read; every file has a status."""
    root = _scratch(spark, "tree")
    write_tree(code_files_once(spark, sf), root)
    found = read_tree(spark, root, extensions=SUPPORTED_EXTS, skip_dirs=IGNORED_DIRS)
    return found.select("repo", "path", "status", F.length("content").alias("n_chars"))
