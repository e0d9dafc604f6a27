"""Per-repository reports (R1-R6) and the deep-dive sampling.

Everything is computed for all repos at once.  Per-repo text only ever
aggregates bounded sets: at most 3-4 sampled files, the last 20 history
entries, and as many map entries as the skeleton excerpt can hold characters
of -- each selected with ``row_number() <= N`` (a per-task
``WindowGroupLimit``).  The full skeleton map is one row per file
(``skeleton_map``), never one string per repo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import WS_CLASS, py_strip, split_lines
from ..operators import metrics as M
from ..operators.lookup import BODY_BANNER, found_bodies
from ..operators.skeleton import skeletonize
from ..session import ensure_checkpoint_dir
from ..sources.files import scan_supported_files

# --- fixed values ---------------------------------------------------------
RULE = "=" * 65
MAP_TITLE = "CODESKEL REPOSITORY SKELETON MAP"
DEEP_DIVE_FILES = 4
DIAGRAM_FILES = 3
REPORT_BODIES = 3
BODY_EXCERPT = 500
MAP_EXCERPT = 3500
SNIPPET_LINES = 25
CANDIDATE_PREFIXES = ("def ", "function ")
CANDIDATE_CONTAINS = " class "
REJECT_WORDS = ("not found", "Error")
# Banners of the map's entries: a skeleton, and a file that could not be read.
MAP_BANNER = "--- FILE: %s (Raw: ~%d tokens -> Skeleton: ~%d tokens | Reduction: %s%%) ---"
MAP_ERROR = "--- FILE: %s (Error parsing: %s) ---"
# --------------------------------------------------------------------------

#: The banner of an entry without its path and numbers, and the newline after it: no entry is shorter.
MIN_ENTRY_CHARS = len(MAP_BANNER.replace("%s", "").replace("%d", "").replace("%%", "%")) + 1


def scanned_metrics(files: DataFrame) -> DataFrame:
    """K0 over the files the skeleton scan reads (S2/S3 applied); files that could not be read take no part."""
    scanned = scan_supported_files(files)
    if "error" in files.columns:
        scanned = scanned.filter(F.col("error").isNull())
    return skeletonize(scanned, keep_content=False)


def failed_files(files: DataFrame) -> DataFrame:
    """``(repo, path, error)`` of the scanned files that could not be read."""
    return scan_supported_files(files).filter(F.col("error").isNotNull()).select("repo", "path", "error")


# ------------------------------------------------------------------ R1


def map_header(summary: DataFrame) -> DataFrame:
    return summary.select(
        "repo",
        F.concat(
            F.lit(RULE + "\n" + MAP_TITLE + "\n"),
            F.format_string(
                "Files Scanned: %d | Raw Tokens: ~%d -> Skeleton Tokens: ~%d\n",
                F.col("total_files_scanned"), F.col("total_raw_tokens"), F.col("total_skeleton_tokens"),
            ),
            F.lit("Overall Reduction: "), F.col("reduction_pct").cast("string"),
            F.lit("% | Compression Ratio: "), F.col("compression_ratio"),
            F.lit("\n" + RULE + "\n\n"),
        ).alias("header"),
    )


def map_entries(metrics: DataFrame) -> DataFrame:
    """One map entry per file: banner, skeleton and a blank line (P10)."""
    banner = F.format_string(
        MAP_BANNER,
        F.col("path"), F.col("raw_tokens_est"), F.col("skeleton_tokens_est"), F.col("reduction_pct").cast("string"),
    )
    return metrics.select("repo", "path", F.concat(banner, F.lit("\n"), F.col("skeleton"), F.lit("\n")).alias("entry"))


def error_entries(failed: DataFrame) -> DataFrame:
    """One map entry per file that could not be read: its banner alone."""
    return failed.select("repo", "path", F.format_string(MAP_ERROR, F.col("path"), F.col("error")).alias("entry"))


def skeleton_map(metrics: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """R1 as rows ``(repo, path, entry)``; the header row has ``path`` null.

    The map text of a repo is the header followed by the entries in path
    order joined with newlines.  ``failed (repo, path, error)`` adds the banners of
    files that could not be read; the header counts only the others.  A repo of
    which nothing could be read has no header.
    """
    header = map_header(M.repo_summary(metrics)).select("repo", F.lit(None).cast("string").alias("path"),
                                                        F.col("header").alias("entry"))
    rows = header.unionByName(map_entries(metrics))
    return rows if failed is None else rows.unionByName(error_entries(failed))


def write_map(map_rows: DataFrame, path: str, n_ranges: int | None = None) -> None:
    """The maps as text files under ``path/repo=<repo>/``.

    Rows are range-partitioned on (repo, path), so a repo of any size spans as many
    files as it needs: inside a file entries are in path order, and a repo's files,
    in name order, follow each other.  The writer commits whole tasks, so a lost
    executor repeats its unfinished files only.
    """
    order = ["repo", F.col("path").asc_nulls_first()]
    ranged = map_rows.repartitionByRange(n_ranges, *order) if n_ranges else map_rows.repartitionByRange(*order)
    # the writer ends each row with a line feed; the header's own last one is left out for it
    header = F.substring("entry", F.lit(1), F.length("entry") - 1)
    text = F.when(F.col("path").isNull(), header).otherwise(F.col("entry"))
    ranged.sortWithinPartitions(*order).select("repo", text.alias("entry")).write.partitionBy("repo").text(path, lineSep="\n")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """``(repo, file, value)``: the written maps line by line."""
    lines = spark.read.schema("value string, repo string").text(path, lineSep="\n")
    return lines.select("repo", F.col("_metadata.file_name").alias("file"), "value")


def map_excerpt(metrics: DataFrame, n_chars: int = MAP_EXCERPT) -> DataFrame:
    """The first ``n_chars`` characters of each repo's map, from a bounded prefix of entries."""
    w = Window.partitionBy("repo").orderBy("path")
    enough = n_chars // MIN_ENTRY_CHARS + 1
    first = map_entries(metrics).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= enough)
    joined = first.groupBy("repo").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_rn", "entry"))), lambda e: e["entry"]), "\n"
        ).alias("_entries")
    )
    head = map_header(M.repo_summary(metrics))
    return head.join(joined, "repo", "left").select(
        "repo", F.substring(F.concat(F.col("header"), F.coalesce(F.col("_entries"), F.lit(""))), 1, n_chars).alias("excerpt")
    )


# ------------------------------------------------------------------ W3, J2


def sampled_files(metrics: DataFrame, files: DataFrame, n: int = DEEP_DIVE_FILES) -> DataFrame:
    """The first ``n`` of the last-20 history entries whose file exists, ``rank`` 1..n."""
    last = M.scan_history_last(M.scan_history(metrics)).select("repo", F.col("filename").alias("path"), "seq")
    existing = last.join(files.select("repo", "path"), ["repo", "path"], "left_semi")
    w = Window.partitionBy("repo").orderBy("seq")
    return existing.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("seq")


# ------------------------------------------------------------------ X6


def callable_candidates(files: DataFrame) -> DataFrame:
    """Candidate callables per file in line order, up to the first nameless one."""

    def cand(line):
        s = py_strip(line)
        is_c = (s.startswith(CANDIDATE_PREFIXES[0]) | s.startswith(CANDIDATE_PREFIXES[1]) | line.contains(CANDIDATE_CONTAINS)) & s.contains("(")
        head = py_strip(F.replace(F.replace(F.substring_index(s, "(", 1), F.lit("def "), F.lit("")), F.lit("function "), F.lit("")))
        name = F.element_at(F.split(head, f"{WS_CLASS}+"), -1)
        return F.struct(is_c.alias("c"), name.alias("name"))

    def per_file(lines):
        tagged = F.transform(lines, lambda ln, i: F.struct((i + 1).alias("line_no"), cand(ln).alias("k")))

        def cut(cands):
            # a nameless candidate abandons the rest of the file
            first_bad = F.array_min(F.transform(F.filter(cands, lambda t: t["k"]["name"] == ""), lambda t: t["line_no"]))
            return let(first_bad, lambda bad: F.filter(cands, lambda t: bad.isNull() | (t["line_no"] < bad)))

        return let(F.filter(tagged, lambda t: t["k"]["c"]), cut)

    kept = files.select("repo", "path", F.explode(let(split_lines(F.col("content")), per_file)).alias("t"))
    return kept.select("repo", "path", F.col("t.line_no").cast("int").alias("line_no"), F.col("t.k.name").alias("name"))


# ------------------------------------------------------------------ X7, J4


def deep_dive_samples(metrics: DataFrame, files: DataFrame) -> DataFrame:
    """W3 + X6 + X7: for each sampled file the first candidate whose fetched text
    (banner and body) has neither "not found" nor "Error"."""
    ensure_checkpoint_dir(metrics.sparkSession)
    # a few rows per repo, read by every step below: written once
    sampled = sampled_files(metrics, files).checkpoint(eager=True)
    picked = files.join(sampled, ["repo", "path"], "left_semi").select("repo", "path", "content").checkpoint(eager=True)
    cands = callable_candidates(picked.select("repo", "path", "content"))
    bodies = found_bodies(picked, cands.select("repo", "path", F.col("name").alias("method"))).withColumnRenamed("method", "name")
    tried = cands.join(bodies, ["repo", "path", "name"]).join(sampled, ["repo", "path"])
    text = F.concat(
        F.format_string(BODY_BANNER, F.col("name"), F.col("path"),
                        F.greatest(F.lit(1), F.ceil(F.length("body") / F.lit(3.8))).cast("int")),
        F.lit("\n"),
        F.col("body"),
    )
    ok = F.col("body").isNotNull() & (F.col("body") != "")
    for word in REJECT_WORDS:
        ok = ok & ~text.contains(word)
    accepted = tried.withColumn("text", text).filter(ok)
    first = accepted.groupBy("repo", "path", "rank").agg(
        F.min_by(F.struct("name", "text"), F.col("line_no")).alias("b"), F.min("line_no").alias("line_no")
    )
    return first.select("repo", "rank", "path", "line_no", F.col("b.name").alias("method"), F.col("b.text").alias("text"))


# ------------------------------------------------------------------ R3, R4


def _clean(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("/")), F.lit('"'), F.lit(""))


# One participant for the repository and one per sampled file; the scan reads a
# file and the file answers with its share of tokens saved.
DIAGRAM_KIND = "sequenceDiagram\n"
DIAGRAM_REPO = '    participant R as "%s"\n'
DIAGRAM_FILE = '    participant F%d as "%s"\n'
DIAGRAM_READ = "    R->>F%d: read\n    F%d-->>R: skeleton, %s%% smaller\n"
DIAGRAM_NO_FILES = '    participant App as "no files sampled"\n'


def sequence_diagram(metrics: DataFrame, files: DataFrame) -> DataFrame:
    """Diagram text per repo with up to three sampled files as participants."""
    s = sampled_files(metrics, files, DIAGRAM_FILES).select("repo", "path", "rank")
    s = s.join(metrics.select("repo", "path", "reduction_pct"), ["repo", "path"])

    def joined(part):
        ordered = F.sort_array(F.collect_list(F.struct("rank", "path", "reduction_pct")))
        return F.array_join(F.transform(ordered, part), "")

    nodes = s.groupBy("repo").agg(
        joined(lambda e: F.format_string(DIAGRAM_FILE, e["rank"] - 1, _clean(e["path"]))).alias("nodes"),
        joined(
            lambda e: F.format_string(DIAGRAM_READ, e["rank"] - 1, e["rank"] - 1, e["reduction_pct"].cast("string"))
        ).alias("arrows"),
    )
    repos = metrics.select("repo").distinct()
    return repos.join(nodes, "repo", "left").select(
        "repo",
        F.concat(
            F.lit(DIAGRAM_KIND),
            F.format_string(DIAGRAM_REPO, _clean(F.col("repo"))),
            F.coalesce(F.col("nodes"), F.lit(DIAGRAM_NO_FILES)),
            F.coalesce(F.col("arrows"), F.lit("")),
        ).alias("diagram"),
    )


def sample_file_pair(metrics: DataFrame, files: DataFrame) -> DataFrame:
    """Original and skeleton of the first sampled file with both token counts."""
    first = sampled_files(metrics, files, 1).select("repo", "path")
    m = metrics.select("repo", "path", "skeleton", "raw_tokens_est", "skeleton_tokens_est")
    return (
        first.join(files.select("repo", "path", "content"), ["repo", "path"])
        .join(m, ["repo", "path"])
        .select(
            "repo",
            F.col("path").alias("filename"),
            F.col("content").alias("original"),
            "skeleton",
            F.col("raw_tokens_est").alias("raw_tokens"),
            F.col("skeleton_tokens_est").alias("skeleton_tokens"),
        )
    )


# ------------------------------------------------------------------ R2, R5, R6


def _fmt_int(c: Column) -> Column:
    return F.format_number(c, 0)


REPORT_TITLE = "# Skeleton report: "
REPORT_TABLE = "\n\n| measure | value |\n| --- | --- |\n"
REPORT_MAP = "\n## Files\n\n```\n"
REPORT_MAP_END = "\n```\n"
REPORT_BODIES_HEAD = "\n## Bodies read\n\n"
REPORT_BODY = ("**", " in ", "**\n\n```\n", "\n```\n\n")
REPORT_DIAGRAM = "\n## Reads\n\n```mermaid\n"
REPORT_END = "```\n"


def body_maps(bodies: DataFrame) -> DataFrame:
    """Per repo the map ``path:method -> fetched text`` of its deep-dive samples.

    ``bodies`` has at most :data:`DEEP_DIVE_FILES` rows per repo.
    """
    entry = F.struct("rank", F.concat("path", F.lit(":"), "method").alias("key"), "text")
    ordered = F.sort_array(F.collect_list(entry))
    return bodies.groupBy("repo").agg(
        F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["key"], e["text"]))).alias("method_bodies")
    )


def repo_report(files: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """One bundle per repo: the summary, the diagram, one markdown report (metrics,
    diagram, <= 3 bodies, map excerpt), ``method_bodies`` (J4, a map; empty without
    samples) and ``sample_file`` (a struct; null without samples).

    ``metrics`` is the scanned K0 output when the caller already holds it.
    """
    if metrics is None:
        metrics = scanned_metrics(files)
    summary = M.repo_summary(metrics)
    diagram = sequence_diagram(metrics, files)
    bodies = deep_dive_samples(metrics, files)
    w = Window.partitionBy("repo").orderBy("rank")
    fetched = body_maps(bodies)
    top = bodies.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= REPORT_BODIES)
    snippets = top.groupBy("repo").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("_k", "path", "method", "text"))),
                lambda e: F.concat(
                    F.lit(REPORT_BODY[0]), e["method"], F.lit(REPORT_BODY[1]), e["path"], F.lit(REPORT_BODY[2]),
                    F.substring(e["text"], 1, BODY_EXCERPT), F.lit(REPORT_BODY[3]),
                ),
            ),
            "",
        ).alias("_b")
    )
    sample = sample_file_pair(metrics, files)
    sample = sample.select("repo", F.struct(*[c for c in sample.columns if c != "repo"]).alias("sample_file"))
    excerpt = map_excerpt(metrics)
    df = summary
    for part in (diagram, snippets, excerpt, fetched, sample):  # one row per repo each
        df = df.join(part, "repo", "left")
    bodies_txt = F.when(F.col("_b").isNull(), F.lit("")).otherwise(F.concat(F.lit(REPORT_BODIES_HEAD), F.col("_b")))
    row = lambda name, value: [F.lit(f"| {name} | "), value, F.lit(" |\n")]
    report = F.concat(
        F.lit(REPORT_TITLE), F.col("repo"), F.lit(REPORT_TABLE),
        *row("files", F.col("total_files_scanned").cast("string")),
        *row("tokens as written", _fmt_int(F.col("total_raw_tokens"))),
        *row("tokens as skeletons", _fmt_int(F.col("total_skeleton_tokens"))),
        *row("tokens saved", _fmt_int(F.col("saved_tokens"))),
        *row("saved, percent", F.col("reduction_pct").cast("string")),
        *row("ratio", F.col("compression_ratio")),
        F.lit(REPORT_MAP), F.coalesce(F.col("excerpt"), F.lit("")), F.lit(REPORT_MAP_END),
        bodies_txt,
        F.lit(REPORT_DIAGRAM), F.col("diagram"), F.lit(REPORT_END),
    )
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return df.select(
        *M.SUMMARY_COLUMNS, "diagram", report.alias("markdown_report"),
        F.coalesce(F.col("method_bodies"), none).alias("method_bodies"), "sample_file",
    )


def repo_report_snippet(report: DataFrame) -> DataFrame:
    """The console summary -- seven metrics and the first 25 report lines."""
    return report.select(
        "repo", "total_files_scanned", "total_raw_tokens", "total_skeleton_tokens", "saved_tokens", "reduction_pct",
        "compression_ratio",
        F.array_join(F.slice(split_lines(F.col("markdown_report")), 1, SNIPPET_LINES), "\n").alias("snippet"),
    )
