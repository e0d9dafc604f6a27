"""Symbol reference search (J3) with counts (A4) and the top-50 report.

A line matches a symbol when it contains it as a substring (no word match).
Lines come from the files split at LF only; the reported text is stripped.

Scale: many symbols are matched line by line inside the tasks, through an index of
the symbols' word runs that every task holds.  Counts are a ``groupBy`` with map-side partial aggregation;
the top-N rows use ``row_number() <= N`` which Spark plans as a per-task
``WindowGroupLimit``, so a symbol matching a third of all lines never lands in
one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip, split_lf_lines
from ..session import ensure_checkpoint_dir, ship
from ..sources.files import scan_filter

# --- fixed values ---------------------------------------------------------
TOP_N = 50
# --------------------------------------------------------------------------

def searched_files(files: DataFrame) -> DataFrame:
    """The files a search reads: none below an ignored directory (any extension), none that could not be read."""
    kept = files.filter(scan_filter("path", supported_only=False))
    return kept.filter(F.col("error").isNull()) if "error" in files.columns else kept


def search_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """``(repo, path, line_no, line)``: one row per LF-terminated line, 1-based."""
    return files.select(
        "repo", "path", F.posexplode(split_lf_lines(F.col(content))).alias("pos", "line")
    ).select("repo", "path", (F.col("pos") + 1).cast("int").alias("line_no"), "line")


def find_references(lines: DataFrame, symbol: str) -> DataFrame:
    """All lines containing ``symbol``: filter pushed into the line scan."""
    return lines.filter(F.col("line").contains(symbol)).select(
        F.lit(symbol).alias("symbol"), "repo", "path", "line_no", py_strip(F.col("line")).alias("text")
    )


#: A line is a sequence of maximal runs of word characters and of other characters.
WORD_RUN, OTHER_RUN = r"\w+", r"\W+"
MAX_GRAM = 8
#: Symbols that one pass over the lines looks for, runs whose symbols a task remembers, lines of an Arrow batch.
SYMBOL_BLOCK, KNOWN_RUNS, LINE_BATCH = 65_536, 200_000, 1_024


def _line_hits(symbols: list[tuple[int, str]]):
    """Batches of ``(repo, path, line_no, line)`` to the lines that hold a symbol, with the numbers of theirs.

    A symbol's longest run (its *anchor*) can only occur inside a run of the line.  Each
    distinct run is looked at once: its substrings of at most :data:`MAX_GRAM` characters
    probe the heads of the anchors.  A symbol of one run is settled by that; for others,
    the line is compared in full.
    """

    def index():
        heads: dict[str, dict[str, tuple[list, list]]] = {}
        for n, symbol in symbols:
            anchor = max(re.findall(f"{WORD_RUN}|{OTHER_RUN}", symbol), key=len)
            whole, mixed = heads.setdefault(anchor[:MAX_GRAM], {}).setdefault(anchor, ([], []))
            if symbol == anchor:
                whole.append(n)
            else:
                mixed.append((n, symbol))
        return heads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = index()
        lengths = sorted({len(h) for h in heads})
        words_only = all(re.fullmatch(WORD_RUN, h) for h in heads)
        runs_of = re.compile(WORD_RUN if words_only else f"{WORD_RUN}|{OTHER_RUN}").findall
        known: dict[str, tuple[frozenset, frozenset]] = {}

        def symbols_in(word: str) -> tuple[frozenset, frozenset]:
            whole, mixed = set(), set()
            for i in range(len(word)):
                for k in lengths:
                    for anchor, (ids, others) in heads.get(word[i : i + k], {}).items():
                        if len(anchor) >= k and word.startswith(anchor, i):
                            whole.update(ids)
                            mixed.update(others)
            if len(known) >= KNOWN_RUNS:
                known.clear()
            found = known[word] = frozenset(whole), frozenset(mixed)
            return found

        def hits(line: str) -> list[int]:
            found: set[int] = set()
            for word in set(runs_of(line)):
                whole, mixed = known.get(word) or symbols_in(word)
                found |= whole
                if mixed:
                    found.update(n for n, symbol in mixed if symbol in line)
            return sorted(found)

        for batch in batches:
            for at in range(0, batch.num_rows, LINE_BATCH):
                part = batch.slice(at, LINE_BATCH)
                found = pa.array([hits(x) for x in part.column(3).to_pylist()], pa.list_(pa.int32()))
                out = pa.RecordBatch.from_arrays([*part.columns[:3], found], names=["repo", "path", "line_no", "hits"])
                yield out.filter(pc.greater(pc.list_value_length(found), 0))

    return run


def match_symbols(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Keys ``(symbol, repo, path, line_no)`` of every line that contains the symbol.

    The symbols, a list of questions, go to every task (in blocks of
    :data:`SYMBOL_BLOCK`, each one pass over the lines).  A line gives one row with the
    numbers of the symbols that it holds; these rows are written once to the shared
    folder, and the keys are spelled out from there by each reader, so what is shuffled
    and written grows with the lines, not with the pairs of lines and symbols.
    """
    spark = lines.sparkSession
    ship(spark)
    ensure_checkpoint_dir(spark)
    wanted = symbols.select("symbol").filter(F.col("symbol").isNotNull() & (F.col("symbol") != "")).distinct()
    named = list(enumerate(sorted(r.symbol for r in wanted.collect())))
    names = spark.createDataFrame(named, "id int, symbol string")
    schema = "repo string, path string, line_no int, hits array<int>"
    keyed = lines.select("repo", "path", "line_no", "line").filter(F.col("line").isNotNull())
    passes = [
        keyed.mapInArrow(_line_hits(named[i : i + SYMBOL_BLOCK]), schema) for i in range(0, max(len(named), 1), SYMBOL_BLOCK)
    ]
    # a line that comes more than once counts once
    found = reduce(DataFrame.unionByName, passes).groupBy("repo", "path", "line_no").agg(
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits")
    )
    found = found.checkpoint(eager=True)
    pairs = found.select("repo", "path", "line_no", F.explode("hits").alias("id"))
    return pairs.join(F.broadcast(names), "id").select("symbol", "repo", "path", "line_no")


def reference_report(matches: DataFrame, symbols: DataFrame, n: int = TOP_N, lines: DataFrame | None = None) -> DataFrame:
    """Per (symbol, repo): total ``ref_count`` and the first ``n`` matches in path/line order.

    Symbols without any match keep one row with ``ref_count`` 0 (the "no
    references" case).  With ``lines``, ``matches`` holds keys only, and the text is
    joined to the top rows alone.
    """
    counts = matches.groupBy("symbol", "repo").agg(F.count(F.lit(1)).alias("ref_count"))
    w = Window.partitionBy("symbol", "repo").orderBy("path", "line_no")
    top = matches.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    if lines is not None:
        texts = lines.select("repo", "path", "line_no", py_strip(F.col("line")).alias("text"))
        top = top.join(texts, ["repo", "path", "line_no"])
    found = top.join(counts, ["symbol", "repo"], "inner")
    missing = (
        symbols.select("symbol")
        .distinct()
        .join(counts.select("symbol").distinct(), "symbol", "left_anti")
        .select(
            "symbol",
            F.lit(None).cast("string").alias("repo"),
            F.lit(0).cast("long").alias("ref_count"),
            F.lit(None).cast("int").alias("rank"),
            F.lit(None).cast("string").alias("path"),
            F.lit(None).cast("int").alias("line_no"),
            F.lit(None).cast("string").alias("text"),
        )
    )
    cols = ["symbol", "repo", "ref_count", "rank", "path", "line_no", "text"]
    return found.select(*cols).unionByName(missing.select(*cols))


def reference_header(report: DataFrame) -> DataFrame:
    """The text the search tool prints above its rows, one per (symbol, repo)."""
    return report.filter(F.col("rank").isNull() | (F.col("rank") == 1)).select(
        "symbol",
        "repo",
        F.when(F.col("ref_count") == 0, F.format_string("No references found for symbol '%s'.", F.col("symbol")))
        .otherwise(F.format_string("Found %d reference(s) to '%s':", F.col("ref_count"), F.col("symbol")))
        .alias("header"),
    )
