"""K0: skeletonize a table of files and compute per-file metrics.

``skeletonize(files)`` adds the skeleton text and the metrics columns to every
row.  All work is row-local (one file = one row); there is no shuffle, so it
parallelises over files and also runs unchanged on a stream (T2).  The texts are
walked by ``textscan``; :func:`skeleton_column` is the same as a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, memo_column
from ..functions.text import reduction_pct, split_lines, tokens_floor
from ..session import ship
from .brace import shared_c_features, shared_js_features, skeleton_c_like, skeleton_js_ts
from .python import shared_python_features, skeleton_python
from .textscan import GENERIC_HEAD, GENERIC_MARKER, GENERIC_MAX_LINES, GENERIC_TAIL, skeletons

# --- fixed values ---------------------------------------------------------
# Extension routing of the skeletonizer.
PY_EXTS = (".py",)
JS_EXTS = (".ts", ".js", ".tsx", ".jsx")
C_EXTS = (".java", ".cpp", ".c", ".cs")
# --------------------------------------------------------------------------

METRIC_COLUMNS = [
    "original_lines",
    "skeleton_lines",
    "original_char_count",
    "skeleton_char_count",
    "raw_tokens_est",
    "skeleton_tokens_est",
    "reduction_pct",
    "method_count",
    "class_count",
]


def file_ext(path) -> Column:
    """os.path.splitext(path)[1].lower()."""
    p = F.col(path) if isinstance(path, str) else path
    base = F.element_at(F.split(p, "/"), -1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1))


def skeleton_generic(content: Column, lines: Column) -> Column:
    n = F.size(lines)
    dropped = n - (GENERIC_HEAD + GENERIC_TAIL)
    marker = F.concat(F.lit(GENERIC_MARKER[0]), dropped.cast("string"), F.lit(GENERIC_MARKER[1]))
    compressed = F.array_join(
        F.concat(F.slice(lines, 1, GENERIC_HEAD), F.array(marker), F.slice(lines, -GENERIC_TAIL, GENERIC_TAIL)), "\n"
    )
    return F.when(n <= GENERIC_MAX_LINES, content).otherwise(compressed)


def language(ext: Column) -> Column:
    return (
        F.when(ext.isin(*PY_EXTS), F.lit("python"))
        .when(ext.isin(*JS_EXTS), F.lit("js_ts"))
        .when(ext.isin(*C_EXTS), F.lit("c_like"))
        .otherwise(F.lit("generic"))
    )


def _pick(s: Column) -> Column:
    return F.struct(
        s["skeleton"].alias("skeleton"), s["method_count"].alias("method_count"), s["class_count"].alias("class_count")
    )


def skeleton_column(content: str, lines: str, lang: str) -> Column:
    """``struct(skeleton, method_count, class_count)`` by language, K8 fallback included.

    One CASE over the language: only the chosen language's fold is evaluated
    for a row, and each fold is evaluated once (``let``).
    """

    def build():
        lg, ln, ct = F.col(lang), F.col(lines), F.col(content)
        generic = F.struct(
            skeleton_generic(ct, ln).alias("skeleton"),
            F.lit(0).alias("method_count"),
            F.lit(0).alias("class_count"),
        )
        py = let(
            skeleton_python(ln, shared_python_features(lines)),
            lambda p: F.when(p["malformed"], generic).otherwise(_pick(p)),
        )
        return (
            F.when(lg == "python", py)
            .when(lg == "js_ts", let(skeleton_js_ts(ln, shared_js_features(lines)), _pick))
            .when(lg == "c_like", let(skeleton_c_like(ln, shared_c_features(lines)), _pick))
            .otherwise(generic)
        )

    return memo_column(f"skeleton:{content}:{lines}:{lang}", build)


_SKELETON_TYPE = "struct<skeleton:string,method_count:int,class_count:int>"


def skeletonize(files: DataFrame, content: str = "content", path: str = "path", keep_content: bool = True) -> DataFrame:
    """Add ``language, skeleton`` and the metric columns to a files table."""
    ship(files.sparkSession)
    base = [c for c in files.columns if keep_content or c != content]
    df = files.select("*", language(file_ext(path)).alias("language"))
    # the skeleton is generated: a later filter on a metric stays above it, where a plain column's
    # expression would be put in its place and the text skeletonized once more
    sk = F.arrow_udf(skeletons, _SKELETON_TYPE)(F.col(content), F.col("language"))
    df = df.select(*base, "language", F.size(split_lines(F.col(content))).alias("_n_lines"), F.length(content).alias("_raw_chars"),
                   F.explode(F.array(sk)).alias("_sk"))
    skel = F.col("_sk.skeleton")
    raw_tok = tokens_floor(F.col("_raw_chars"))
    skel_tok = tokens_floor(F.length(skel))
    return df.select(
        *base,
        "language",
        skel.alias("skeleton"),
        F.col("_n_lines").alias("original_lines"),
        F.size(split_lines(skel)).alias("skeleton_lines"),
        F.col("_raw_chars").alias("original_char_count"),
        F.length(skel).alias("skeleton_char_count"),
        raw_tok.alias("raw_tokens_est"),
        skel_tok.alias("skeleton_tokens_est"),
        reduction_pct(raw_tok, skel_tok).alias("reduction_pct"),
        F.col("_sk.method_count").alias("method_count"),
        F.col("_sk.class_count").alias("class_count"),
    )
