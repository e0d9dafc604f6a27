"""Method body lookup (J1, X1-X5) through a definition index, and fetch totals (A3).

``definition_index(files)`` holds, per file, every name that a lookup can find, with
the range of lines of its body:

* ``.py`` that parses (balanced brackets and quotes): a ``def`` of that name, the
  first in breadth-first order (shallowest block depth, then line), from the ``def``
  line to the last statement line of its block.  One walk over the lines, with a stack
  of open blocks, gives all of them;
* otherwise, any language: the first line where the name stands before ``(``, then up
  to 149 further lines -- Python stops at (and includes) the first code line
  indented at most as deep, brace languages at the first line where the running
  brace count is <= 0 and that holds a ``}``.

``method_bodies(files, requests)`` and ``fetch_tokens`` gather the requests of a file in
rows of a bounded number, join these to their file and answer them from its text
(``textscan``), walked once.  ``found_bodies`` joins requests to the index on all three
keys and cuts the ranges found out of their files.  Names that are not plain words
(``$load``, ``operator==``) have no entry and are looked up by scanning their files'
lines.  :func:`extract_method_body` gives the same for one request as a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import OUTSIDE, RANGE_TYPE, empty, fold_growing, let, line_states, memo_column
from ..functions.text import indent_width, py_strip, regex_quote, split_lines, tokens_ceil, tokens_of_chars
from ..session import ship
from .brace import brace_net
from .python import python_features, shared_python_features
from .skeleton import file_ext
from .textscan import BODY_MAX_LINES, START_KEYWORDS, bodies, chunks, definitions, lengths

# --- fixed values ---------------------------------------------------------
NOT_FOUND_FILE = "Error: File '%s' not found."
READ_ERROR = "Error reading '%s': %s"
NOT_FOUND_METHOD = "Method '%s' not found in '%s'."
BODY_BANNER = "=== METHOD BODY: %s in %s (~%d tokens) ==="
# --------------------------------------------------------------------------


def start_pattern(method: Column) -> Column:
    """Regex for the line where ``method`` starts (Unicode word boundaries)."""
    kws = "|".join(START_KEYWORDS)
    # a name that starts with a word character has its word boundary right before the keywords or itself;
    # another one (``$load``) needs the boundary of a word before it, and the white space between
    lead = F.when(method.rlike(r"(?U)^\w"), F.lit(f"(?U)\\b(?:{kws})*")).otherwise(F.lit(f"(?U)\\b(?:{kws}|\\s)*"))
    return F.concat(lead, regex_quote(method), F.lit("\\s*\\("))


def python_parses(lines: Column, feats: Column | None = None) -> Column:
    """struct(ok, spans): whether brackets and triple quotes balance at the end of the file
    (K8's test), and the statements of several lines as ranges of first and last line."""
    init = [
        F.lit("").alias("q"), F.lit(0).alias("depth"), F.lit(False).alias("cont"), F.lit(False).alias("bad"),
        F.lit(0).alias("i"), F.lit(-1).alias("open"),
    ]

    def step(a, f):
        g = F.when(a["q"] == "", f["n0"]).when(a["q"] == '"""', f["nd"]).otherwise(f["ns"])
        whole = (a["q"] != "") & g.isNull()
        after = F.struct(
            F.when(whole, a["q"]).otherwise(g["q"]).alias("q"),
            F.when(whole, a["depth"]).otherwise(a["depth"] + g["net"]).alias("depth"),
            F.when(whole, F.lit(False)).otherwise(g["cont"]).alias("cont"),
        )
        return let(after, lambda b: advance(a, b))

    def advance(a, b):
        inside = (b["q"] != "") | (b["depth"] > 0) | b["cont"]
        closes = ~inside & (a["open"] >= 0)
        span = F.struct(a["open"].alias("o"), a["i"].alias("c"))
        return F.struct(
            b["q"].alias("q"), b["depth"].alias("depth"), b["cont"].alias("cont"),
            (a["bad"] | (b["depth"] < 0)).alias("bad"),
            (a["i"] + 1).alias("i"),
            F.when(inside & (a["open"] < 0), a["i"]).when(inside, a["open"]).otherwise(F.lit(-1)).alias("open"),
            F.when(closes, F.array(span)).otherwise(empty(RANGE_TYPE)).alias("items"),
            closes.alias("emit"),
        )

    return fold_growing(
        python_features(lines) if feats is None else feats,
        init,
        RANGE_TYPE,
        step,
        lambda a, spans: F.struct((~a["bad"] & (a["q"] == "") & (a["depth"] == 0) & ~a["cont"]).alias("ok"), spans.alias("spans")),
    )


def _is_code(line: Column) -> Column:
    s = py_strip(line)
    return (s != "") & ~s.startswith("#")


def _block_depth(code_ind: Column, i: Column) -> Column:
    """1 + number of enclosing blocks of line ``i`` by indentation."""
    ind = F.get(code_ind, i)
    stack = F.aggregate(
        F.slice(code_ind, 1, i),
        F.array().cast("array<int>"),
        lambda st, x: F.when(x >= 0, F.concat(F.filter(st, lambda e: e < x), F.array(x))).otherwise(st),
    )
    return F.size(F.filter(stack, lambda e: e < ind)) + 1


def _python_def_body(lines: Column, code_ind: Column, method: Column) -> Column:
    """Body of the first ``def method`` in breadth-first order, or null.

    ``code_ind`` holds the indent of each line that starts a statement, -1 for blank
    and comment lines and -2 for the further lines of a statement.
    """
    n = F.size(lines)
    pat = F.concat(F.lit("^(?:async\\s+)?def\\s+"), regex_quote(method), F.lit("\\s*\\("))
    cands = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (F.get(code_ind, i) >= 0) & F.get(lines, i).contains(method) & F.regexp_like(py_strip(F.get(lines, i)), pat),
    )

    def body(i):
        ind = F.get(code_ind, i)
        stop = F.get(
            F.filter(F.sequence(i + 1, n), lambda j: (j == n) | ((F.get(code_ind, j) >= 0) & (F.get(code_ind, j) <= ind))),
            0,
        )
        last = F.array_max(F.filter(F.sequence(i, stop - 1), lambda j: (j == i) | (F.get(code_ind, j) != -1)))
        return F.array_join(F.slice(lines, i + 1, last - i + 1), "\n")

    def pick(cs):
        # breadth-first order only matters when several defs share the name
        by_depth = F.array_min(F.transform(cs, lambda i: F.struct(_block_depth(code_ind, i).alias("d"), i.alias("i"))))["i"]
        first = F.when(F.size(cs) == 1, F.get(cs, 0)).otherwise(by_depth)
        return F.when(F.size(cs) > 0, let(first, body))

    return let(cands, pick)


def _fallback_body(lines: Column, code_ind: Column, nets: Column, method: Column, is_py: Column) -> Column:
    """Regex start line plus the bounded block rule, or null."""
    n = F.size(lines)
    pat = start_pattern(method)
    hits = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(lines, i).contains(method) & F.regexp_like(F.get(lines, i), pat),
    )

    def body(s):
        return let(indent_width(F.get(lines, s)), lambda ind: _body(s, ind))

    def _body(s, ind):
        last_j = F.least(s + BODY_MAX_LINES - 1, n - 1)
        py_stop = F.get(
            F.filter(
                F.sequence(s + 1, F.greatest(last_j, s + 1)),
                lambda j: (j <= last_j) & (F.get(code_ind, j) >= 0) & (F.get(code_ind, j) <= ind),
            ),
            0,
        )

        def brace_step(a, j):
            total = a["bc"] + F.get(nets, j)
            hit = a["stop"].isNull() & (total <= 0) & F.get(lines, j).contains("}")
            return F.struct(total.alias("bc"), F.when(hit, j).otherwise(a["stop"]).alias("stop"))

        brace = F.aggregate(
            F.sequence(s + 1, F.greatest(last_j, s + 1)),
            F.struct(F.get(nets, s).alias("bc"), F.lit(None).cast("int").alias("stop")),
            lambda a, j: F.when(j <= last_j, brace_step(a, j)).otherwise(a),
        )["stop"]
        stop = F.coalesce(F.when(is_py, py_stop).otherwise(brace), last_j)
        return F.array_join(F.slice(lines, s + 1, stop - s + 1), "\n")

    return let(hits, lambda hs: F.when(F.size(hs) > 0, let(F.get(hs, 0), body)))


def extract_method_body(
    lines: str = "lines", path: str = "path", method: str = "method", py_ok: str = "py_ok"
) -> Column:
    """The body text of ``method`` in the file, or null when not found.

    ``lines``, ``code_ind``, ``stmt_ind``, ``nets`` and ``py_ok`` are the per-file columns from
    :func:`prepare_files`, so each request only scans integers and the lines
    that contain the name.
    """

    def build():
        is_py = file_ext(F.col(path)) == ".py"
        ln, m = F.col(lines), F.col(method)
        ci, nets = F.col("code_ind"), F.col("nets")
        ast_body = F.when(is_py & F.coalesce(F.col(py_ok), F.lit(False)), _python_def_body(ln, F.col("stmt_ind"), m))
        return F.when(F.exists(ln, lambda x: x.contains(m)), F.coalesce(ast_body, _fallback_body(ln, ci, nets, m, is_py)))

    return memo_column(f"method_body:{lines}:{path}:{method}:{py_ok}:v3", build)


def prepare_files(files: DataFrame) -> DataFrame:
    """Per-file inputs of the lookups, computed once per file (not per request):
    the line array, each line's indent (-1 for blank/comment lines), each line's
    brace net and, for Python, whether the file parses."""
    parses = memo_column(
        "python_parses:_lines", lambda: python_parses(F.col("_lines"), shared_python_features("_lines"))
    )
    code_ind = memo_column(
        "code_ind:_lines",
        lambda: F.transform(F.col("_lines"), lambda ln: F.when(_is_code(ln), indent_width(ln)).otherwise(F.lit(-1)).cast("int")),
    )
    nets = memo_column("nets:_lines", lambda: F.transform(F.col("_lines"), brace_net))
    with_lines = files.select("repo", "path", split_lines(F.col("content")).alias("_lines"))
    prepared = with_lines.select(
        "repo", "path", F.col("_lines").alias("lines"), code_ind.alias("code_ind"), nets.alias("nets"),
        (file_ext(F.col("path")) == ".py").alias("is_py"),
        F.when(file_ext(F.col("path")) == ".py", parses).alias("_parse"),
    )
    state = line_states(F.col("_parse.spans"), F.size("lines"))
    stmt_ind = F.zip_with("code_ind", state, lambda ind, s: F.when(s != OUTSIDE, F.lit(-2)).otherwise(ind))
    return prepared.select(
        "repo", "path", "is_py", "lines", "code_ind", "nets", F.col("_parse.ok").alias("py_ok"),
        F.when(F.col("_parse.ok"), stmt_ind).alias("stmt_ind"),
    )


# ------------------------------------------------------------------ definition index

#: Names that the index holds; others are looked up by scanning.
PLAIN_NAME = r"(?U)^\w+$"
_INDEX_TYPE = "array<struct<name:string,start:int,stop:int,chars:int>>"
_LENGTHS_TYPE = "array<struct<method:string,chars:int>>"


def _is_py() -> Column:
    return file_ext(F.col("path")) == ".py"


def definition_index(files: DataFrame) -> DataFrame:
    """``(repo, path, name, start, stop, chars)``: each name of each file with the lines
    of its body (0-based, inclusive) and the body's length.  Row-local: no shuffle."""
    ship(files.sparkSession)
    found = F.arrow_udf(definitions, _INDEX_TYPE)(F.col("content"), _is_py())
    rows = files.select("repo", "path", F.explode(found).alias("d"))
    return rows.select("repo", "path", "d.name", "d.start", "d.stop", "d.chars")


def _asked_files(files: DataFrame, requests: DataFrame) -> DataFrame:
    return files.join(requests.select("repo", "path").distinct(), ["repo", "path"], "left_semi")


def _scanned_bodies(files: DataFrame, requests: DataFrame) -> DataFrame:
    """``(repo, path, method, body)`` of the requests that no index entry can answer."""
    odd = requests.filter(~F.col("method").rlike(PLAIN_NAME)).select("repo", "path", "method").distinct()
    joined = odd.join(prepare_files(_asked_files(files, odd)), ["repo", "path"])
    return joined.select("repo", "path", "method", extract_method_body().alias("body")).filter(F.col("body") != "")


def found_bodies(files: DataFrame, requests: DataFrame) -> DataFrame:
    """``(repo, path, method, body)`` of the distinct requests whose method is found."""
    asked = requests.select("repo", "path", "method").distinct()
    files = files.select("repo", "path", "content")
    mine = _asked_files(files, asked)
    hits = definition_index(mine).withColumnRenamed("name", "method").join(asked, ["repo", "path", "method"])
    # at most the names of one file meet here
    ranges = hits.groupBy("repo", "path").agg(F.collect_list(F.struct("method", "start", "stop")).alias("ranges"))
    body = lambda r: F.array_join(F.slice(F.col("lines"), r["start"] + 1, r["stop"] - r["start"] + 1), "\n")
    cut = (
        mine.select("repo", "path", split_lines(F.col("content")).alias("lines"))
        .join(ranges, ["repo", "path"])
        .select("repo", "path", F.explode(F.transform("ranges", lambda r: F.struct(r["method"].alias("method"), body(r).alias("body")))).alias("b"))
        .select("repo", "path", "b.method", "b.body")
    )
    return cut.unionByName(_scanned_bodies(files, asked))


def _asked_methods(requests: DataFrame) -> DataFrame:
    """``(repo, path, methods)``: every request, those of a file in one row or a few.

    A file's requests meet in one task, which sorts them (spilling) and writes at most
    :data:`~.textscan.CHUNK` of them into a row; no array holds all requests of a file.
    """
    dealt = requests.select("repo", "path", "method").hint("rebalance", "repo", "path")
    # rows of a file stand together in the order of their hash; that others may share it does no harm
    dealt = dealt.withColumn("_h", F.xxhash64("repo", "path")).sortWithinPartitions("_h").drop("_h")
    return dealt.mapInArrow(chunks, "repo string, path string, methods array<string>")


def fetch_tokens(files: DataFrame, requests: DataFrame) -> DataFrame:
    """``(repo, path, method, tokens)``: one row per request whose method is found (A2, A3).

    No body is built: a file's requests are joined to it and answered with lengths.
    """
    ship(files.sparkSession)
    asked = files.select("repo", "path", "content").join(_asked_methods(requests), ["repo", "path"])
    found = F.arrow_udf(lengths, _LENGTHS_TYPE)(F.col("content"), _is_py(), F.col("methods"))
    rows = asked.select("repo", "path", F.explode(found).alias("f"))
    return rows.select("repo", "path", F.col("f.method").alias("method"), tokens_of_chars(F.col("f.chars")).alias("tokens"))


def method_bodies(files: DataFrame, requests: DataFrame) -> DataFrame:
    """J1 + X5: one row per request with status, body, tokens and the tool's text.

    Files that could not be read (``error`` is not null, see the tree source) answer
    with the reading error.
    """
    ship(files.sparkSession)
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    # rows of one path answer together, as the lines found in one of them are cut out of each
    same = Window.partitionBy("repo", "path")
    texts = F.collect_list(F.when(error.isNull(), F.struct("content"))).over(same)
    known = files.select("repo", "path", error.alias("_error"), texts.alias("_texts"))
    asked = _asked_methods(requests).join(known, ["repo", "path"], "left")
    asked = asked.select("repo", "path", "_error", "_texts", _is_py().alias("_is_py"), "methods")
    df = asked.mapInArrow(bodies, "repo string, path string, _error string, _file boolean, method string, body string")
    tokens = tokens_ceil(F.col("body"))
    status = (
        F.when(~F.col("_file"), F.lit("file not found"))
        .when(F.col("_error").isNotNull(), F.lit("read error"))
        .when(F.col("body").isNull() | (F.col("body") == ""), F.lit("method not found"))
        .otherwise(F.lit("found"))
    )
    text = (
        F.when(status == "file not found", F.format_string(NOT_FOUND_FILE, F.col("path")))
        .when(status == "read error", F.format_string(READ_ERROR, F.col("path"), F.col("_error")))
        .when(status == "method not found", F.format_string(NOT_FOUND_METHOD, F.col("method"), F.col("path")))
        .otherwise(
            F.concat(
                F.format_string(BODY_BANNER, F.col("method"), F.col("path"), tokens),
                F.lit("\n"),
                F.col("body"),
            )
        )
    )
    return df.select(
        "repo",
        "path",
        "method",
        status.alias("status"),
        F.when(status == "found", F.col("body")).alias("body"),
        F.when(status == "found", tokens).otherwise(F.lit(0)).alias("tokens"),
        text.alias("result"),
    )
