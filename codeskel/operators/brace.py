"""Brace-language skeletons: JS/TS (K2) and C-like (K3), body ranges (K6).

Each works on an ``array<string>`` of lines inside one row: per-line features
with ``transform``, one ``aggregate`` fold that tracks the brace depth and emits
the body ranges, then linear reassembly.  No shuffle, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import INSIDE, RANGE_TYPE, count_true, empty, fold_growing, let, line_states, memo_column
from ..functions.text import leading_ws, py_strip

# --- fixed values ---------------------------------------------------------
# Signature pattern of the JS/TS skeletonizer, searched from the line start.
JS_SIG_RE = (
    r"(?U)^\s*(export\s+)?(default\s+)?(async\s+)?(function|class|interface|type|enum|"
    r"const\s+\w+\s*=\s*(async\s*)?\([^)]*\)\s*=>)\b"
    r"|^\s*(public|private|protected|static|async|get|set|\*)*\s*\w+\s*\([^)]*\)\s*(:\s*[^\{]+)?\s*\{"
)
# Line starts kept verbatim by the JS/TS skeletonizer.
JS_KEEP_PREFIXES = ("import ", "export ", "//", "/*", "*", "type ", "interface ")
# Declarations kept as "name = ...;" outside bodies.
JS_DECL_PREFIXES = ("const ", "let ", "var ")
# Line starts (or substrings) kept verbatim by the C-like skeletonizer.
C_KEEP_PREFIXES = ("package ", "import ", "#include", "using ", "//", "/*", "*", "@")
C_KEEP_CONTAINS = ("class ", "interface ")
C_CLASS_CONTAINS = ("class ", "interface ", "struct ")
# Marker text around the line count; the indent is the opener's indent plus
# 2 (JS/TS) or 4 (C-like).
BODY_MARKER = ("/* [Body compressed: ", " lines] */")
# --------------------------------------------------------------------------


def _starts_any(col: Column, prefixes) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | col.startswith(p)
    return cond


def _contains_any(col: Column, subs) -> Column:
    cond = F.lit(False)
    for s in subs:
        cond = cond | col.contains(s)
    return cond


def brace_net(line: Column) -> Column:
    """line.count('{') - line.count('}')."""
    return (F.length(F.replace(line, F.lit("}"), F.lit(""))) - F.length(F.replace(line, F.lit("{"), F.lit("")))).cast(
        "int"
    )


def _marker(feats: Column, opener: Column, close_idx: Column, extra_indent: str) -> Column:
    return F.concat(
        F.get(feats, opener)["ws"],
        F.lit(extra_indent + BODY_MARKER[0]),
        (close_idx - opener).cast("string"),
        F.lit(BODY_MARKER[1]),
    )


def _fold_ranges(feats: Column, opens, counts, resets=None) -> Column:
    """Brace-depth fold over feature structs; returns body ranges ``array<struct<o,c>>``.

    ``opens(f)``: line may open a body (only when none is open).
    ``counts(f)``: line is counted inside a body (depth += net, closes at <= 0).
    ``resets(f)``: line sets depth to its net even inside a body (C-like).
    """
    init = [F.lit(False).alias("in_body"), F.lit(0).alias("depth"), F.lit(0).alias("start"), F.lit(0).alias("i")]

    def step(acc, f):
        in_body, counted = acc["in_body"], acc["in_body"] & counts(f)
        flags = F.struct(
            (~in_body & opens(f)).alias("open_now"), counted.alias("counted"),
            (counted & (acc["depth"] + f["net"] <= 0)).alias("close_now"),
        )
        return let(flags, lambda d: advance(acc, f, d["open_now"], d["counted"], d["close_now"]))

    def advance(acc, f, open_now, counted, close_now):
        in_body, depth, i = acc["in_body"], acc["depth"], acc["i"]
        new_depth = F.when(counted, depth + f["net"])
        if resets is not None:
            new_depth = new_depth.when(resets(f), f["net"])
        new_depth = new_depth.when(open_now, f["net"]).otherwise(depth)
        return F.struct(
            (F.when(open_now, F.lit(True)).when(close_now, F.lit(False)).otherwise(in_body)).alias("in_body"),
            new_depth.alias("depth"),
            F.when(open_now, i).otherwise(acc["start"]).alias("start"),
            (i + 1).alias("i"),
            F.when(close_now, F.array(F.struct(acc["start"].alias("o"), i.alias("c")))).otherwise(empty(RANGE_TYPE)).alias("items"),
            close_now.alias("emit"),
        )

    def finish(acc, ranges):
        last = F.array(F.struct(acc["start"].alias("o"), F.lit(None).cast("int").alias("c")))
        return F.concat(ranges, F.when(acc["in_body"], last).otherwise(empty(RANGE_TYPE)))

    return fold_growing(feats, init, RANGE_TYPE, step, finish)


# ---------------------------------------------------------------- JS / TS


def js_features(lines: Column) -> Column:
    def feat(line):
        return let(py_strip(line), lambda s: _feat(line, s))

    def _feat(line, s):
        # the pattern needs "(...)...{" or one of its leading keywords
        maybe = (line.contains("(") & line.contains("{")) | _contains_any(
            line, ("function", "class", "interface", "type", "enum", "const")
        )
        sig = maybe & line.rlike(JS_SIG_RE)
        fn_like = _contains_any(s, ("function", "=>", "("))
        kept = _starts_any(s, JS_KEEP_PREFIXES) | sig
        net = brace_net(line)
        return F.struct(
            line.alias("line"),
            leading_ws(line).alias("ws"),
            kept.alias("kept"),
            (kept & line.contains("{") & fn_like & (net > 0)).alias("opener"),
            net.alias("net"),
            (fn_like & sig).alias("is_method"),
            (s.startswith("class ") | s.contains(" class ")).alias("is_class"),
            _starts_any(s, JS_DECL_PREFIXES).alias("decl"),
        )

    return F.transform(lines, feat)


def js_ranges(feats: Column) -> Column:
    return _fold_ranges(feats, opens=lambda f: f["opener"], counts=lambda f: ~f["kept"])


def shared_js_features(lines_name: str) -> Column:
    return memo_column(f"js_features:{lines_name}", lambda: js_features(F.col(lines_name)))


def shared_c_features(lines_name: str) -> Column:
    return memo_column(f"c_features:{lines_name}", lambda: c_features(F.col(lines_name)))


def skeleton_js_ts(lines: Column, feats: Column | None = None) -> Column:
    """struct(skeleton, method_count, class_count, ranges) for JS/TS files."""
    return let(
        js_features(lines) if feats is None else feats,
        lambda feats: let(js_ranges(feats), lambda ranges: _assemble_js(feats, ranges)),
    )


def _assemble_js(feats: Column, ranges: Column) -> Column:
    return let(line_states(ranges, F.size(feats)), lambda states: _emit_js(feats, ranges, states))


def _emit_js(feats: Column, ranges: Column, states: Column) -> Column:
    def out(f, i):
        st = F.get(states, i)
        decl = F.when(
            f["line"].contains("="), F.concat(F.substring_index(f["line"], "=", 1), F.lit("= ...;"))
        ).otherwise(f["line"])
        return (
            F.when(f["kept"], F.array(f["line"]))
            .when(st == INSIDE, empty("array<string>"))
            .when(st >= 0, F.array(_marker(feats, st, i, "  "), f["line"]))
            .when(f["decl"], F.array(decl))
            .otherwise(empty("array<string>"))
        )

    skeleton = F.array_join(F.flatten(F.transform(feats, out)), "\n")
    return F.struct(
        skeleton.alias("skeleton"),
        count_true(feats, lambda f: f["is_method"]).alias("method_count"),
        count_true(feats, lambda f: f["is_class"]).alias("class_count"),
        ranges.alias("ranges"),
    )


# ---------------------------------------------------------------- C-like


def c_features(lines: Column) -> Column:
    def feat(line, i):
        return let(py_strip(line), lambda s: _feat(line, i, s))

    def _feat(line, i, s):
        nxt = F.get(lines, i + 1)
        rule1 = _starts_any(s, C_KEEP_PREFIXES) | _contains_any(s, C_KEEP_CONTAINS)
        sig = (
            ~rule1
            & line.contains("(")
            & line.contains(")")
            & (s.endswith("{") | F.coalesce(py_strip(nxt).startswith("{"), F.lit(False)))
        )
        net = brace_net(line)
        return F.struct(
            line.alias("line"),
            leading_ws(line).alias("ws"),
            rule1.alias("rule1"),
            sig.alias("sig"),
            (sig & line.contains("{")).alias("reset"),
            net.alias("net"),
            _contains_any(s, C_CLASS_CONTAINS).alias("is_class"),
            ((s == "}") | (s == "};")).alias("closer"),
        )

    return F.transform(lines, feat)


def c_ranges(feats: Column) -> Column:
    return _fold_ranges(
        feats,
        opens=lambda f: f["reset"] & (f["net"] > 0),
        counts=lambda f: ~f["rule1"] & ~f["sig"],
        resets=lambda f: f["reset"],
    )


def skeleton_c_like(lines: Column, feats: Column | None = None) -> Column:
    return let(
        c_features(lines) if feats is None else feats,
        lambda feats: let(
            c_ranges(feats),
            lambda ranges: let(line_states(ranges, F.size(feats)), lambda states: _emit_c(feats, ranges, states)),
        ),
    )


def _emit_c(feats: Column, ranges: Column, states: Column) -> Column:
    def out(f, i):
        st = F.get(states, i)
        return (
            F.when(f["rule1"] | f["sig"], F.array(f["line"]))
            .when(st == INSIDE, empty("array<string>"))
            .when(st >= 0, F.array(_marker(feats, st, i, "    "), f["line"]))
            .when(f["closer"], F.array(f["line"]))
            .otherwise(empty("array<string>"))
        )

    skeleton = F.array_join(F.flatten(F.transform(feats, out)), "\n")
    return F.struct(
        skeleton.alias("skeleton"),
        count_true(feats, lambda f: f["sig"]).alias("method_count"),
        count_true(feats, lambda f: f["is_class"]).alias("class_count"),
        ranges.alias("ranges"),
    )
