"""Python skeleton (K1) with gap markers (K5) and the unparsable fallback (K8).

No parser: one ``aggregate`` fold per file walks the physical lines, tracking the
open triple-quote delimiter, the bracket depth, backslash continuations and an
indentation stack of enclosing statements.  A *logical line* starts where no
string or bracket is open.  The fold keeps what the syntax-tree rules keep:

* module docstring -> lines 1..9; module-level import/from/assignment lines;
* reachable ``class`` (only through class/def parents): the class line, first
  line of each decorator, docstring lines;
* reachable ``def``/``async def``: first line of each decorator, header lines
  up to the first body statement (a one-line def keeps nothing), docstring.

It emits only kept *ranges*; runs of dropped lines become
``{indent+4}...  # [Body compressed: n lines]`` in a linear reassembly.
Known deviations from a real parser are listed in the README.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import empty, fold_growing, let, memo_column
from ..functions.text import WS_CLASS, indent_width, py_strip

# --- fixed values ---------------------------------------------------------
# Python keywords (never the target of an assignment).
PY_KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except "
    "finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
).split()
# Gap marker; the indent is the width of the line before the gap plus 4.
GAP_MARKER = ("...  # [Body compressed: ", " lines]")
# Lines kept when the module has a docstring (1-based, inclusive).
MODULE_DOC_LINES = 9
# --------------------------------------------------------------------------

# Strings and comments of one physical line; an unclosed triple quote leaves
# its delimiter (group 1) so the caller can see the string stays open.
_TOKEN_RE = (
    r'"""(?:[^"\\]|\\.|"(?!""))*+"""'
    r"|'''(?:[^'\\]|\\.|'(?!''))*+'''"
    r"|(\"\"\"|''')[\s\S]*"
    r'|"(?:[^"\\]|\\.)*+"'
    r"|'(?:[^'\\]|\\.)*+'"
    r"|#.*"
)
_KW = "|".join(PY_KEYWORDS)
# On code whose strings and brackets are blanked: an "=" that is no part of another operator, or an annotation.
_ASSIGN_RE = (
    rf"(?U)^(?!(?:{_KW})\b)[^=]*(?<![=!<>:+\-*/%&|^@])=(?!=)"
    rf"|^(?!(?:{_KW})\b)[^\W\d][\w.]*\s*:\s*[^\s=]"
)
_EMPTY_STRING_RE = r"^[rRuU]?(\"\"|''|\"{6}|'{6})\s*(#.*)?$"

K_OTHER, K_CLASS, K_DEF, K_DECO, K_IMPORT, K_ASSIGN = 0, 1, 2, 3, 4, 5
P_NONE, P_CLASS, P_DEF = 0, 1, 2

STACK_TYPE = "array<struct<ind:int,blk:boolean>>"
SEG_TYPE = "array<struct<s:int,e:int>>"


def _count_chars(s: Column, chars: str) -> Column:
    held = reduce(lambda a, b: a | b, [s.contains(c) for c in chars])
    return F.when(held, F.length(s) - F.length(F.translate(s, chars, ""))).otherwise(F.lit(0))


def _code_feats(s: Column) -> Column:
    """Exit delimiter, bracket net and continuation of code text ``s``."""

    def feats(c):
        exit_delim = F.when(c.endswith('"""'), F.lit('"""')).when(c.endswith("'''"), F.lit("'''")).otherwise(F.lit(""))
        net = (_count_chars(c, "([{") - _count_chars(c, ")]}")).cast("int")
        return F.struct(
            exit_delim.alias("q"),
            net.alias("net"),
            (~c.endswith('"""') & ~c.endswith("'''") & c.endswith("\\")).alias("cont"),
        )

    # lines without quotes or '#' have nothing to blank: skip the regex
    has_tokens = s.contains('"') | s.contains("'") | s.contains("#")
    return let(F.when(has_tokens, F.regexp_replace(s, _TOKEN_RE, "$1")).otherwise(s), feats)


def _no_strings(s: Column) -> Column:
    return F.when(s.contains('"') | s.contains("'") | s.contains("#"), F.regexp_replace(s, _TOKEN_RE, "$1")).otherwise(s)


def _is_assignment(s: Column) -> Column:
    """Stripped module-level line ``s`` assigns or annotates outside brackets and strings."""


    def blanked(c):
        # one pass per opening bracket blanks any nesting, from the inside out
        passes = F.array_repeat(F.lit(0), _count_chars(c, "([{"))
        inner = F.aggregate(passes, c, lambda acc, _: F.regexp_replace(acc, r"[(\[{][^()\[\]{}]*[)\]}]", "_"))
        return F.regexp_replace(inner, r"[(\[{].*$", "_").rlike(_ASSIGN_RE)

    return let(_no_strings(s), blanked)


def _is_docstring(s: Column) -> Column:
    """Stripped line ``s`` begins a statement that is nothing but a non-empty string."""
    rest = F.regexp_replace(_no_strings(s), r"^[rRuU]|\s+$", "")
    return s.rlike(r"^[rRuU]?[\"']") & rest.isin("", '"""', "'''") & ~s.rlike(_EMPTY_STRING_RE)


def _after(line: Column, delim: str) -> Column:
    pos = F.instr(line, delim)
    return F.when(pos > 0, _code_feats(F.substring(line, pos + 3, 1 << 30)))


def python_features(lines: Column) -> Column:
    def feat(line):
        return let(py_strip(line), lambda s: _feat(line, s))

    def _feat(line, s):
        # import/assignment only matter at module level, i.e. on unindented lines
        top = ~F.substring(line, 1, 1).rlike(f"^{WS_CLASS}")
        kind = (
            F.when(s.startswith("class") & s.rlike(r"^class\b"), F.lit(K_CLASS))
            .when((s.startswith("def") | s.startswith("async")) & s.rlike(r"^(async\s+)?def\b"), F.lit(K_DEF))
            .when(s.startswith("@"), F.lit(K_DECO))
            .when(top & s.rlike(r"^(import|from)\b"), F.lit(K_IMPORT))
            .when(top & (s.contains("=") | s.contains(":")) & _is_assignment(s), F.lit(K_ASSIGN))
            .otherwise(F.lit(K_OTHER))
        )
        return F.struct(
            ((s == "") | s.startswith("#")).alias("blank"),
            indent_width(line).cast("int").alias("ind"),
            kind.alias("kind"),
            (s.rlike(r"^[rRuU]?[\"']") & _is_docstring(s)).alias("isstr"),
            _code_feats(line).alias("n0"),
            _after(line, '"""').alias("nd"),
            _after(line, "'''").alias("ns"),
        )

    return F.transform(lines, feat)


def _seg(s: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))


def python_fold(feats: Column) -> Column:
    init = [
        F.lit("").alias("q"),
        F.lit(0).alias("depth"),
        F.lit(False).alias("cont"),
        F.lit(0).alias("i"),
        F.lit(0).alias("nstmt"),
        F.lit(False).alias("moddoc"),
        empty(STACK_TYPE).alias("stack"),
        F.lit(P_NONE).alias("pend"),
        F.lit(0).alias("pind"),
        F.lit(0).alias("pstart"),
        empty("array<int>").alias("decos"),
        F.lit(-1).alias("keep_from"),
        F.lit(0).alias("classes"),
        F.lit(0).alias("methods"),
        F.lit(False).alias("bad"),
    ]

    def step(a, f):
        # quote/bracket state after this line, and whether it starts a statement
        g = F.when(a["q"] == "", f["n0"]).when(a["q"] == '"""', f["nd"]).otherwise(f["ns"])
        whole = (a["q"] != "") & g.isNull()
        start = (a["q"] == "") & (a["depth"] == 0) & ~a["cont"] & ~f["blank"]
        d = F.struct(
            F.when(whole, a["q"]).otherwise(g["q"]).alias("q2"),
            F.when(whole, a["depth"]).otherwise(a["depth"] + g["net"]).alias("depth2"),
            F.when(whole, F.lit(False)).otherwise(g["cont"]).alias("cont2"),
            start.alias("start"),
            F.when(start, F.filter(a["stack"], lambda e: e["ind"] < f["ind"])).otherwise(a["stack"]).alias("sp"),
        )
        return let(d, lambda d: _decide(a, f, d))

    def _decide(a, f, d):
        # every derived flag is evaluated once per line (lambdas have no CSE)
        start, sp, kind = d["start"], d["sp"], f["kind"]
        deeper = f["ind"] > a["pind"]
        e = F.struct(
            (start & F.forall(sp, lambda x: x["blk"])).alias("reach"),
            ((d["q2"] == "") & (d["depth2"] == 0) & ~d["cont2"]).alias("end"),
            (start & (a["pend"] == P_DEF) & deeper & (kind != K_DECO)).alias("resolve_def"),
            (start & (a["pend"] != P_NONE) & deeper & f["isstr"]).alias("is_doc"),
            (start & (F.size(sp) == 0) & ((kind == K_IMPORT) | (kind == K_ASSIGN))).alias("top_keep"),
            (start & (a["pend"] == P_DEF) & (kind == K_DECO) & deeper).alias("pend_keep"),
        )
        return let(e, lambda e: _advance(a, f, d, e))

    def _advance(a, f, d, e):
        i, kind, ind = a["i"], f["kind"], f["ind"]
        start, end, resolve_def = d["start"], e["end"], e["resolve_def"]
        is_cd = e["reach"] & ((kind == K_CLASS) | (kind == K_DEF))
        is_cls = e["reach"] & (kind == K_CLASS)
        is_def = e["reach"] & (kind == K_DEF)
        keep_from = F.when(e["is_doc"] | e["top_keep"], i).otherwise(a["keep_from"])

        header = resolve_def & (a["pstart"] <= i - 1)
        kept = end & (keep_from >= 0)
        segs = F.concat(
            F.when(header, F.array(_seg(a["pstart"], i - 1))).otherwise(empty(SEG_TYPE)),
            # decorators already inside a just-resolved header range are not repeated
            F.when(is_cd & ~resolve_def, F.transform(a["decos"], lambda x: _seg(x, x))).otherwise(empty(SEG_TYPE)),
            F.when(is_cls, F.array(_seg(i, i))).otherwise(empty(SEG_TYPE)),
            F.when(kept, F.array(_seg(keep_from, i))).otherwise(empty(SEG_TYPE)),
        )

        pend = (
            F.when(~start, a["pend"])
            .when(is_cls, F.lit(P_CLASS))
            .when(is_def, F.lit(P_DEF))
            .when(e["pend_keep"], a["pend"])
            .otherwise(F.lit(P_NONE))
        )
        decos = (
            F.when(~start, a["decos"])
            .when(e["reach"] & (kind == K_DECO), F.concat(a["decos"], F.array(i)))
            .otherwise(empty("array<int>"))
        )
        stack = F.when(
            start,
            F.concat(d["sp"], F.array(F.struct(ind.alias("ind"), ((kind == K_CLASS) | (kind == K_DEF)).alias("blk")))),
        ).otherwise(a["stack"])

        return F.struct(
            d["q2"].alias("q"),
            d["depth2"].alias("depth"),
            d["cont2"].alias("cont"),
            (i + 1).alias("i"),
            (a["nstmt"] + F.when(start, 1).otherwise(0)).alias("nstmt"),
            (a["moddoc"] | (start & (a["nstmt"] == 0) & f["isstr"])).alias("moddoc"),
            stack.alias("stack"),
            pend.alias("pend"),
            F.when(is_cd, ind).otherwise(a["pind"]).alias("pind"),
            F.when(is_def, i).otherwise(a["pstart"]).alias("pstart"),
            decos.alias("decos"),
            F.when(end, F.lit(-1)).otherwise(keep_from).alias("keep_from"),
            (a["classes"] + F.when(is_cls, 1).otherwise(0)).alias("classes"),
            (a["methods"] + F.when(is_def, 1).otherwise(0)).alias("methods"),
            (a["bad"] | (d["depth2"] < 0)).alias("bad"),
            segs.alias("items"),
            (header | is_cd | kept).alias("emit"),
        )

    def finish(a, segs):
        return F.struct(
            segs.alias("segs"),
            a["moddoc"].alias("moddoc"),
            a["classes"].alias("classes"),
            a["methods"].alias("methods"),
            (a["bad"] | (a["q"] != "") | (a["depth"] != 0) | a["cont"]).alias("malformed"),
        )

    return fold_growing(feats, init, SEG_TYPE, step, finish)


def kept_segments(segs: Column, moddoc: Column, n: Column) -> Column:
    """Sorted disjoint kept segments; the module-docstring prefix is merged in."""
    head_end = F.least(F.lit(MODULE_DOC_LINES - 1), n - 1)
    clipped = F.filter(
        F.transform(segs, lambda r: _seg(F.greatest(r["s"], head_end + 1), r["e"])), lambda r: r["s"] <= r["e"]
    )
    return F.when(moddoc & (n > 0), F.concat(F.array(_seg(F.lit(0), head_end)), clipped)).otherwise(segs)


def collapse_gaps(lines: Column, segs: Column) -> Column:
    """K5: keep segment lines; each run of dropped lines becomes one marker line."""
    n = F.size(lines)
    k = F.size(segs)

    def marker(gs, ge):
        prev = F.when(gs > 0, F.get(lines, gs - 1)).otherwise(F.lit(""))
        width = F.length(prev) - F.length(F.regexp_replace(prev, f"^{WS_CLASS}+", ""))
        return F.when(
            ge >= gs,
            F.array(
                F.concat(
                    F.repeat(F.lit(" "), width + 4),
                    F.lit(GAP_MARKER[0]),
                    (ge - gs + 1).cast("string"),
                    F.lit(GAP_MARKER[1]),
                )
            ),
        ).otherwise(empty("array<string>"))

    def piece(j):
        prev_e = F.when(j == 0, F.lit(-1)).otherwise(F.get(segs, j - 1)["e"])
        cur = F.get(segs, j)
        return F.when(j == k, marker(prev_e + 1, n - 1)).otherwise(
            F.concat(marker(prev_e + 1, cur["s"] - 1), F.slice(lines, cur["s"] + 1, cur["e"] - cur["s"] + 1))
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), k), piece))


def shared_python_features(lines_name: str) -> Column:
    """``python_features`` over the named lines column, built once per application."""
    return memo_column(f"py_features:{lines_name}", lambda: python_features(F.col(lines_name)))


def skeleton_python(lines: Column, feats: Column | None = None) -> Column:
    """struct(skeleton, method_count, class_count, malformed, segs) for Python files."""

    def build(fold, segs):
        return F.struct(
            F.array_join(collapse_gaps(lines, segs), "\n").alias("skeleton"),
            fold["methods"].alias("method_count"),
            fold["classes"].alias("class_count"),
            fold["malformed"].alias("malformed"),
            segs.alias("segs"),
        )

    return let(
        python_fold(python_features(lines) if feats is None else feats),
        lambda fold: let(kept_segments(fold["segs"], fold["moddoc"], F.size(lines)), lambda segs: build(fold, segs)),
    )


def segments_from_flags(keep: Column) -> Column:
    """Kept runs of a boolean array as sorted ``(s, e)`` segments (0-based, inclusive)."""
    n = F.size(keep)
    idx = F.sequence(F.lit(0), n - 1)
    starts = F.filter(idx, lambda i: F.get(keep, i) & ((i == 0) | ~F.coalesce(F.get(keep, i - 1), F.lit(False))))
    ends = F.filter(idx, lambda i: F.get(keep, i) & ~F.coalesce(F.get(keep, i + 1), F.lit(False)))
    return F.when(n == 0, empty(SEG_TYPE)).otherwise(
        F.transform(starts, lambda s, k: _seg(s, F.get(ends, k)))
    )


def collapse_dropped(lines: Column, keep: Column) -> Column:
    """K5 for any keep predicate: kept lines verbatim, each dropped run one marker."""
    # bound once: the segments look at the flags line by line
    segs = let(keep, segments_from_flags)
    return let(segs, lambda segs: F.array_join(collapse_gaps(lines, segs), "\n"))
