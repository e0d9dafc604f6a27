"""Array-column building blocks shared by the row-local skeletonizers.

A file is one row; its lines are an ``array<string>``.  The folds below emit
only *ranges* (a handful per file) and the per-line view is rebuilt from them in
linear time with ``array_repeat``/``flatten`` -- appending to an array inside
``aggregate`` copies it, so what a fold emits grows in parts (``grow``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE_TYPE = "array<struct<o:int,c:int>>"

OUTSIDE = -1  # line is not inside a compressed body
INSIDE = -2  # line is inside a body (and is not its closing line)


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a lambda variable.

    Referencing a column expression several times inside a lambda would
    re-evaluate it on every access; a one-element ``transform`` binds it once.
    """
    return F.get(F.transform(F.array(value), fn), 0)


_EXPR_CACHE: dict[tuple, Column] = {}


def _session_key() -> str:
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    return sc.applicationId if sc is not None else ""


def memo_column(name: str, build) -> Column:
    """Build a large column expression once per Spark application and reuse it.

    The skeletonizer expressions have thousands of nodes; building them costs
    thousands of py4j calls, so they are constructed once and then only
    re-analysed against each new plan.  ``name`` must identify the expression
    including the input column names it reads.
    """
    key = (name, _session_key())
    col = _EXPR_CACHE.get(key)
    if col is None:
        col = build()
        _EXPR_CACHE[key] = col
    return col


def empty(type_str: str) -> Column:
    return F.array().cast(type_str)


#: Elements after which a growing array's open part is closed.
GROW = 512


def growing(type_str: str) -> list[Column]:
    """Fields ``full, part`` of a fold's state that stand for an empty growing array of ``type_str``."""
    return [empty(f"array<{type_str}>").alias("full"), empty(type_str).alias("part")]


def grow(acc: Column, items: Column, when: Column) -> list[Column]:
    """The fields after appending ``items`` where ``when`` holds.

    Appending copies an array, so a fold that appends to one array is quadratic in
    its length.  Here only the open part of :data:`GROW` elements is copied, and the
    list of closed parts once per part.
    """
    closes = F.size(acc["part"]) >= GROW
    return [
        F.when(when & closes, F.concat(acc["full"], F.array(acc["part"]))).otherwise(acc["full"]).alias("full"),
        F.when(when & closes, items).when(when, F.concat(acc["part"], items)).otherwise(acc["part"]).alias("part"),
    ]


def grown(acc: Column) -> Column:
    """The whole array."""
    return F.flatten(F.concat(acc["full"], F.array(acc["part"])))


def fold_growing(arr: Column, state: list[Column], type_str: str, step, finish) -> Column:
    """``aggregate`` over ``arr`` with a small state ``s`` and one growing array of ``type_str``.

    ``step(s, x)`` gives the next state's fields, among them ``items`` and ``emit``:
    what is appended after this element, and whether.  ``let`` copies what it binds, so
    only the small state may pass through one; the array is appended to one step later,
    beside it.  ``finish(s, array)`` makes the result.
    """
    first = F.struct(*state, empty(type_str).alias("items"), F.lit(False).alias("emit"))
    init = F.struct(first.alias("s"), *growing(type_str))

    def advance(a, x):
        s = a["s"]
        return F.struct(step(s, x).alias("s"), *grow(a, s["items"], s["emit"]))

    def result(a):
        s = a["s"]
        whole = F.concat(grown(a), F.when(s["emit"], s["items"]).otherwise(empty(type_str)))
        return finish(s, whole)

    return F.aggregate(arr, init, advance, result)


def repeat_int(value: int, count) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(F.lit(0), count).cast("int"))


def line_states(ranges: Column, n: Column) -> Column:
    """Per-line state array of length ``n`` from sorted disjoint body ranges.

    ``ranges`` holds ``(o, c)``: opener line ``o`` and closing line ``c``
    (0-based; ``c`` null when the body never closes).  The result has OUTSIDE
    for lines up to and including an opener, INSIDE for lines strictly inside a
    body, and the opener index ``o`` on the closing line ``c``.
    """
    k = F.size(ranges)

    def piece(j):
        prev = F.get(ranges, j - 1)
        prev_end = F.when(j == 0, F.lit(-1)).otherwise(F.coalesce(prev["c"], n - 1))
        cur = F.get(ranges, j)
        body = F.concat(
            repeat_int(OUTSIDE, cur["o"] - prev_end),
            repeat_int(INSIDE, F.coalesce(cur["c"], n) - cur["o"] - 1),
            F.when(cur["c"].isNull(), empty("array<int>")).otherwise(F.array(cur["o"])),
        )
        return F.when(j == k, repeat_int(OUTSIDE, n - 1 - prev_end)).otherwise(body)

    return F.flatten(F.transform(F.sequence(F.lit(0), k), piece))


def count_true(arr: Column, pred) -> Column:
    return F.size(F.filter(arr, pred))
