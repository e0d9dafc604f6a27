"""Column helpers that reproduce Python string semantics with built-in functions.

Everything here returns a ``Column`` and stays inside the JVM (no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# --- fixed values ---------------------------------------------------------
# Characters Python's str.splitlines() breaks on ("\r\n" counts as one break).
LINE_BREAK_RE = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
# Those of them that are no line feed.
OTHER_BREAK_RE = "[\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
# Characters Python's str.strip() removes (str.isspace()).
WS_CLASS = (
    "[\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
    "\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
# The same set as a plain string, for trim(str, chars).
WS_CHARS = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# Characters per token of both token estimators.
CHARS_PER_TOKEN = 3.8
# --------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def decode_utf8_ignore(binary) -> Column:
    """bytes.decode('utf-8', errors='ignore'): invalid sequences are dropped."""
    return F.replace(F.make_valid_utf8(_c(binary).cast("string")), F.lit("\ufffd"), F.lit(""))


def normalize_newlines(text) -> Column:
    """Text-mode reading: CRLF and lone CR become LF."""
    return F.regexp_replace(_c(text), "\r\n?", "\n")


def split_lines(text) -> Column:
    """str.splitlines(): no trailing empty element, empty string -> []."""
    t = _c(text)
    # text without other breaks is split at its line feeds alone; it is split once
    parts = F.when(t.rlike(OTHER_BREAK_RE), F.split(t, LINE_BREAK_RE, -1)).otherwise(F.split(t, "\n", -1))
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def split_lf_lines(text) -> Column:
    """Iterating a text file object: lines end at LF only; no trailing empty line."""
    parts = F.split(_c(text), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def py_strip(text) -> Column:
    """str.strip(): trims the str.isspace() characters at both ends."""
    return F.trim(_c(text), F.lit(WS_CHARS))


def py_lstrip(text) -> Column:
    return F.ltrim(_c(text), F.lit(WS_CHARS))


def indent_width(line) -> Column:
    """len(line) - len(line.lstrip())."""
    return F.length(_c(line)) - F.length(py_lstrip(line))


def leading_ws(line) -> Column:
    """line[:len(line) - len(line.lstrip())]."""
    return F.substring(_c(line), 1, indent_width(line))


def tokens_floor(n_chars) -> Column:
    """max(1, int(chars / 3.8)) -- the skeletonizer's estimator."""
    return F.greatest(F.lit(1), F.floor(_c(n_chars) / F.lit(CHARS_PER_TOKEN)).cast("int"))


def tokens_of_chars(n_chars) -> Column:
    """max(1, ceil(chars / 3.8)) for a text that is not empty."""
    return F.greatest(F.lit(1), F.ceil(_c(n_chars) / F.lit(CHARS_PER_TOKEN)).cast("int"))


def tokens_ceil(text) -> Column:
    """0 for empty text else max(1, ceil(len / 3.8)) -- the prompt estimator."""
    t = _c(text)
    return (
        F.when(t.isNull() | (t == ""), F.lit(0))
        .otherwise(tokens_of_chars(F.length(t)))
        .cast("int")
    )


def round1(x) -> Column:
    """round(x, 1) as floor(x*10 + 0.5)/10 (same expression in the DuckDB oracle)."""
    return F.floor(_c(x) * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)


def reduction_pct(raw_tokens, skel_tokens) -> Column:
    """max(0.0, round((1 - skel/raw) * 100, 1)); raw is always >= 1 here."""
    r = _c(raw_tokens).cast("double")
    s = _c(skel_tokens).cast("double")
    return F.greatest(F.lit(0.0), round1((F.lit(1.0) - s / r) * F.lit(100.0)))


def saved_pct(saved, raw) -> Column:
    """round(saved/raw*100, 1), 0.0 when raw == 0."""
    return F.when(_c(raw) > 0, round1(_c(saved).cast("double") / _c(raw).cast("double") * F.lit(100.0))).otherwise(
        F.lit(0.0)
    )


def ratio_string(raw, consumed) -> Column:
    """f"{round(raw / max(1, consumed), 1)}x"."""
    r = round1(_c(raw).cast("double") / F.greatest(F.lit(1), _c(consumed)).cast("double"))
    return F.concat(r.cast("string"), F.lit("x"))


def regex_quote(text) -> Column:
    """re.escape for use inside a Java pattern: wrap in \\Q..\\E (\\E inside is split)."""
    return F.concat(F.lit("\\Q"), F.replace(_c(text), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
