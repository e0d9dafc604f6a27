"""Skeletons (K0-K4, K8) and method ranges (J1, X1-X4) of one file's text, in plain Python.

The rules are those of the column expressions in ``brace``, ``python`` and ``lookup``;
here a text is walked once, line by line, where an interpreted fold over an array costs
some microseconds for every line.  The Arrow functions at the end take one file a row,
so memory is bounded by a batch.  Nothing here knows Spark.

The patterns are Java's: ``\\s`` and, with ``(?U)``, ``\\w`` and ``\\b`` differ from Python's
for some characters (combining marks, fractions, joiners).  A text that holds one of them
is read with the same patterns over Java's classes spelled out (:func:`_rules`).
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .brace import (
    BODY_MARKER, C_CLASS_CONTAINS, C_KEEP_CONTAINS, C_KEEP_PREFIXES, JS_DECL_PREFIXES, JS_KEEP_PREFIXES, JS_SIG_RE,
)
from .python import GAP_MARKER, MODULE_DOC_LINES, _ASSIGN_RE, _EMPTY_STRING_RE, _TOKEN_RE

# --- fixed values ---------------------------------------------------------
# Generic skeleton: files up to this many lines are returned unchanged; longer
# ones keep the first 15 and last 10 lines around one marker.
GENERIC_MAX_LINES = 30
GENERIC_HEAD = 15
GENERIC_TAIL = 10
GENERIC_MARKER = ("# ... [Compressed ", " lines] ...")
# Words allowed before the method name in the start pattern.
START_KEYWORDS = ("def", "function", "async", "public", "private", "protected", "static")
# At most this many further lines follow the start line.
BODY_MAX_LINES = 150
# --------------------------------------------------------------------------

#: Java's white space within a line, without and with ``(?U)``, as bodies of a class.
_SPACE, _SPACE_U = r"\t ", r"\t \xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: Java's word characters beyond ASCII that are no letters, digits, marks or connectors.
_WORD_EXTRA = {0x200C, 0x200D, *range(0x24B6, 0x24EA), *range(0x1F130, 0x1F14A), *range(0x1F150, 0x1F16A), *range(0x1F170, 0x1F18A)}
_SURROGATES = "surrogateescape"  # bytes that are no UTF-8 stay as they are


def _is_word(c: int) -> bool:
    kind = unicodedata.category(chr(c))
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in _WORD_EXTRA


def _ranges(held) -> str:
    """The characters for which ``held`` is true, as a regex class."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        now = c <= sys.maxunicode and held(c)
        if now and first is None:
            first = c
        elif not now and first is not None:
            out.append(f"\\U{first:08x}" + (f"-\\U{c - 1:08x}" if c - 1 > first else ""))
            first = None
    return "[" + "".join(out) + "]"


@lru_cache(1)
def _odd():
    """Finds a character that Java and Python class differently."""
    return re.compile(_ranges(lambda c: c > 127 and (_is_word(c) != chr(c).isalnum() or unicodedata.category(chr(c)) == "Nl"))).search


def _java(pattern: str, space: str, word: str | None = None, edge: str = "") -> str:
    p = pattern.replace("(?U)", "").replace(r"[^\s=]", f"[^{space}=]").replace(r"\s", f"[{space}]")
    if word:
        p = p.replace(r"[^\W\d]", rf"(?!\d){word}").replace(r"[\w.]", rf"(?:{word}|\.)").replace(r"\w", word).replace(r"\b", edge)
    return p


@lru_cache(2)
def _rules(odd: bool) -> SimpleNamespace:
    word = _ranges(_is_word) if odd else r"\w"
    edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))" if odd else r"\b"
    # \b without (?U): letters, digits, the underscore, and marks on them
    plain = _ranges(lambda c: c == 95 or unicodedata.category(chr(c))[0] == "L" or unicodedata.category(chr(c)) in ("Nd", "Mn")) if odd else word
    u = lambda p: re.compile(_java(p, _SPACE_U, word if odd else None, edge))
    n = lambda p: re.compile(_java(p, _SPACE).replace(r"\b", f"(?!{plain})"))
    sig_head, sig_call = JS_SIG_RE.split("|^")
    keywords = "(?:" + "|".join(START_KEYWORDS) + ")"
    return SimpleNamespace(
        odd=odd,
        sig_head=u(sig_head).match, sig_call=u(sig_call).match,
        token=re.compile(_TOKEN_RE),
        assign=u(_ASSIGN_RE).search,
        empty_string=n(_EMPTY_STRING_RE).search,
        klass=n(r"class\b").match, defn=n(r"(?:async\s+)?def\b").match, imported=n(r"(?:import|from)\b").match,
        def_name=re.compile(rf"(?:async[{_SPACE}]+)?def[{_SPACE}]+({word}+)[{_SPACE}]*\(").match,
        # of a reversed text: only a "(" is looked behind, not every word for one
        call=re.compile(rf"\([{_SPACE_U}]*+({word}++)").finditer,
        # a name that a (?U) \w+ matches whole, a line end behind it
        name=re.compile(rf"\A{word}+(?:\r\n|[\n\r\x85\u2028\u2029])?\Z").match,
        starts_word=re.compile(word).match,
        keywords=re.compile(f"{keywords}+").fullmatch,
        lead=f"{edge}{keywords}*", lead_loose=f"{edge}(?:{keywords}|[{_SPACE_U}])*",
    )


def rules_of(*texts: str) -> SimpleNamespace:
    return _rules(any(not t.isascii() and _odd()(t) is not None for t in texts))


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


# ------------------------------------------------------------------ skeletons


def _generic(text: str, lines: list[str]) -> tuple[str, int, int]:
    n = len(lines)
    if n <= GENERIC_MAX_LINES:
        return text, 0, 0
    marker = f"{GENERIC_MARKER[0]}{n - GENERIC_HEAD - GENERIC_TAIL}{GENERIC_MARKER[1]}"
    return "\n".join([*lines[:GENERIC_HEAD], marker, *lines[-GENERIC_TAIL:]]), 0, 0


def _marker(lines: list[str], opener: int, close: int, extra: str) -> str:
    line = lines[opener]
    return f"{line[:_indent(line)]}{extra}{BODY_MARKER[0]}{close - opener}{BODY_MARKER[1]}"


_JS_KEEP_FIRST = "".join({p[0] for p in JS_KEEP_PREFIXES})
_JS_SIG_FIRST = "edafcit"  # of export, default, async, function, class, interface, type, enum, const
_JS_DECL_FIRST = "".join({p[0] for p in JS_DECL_PREFIXES})
_C_KEEP_FIRST = "".join({p[0] for p in C_KEEP_PREFIXES})


def _js_ts(text: str, lines: list[str], r: SimpleNamespace) -> tuple[str, int, int]:
    out, methods, classes = [], 0, 0
    in_body, depth, start = False, 0, 0
    for i, line in enumerate(lines):
        s = line.strip()
        first = s[:1]
        opens = "{" in line
        sig = (first in _JS_SIG_FIRST and r.sig_head(line)) or (opens and "(" in line and r.sig_call(line))
        if " class " in s or (first == "c" and s.startswith("class ")):
            classes += 1
        if sig or (first in _JS_KEEP_FIRST and s.startswith(JS_KEEP_PREFIXES)):
            out.append(line)
            fn_like = "function" in s or "=>" in s or "(" in s
            if sig and fn_like:
                methods += 1
            if opens and fn_like and not in_body:
                net = line.count("{") - line.count("}")
                if net > 0:
                    in_body, depth, start = True, net, i
        elif in_body:
            if opens or "}" in line:
                depth += line.count("{") - line.count("}")
                if depth <= 0:
                    in_body = False
                    out += (_marker(lines, start, i, "  "), line)
        elif first in _JS_DECL_FIRST and s.startswith(JS_DECL_PREFIXES):
            name, eq, _ = line.partition("=")
            out.append(f"{name}= ...;" if eq else line)
    return "\n".join(out), methods, classes


def _c_like(text: str, lines: list[str], r: SimpleNamespace) -> tuple[str, int, int]:
    out, methods, classes = [], 0, 0
    in_body, depth, start = False, 0, 0
    stripped = [ln.strip() for ln in lines]
    after = [*stripped[1:], ""]
    for i, line in enumerate(lines):
        s = stripped[i]
        opens = "{" in line
        is_class = False
        for word in C_CLASS_CONTAINS:
            if word in s:
                is_class = True
                classes += 1
                break
        # what makes a class line keeps it, but for "struct "
        if (s[:1] in _C_KEEP_FIRST and s.startswith(C_KEEP_PREFIXES)) or (is_class and any(w in s for w in C_KEEP_CONTAINS)):
            out.append(line)
        elif "(" in line and ")" in line and (s.endswith("{") or after[i].startswith("{")):
            out.append(line)
            methods += 1
            if opens:
                depth = line.count("{") - line.count("}")
                if depth > 0 and not in_body:
                    in_body, start = True, i
        elif in_body:
            if opens or "}" in line:
                depth += line.count("{") - line.count("}")
            if depth <= 0:
                in_body = False
                out += (_marker(lines, start, i, "    "), line)
        elif s == "}" or s == "};":
            out.append(line)
    return "\n".join(out), methods, classes


_special = re.compile(r"""[\[\](){}"'#]|\\\Z""").search


def _no_strings(s: str, r: SimpleNamespace) -> str:
    return r.token.sub(r"\1", s) if '"' in s or "'" in s or "#" in s else s


def _code(c: str, r: SimpleNamespace) -> tuple[str, int, bool]:
    """Exit delimiter, bracket net and continuation of code text."""
    c = _no_strings(c, r)
    net = c.count("(") + c.count("[") + c.count("{") - c.count(")") - c.count("]") - c.count("}")
    if c.endswith('"""'):
        return '"""', net, False
    if c.endswith("'''"):
        return "'''", net, False
    return "", net, c.endswith("\\")


def _after_line(q: str, depth: int, line: str, r: SimpleNamespace) -> tuple[str, int, bool]:
    """Open quote, bracket depth and continuation after a line that begins with those."""
    if q:
        at = line.find(q)
        if at < 0:
            return q, depth, False
        line = line[at + 3:]
    q, net, cont = _code(line, r)
    return q, depth + net, cont


_innermost = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]").subn
_unclosed = re.compile(r"[(\[{].*$").sub
_ends = re.compile(rf"^[rRuU]|[{_SPACE}]+$").sub
_quoted = re.compile(r"[rRuU]?[\"']").match


def _is_assignment(s: str, r: SimpleNamespace) -> bool:
    c = _no_strings(s, r)
    for _ in range(c.count("(") + c.count("[") + c.count("{")):
        c, n = _innermost("_", c)
        if not n:
            break
    return r.assign(_unclosed("_", c)) is not None


def _is_docstring(s: str, r: SimpleNamespace) -> bool:
    return (
        _quoted(s) is not None
        and _ends("", _no_strings(s, r)) in ("", '"""', "'''")
        and r.empty_string(s) is None
    )


_OTHER, _CLASS, _DEF, _DECO, _KEEP = range(5)


def _kind(line: str, s: str, r: SimpleNamespace) -> int:
    first = s[:1]
    if first == "c" and r.klass(s):
        return _CLASS
    if first in "da" and r.defn(s):
        return _DEF
    if first == "@":
        return _DECO
    # import/assignment only matter at module level, i.e. on unindented lines
    if not line[:1].isspace() and (r.imported(s) or (("=" in s or ":" in s) and _is_assignment(s, r))):
        return _KEEP
    return _OTHER


def _python(text: str, lines: list[str], r: SimpleNamespace) -> tuple[str, int, int]:
    q, depth, cont = "", 0, False
    statements, moddoc = 0, False
    stack: list[tuple[int, bool]] = []
    others = 0  # statements on the stack that are neither class nor def
    pend, pind, pstart, decos, keep_from = _OTHER, 0, 0, [], -1
    classes = methods = 0
    segs: list[tuple[int, int]] = []
    for i, line in enumerate(lines):
        start = False
        if not q and depth == 0 and not cont:
            s = line.strip()
            start = s != "" and s[0] != "#"
        if q or _special(line):
            q, depth, cont = _after_line(q, depth, line, r)
            if depth < 0:  # it stays unparsable
                return _generic(text, lines)
            end = not q and depth == 0 and not cont
        else:
            cont, end = False, depth == 0
        resolve_def = False
        is_cls = is_def = False
        if start:
            ind = len(line) - len(line.lstrip())
            while stack and stack[-1][0] >= ind:
                others -= not stack.pop()[1]
            kind = _kind(line, s, r)
            reach = others == 0
            deeper = ind > pind
            resolve_def = pend == _DEF and deeper and kind != _DECO
            if statements == 0 or (pend != _OTHER and deeper):
                if s[0] in "rRuU\"'" and _is_docstring(s, r):
                    moddoc = moddoc or statements == 0
                    if pend != _OTHER and deeper:
                        keep_from = i
            if kind == _KEEP and not stack:
                keep_from = i
            is_cls, is_def = reach and kind == _CLASS, reach and kind == _DEF
        if resolve_def and pstart <= i - 1:
            segs.append((pstart, i - 1))
        if is_cls or is_def:
            if not resolve_def:
                # decorators already inside a just-resolved header range are not repeated
                segs += [(x, x) for x in decos]
            if is_cls:
                segs.append((i, i))
        if end:
            if keep_from >= 0:
                segs.append((keep_from, i))
            keep_from = -1
        if start:
            if is_cls or is_def:
                pend, pind = kind, ind
            elif not (pend == _DEF and kind == _DECO and deeper):
                pend = _OTHER
            if is_def:
                pstart = i
            decos = [*decos, i] if reach and kind == _DECO else []
            blk = kind == _CLASS or kind == _DEF
            others += not blk
            stack.append((ind, blk))
            statements += 1
            classes += is_cls
            methods += is_def
    if q or depth != 0 or cont:
        return _generic(text, lines)
    n = len(lines)
    if moddoc and n:
        head = min(MODULE_DOC_LINES - 1, n - 1)
        segs = [(0, head), *[(max(s, head + 1), e) for s, e in segs if e > head]]
    out: list[str] = []

    def gap(first: int, last: int) -> None:
        if last >= first:
            width = _indent(lines[first - 1]) if first > 0 else 0
            out.append(f"{' ' * (width + 4)}{GAP_MARKER[0]}{last - first + 1}{GAP_MARKER[1]}")

    prev = -1
    for s, e in segs:
        gap(prev + 1, s - 1)
        out += lines[s:e + 1]
        prev = e
    gap(prev + 1, n - 1)
    return "\n".join(out), methods, classes


_SKELETONS = {"python": _python, "js_ts": _js_ts, "c_like": _c_like}


def skeleton_of(text: str, language: str) -> tuple[str, int, int]:
    """``(skeleton, method_count, class_count)`` of a text."""
    lines = text.splitlines()
    make = _SKELETONS.get(language)
    return make(text, lines, rules_of(text)) if make else _generic(text, lines)


# ------------------------------------------------------------------ method ranges


class Text:
    """One file's lines and, by name, the lines of the body that a lookup finds."""

    def __init__(self, text: str, is_py: bool):
        self.lines = text.splitlines()
        self.joined = "\n".join(self.lines)
        # the places where lines start, and one behind the last
        self.starts = [0, *accumulate([len(ln) + 1 for ln in self.lines])]
        self.is_py = is_py
        self.rules = rules_of(text)
        self.stmt_ind: list[int] | None = None
        self.defs = self._defs() if is_py else {}
        self._calls: dict[str, int] | None = None
        self._closers: list[int] | None = None

    # -- parts of the index

    def _statements(self) -> list[int] | None:
        """Per line the indent of a statement's first line, -1 for blank and comment lines, -2 for a
        statement's further lines; null if brackets and quotes do not balance (K8's test)."""
        r, out = self.rules, []
        q, depth, cont, within = "", 0, False, False
        for line in self.lines:
            if within:
                out.append(-2)
            else:
                bare = line.lstrip()
                out.append(len(line) - len(bare) if bare and bare[0] != "#" else -1)
            if q or _special(line):
                q, depth, cont = _after_line(q, depth, line, r)
                if depth < 0:
                    return None
                within = q != "" or depth > 0 or cont
            else:
                cont, within = False, depth > 0
        return None if within else out

    def _defs(self) -> dict[str, tuple[int, int, int]]:
        """Name of a ``def`` to the depth, first and last line of the first in breadth-first order."""
        found: dict[str, tuple[int, int, int]] = {}
        self.stmt_ind = self._statements()
        if self.stmt_ind is None:
            return found
        stack: list[tuple[int, str | None, int, int]] = []
        last = -1

        def close(_, name, depth, i):
            if name is not None:
                entry = (depth, i, last)
                if name not in found or entry < found[name]:
                    found[name] = entry

        for i, ind in enumerate(self.stmt_ind):
            if ind == -1:
                continue
            if ind >= 0:
                while stack and stack[-1][0] >= ind:
                    close(*stack.pop())
                line, name = self.lines[i], None
                if "def" in line:
                    m = self.rules.def_name(line.strip())
                    name = m[1] if m else None
                stack.append((ind, name, len(stack) + 1, i))
            last = i
        while stack:
            close(*stack.pop())
        return found

    def calls(self) -> dict[str, int]:
        """Name before ``(`` to the place right behind where it stands first; also what is left of
        one when keywords glued to its front are taken off."""
        if self._calls is None:
            n = len(self.joined)
            # from the end to the start, so the first place stays
            first = {m[1][::-1]: n - m.start(1) for m in self.rules.call(self.joined[::-1])}
            for word, at in [x for x in first.items() if x[0].startswith(START_KEYWORDS)]:
                for k in range(1, len(word)):
                    if self.rules.keywords(word, 0, k) and at < first.get(word[k:], at + 1):
                        first[word[k:]] = at
            self._calls = first
        return self._calls

    def _block_end(self, s: int) -> int:
        """Last line of the fallback's block from line ``s`` on."""
        lines = self.lines
        last = min(s + BODY_MAX_LINES - 1, len(lines) - 1)
        if self.is_py:
            own = _indent(lines[s])
            for j in range(s + 1, last + 1):
                bare = lines[j].lstrip()
                if bare and bare[0] != "#" and len(lines[j]) - len(bare) <= own:
                    return j
            return last
        if self._closers is None:
            self._closers = [j for j, ln in enumerate(lines) if "}" in ln]
            self._nets = [0, *accumulate([ln.count("{") - ln.count("}") for ln in lines])]
        k = bisect_right(self._closers, s)
        while k < len(self._closers) and self._closers[k] <= last:
            j = self._closers[k]
            if self._nets[j + 1] <= self._nets[s]:
                return j
            k += 1
        return last

    # -- lookups

    def find(self, name: str) -> tuple[int, int] | None:
        """First and last line of the body of a plain name."""
        if name in self.defs:
            return self.defs[name][1:]
        at = self.calls().get(name)
        if at is None:
            return None
        s = bisect_right(self.starts, at) - 1
        return s, self._block_end(s)

    def scan(self, name: str) -> tuple[int, int] | None:
        """The same for any name, by looking through the lines."""
        r = self.rules if self.rules.odd else rules_of(name)
        quoted = re.escape(name)
        if self.stmt_ind is not None:
            head = re.compile(rf"(?:async[{_SPACE}]+)?def[{_SPACE}]+{quoted}[{_SPACE}]*\(").match
            best, stack = None, []
            for i, ind in enumerate(self.stmt_ind):
                if ind >= 0:
                    while stack and stack[-1] >= ind:
                        stack.pop()
                    if name in self.lines[i] and head(self.lines[i].strip()) and (best is None or len(stack) < best[0]):
                        best = len(stack), i, ind
                    stack.append(ind)
            if best:
                _, i, own = best
                last = i
                for j in range(i + 1, len(self.lines)):
                    if 0 <= self.stmt_ind[j] <= own:
                        break
                    if self.stmt_ind[j] != -1:
                        last = j
                return i, last
        start = re.compile((r.lead if r.starts_word(name) else r.lead_loose) + quoted + rf"[{_SPACE_U}]*\(").search
        for s, line in enumerate(self.lines):
            if name in line and start(line):
                return s, self._block_end(s)
        return None

    def chars(self, found: tuple[int, int]) -> int:
        return self.starts[found[1] + 1] - 1 - self.starts[found[0]]

    def body(self, found: tuple[int, int]) -> str:
        """The lines found, here or in another text of the same path, as far as there are any."""
        n = len(self.lines)
        return self.joined[self.starts[found[0]]:self.starts[min(found[1], n - 1) + 1] - 1] if found[0] < n else ""

    def names(self) -> set[str]:
        """Every plain name that is found."""
        return self.defs.keys() | self.calls().keys()


def is_plain(name: str) -> bool:
    return name.isidentifier() and name.isascii() or rules_of(name).name(name) is not None


def bodies_of(texts: list[Text | None], name: str) -> list[str | None]:
    """The bodies that a lookup gives for a path with these texts (more than one: rows of the same path)."""
    if not is_plain(name):
        own = [(t, t.scan(name)) for t in texts if t is not None]
        return [b for b in (t.body(found) for t, found in own if found) if b]
    found = [at for at in (t.find(name) for t in texts if t is not None) if at]
    return [None if t is None else t.body(at) for t in texts for at in found]


# ------------------------------------------------------------------ Arrow


def _column(values) -> pa.Array:
    """Strings as a column."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([None if v is None else v.encode("utf-8", _SURROGATES) for v in values], pa.binary()).view(pa.string())


def _strings(column: pa.Array) -> list[str | None]:
    """A column's strings."""
    try:
        return column.to_numpy(zero_copy_only=False).tolist()
    except UnicodeDecodeError:
        return list(_each(column))


def _each(texts: pa.Array):
    """The texts of a column, one after the other."""
    for v in texts.cast(pa.binary()):
        yield v.as_py().decode("utf-8", _SURROGATES) if v.is_valid else None


def _lists(column: pa.Array) -> tuple[list[int], pa.Array]:
    """Offsets and values of a list column; null is an empty list."""
    flat = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return [0, *np.cumsum(sizes).tolist()], flat


def _nested(sizes: list[int], names: list[str], values: list[pa.Array]) -> pa.Array:
    """A column of lists of structs with these sizes."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(values, names))


def skeletons(content: pa.Array, language: pa.Array) -> pa.Array:
    """``struct(skeleton, method_count, class_count)`` per file."""
    out = []
    for text, lang in zip(_each(content), _strings(language)):
        # a null text has no skeleton; only the generic one counts nothing in it
        none = (None, 0, 0) if lang not in _SKELETONS else (None, None, None)
        out.append(none if text is None else skeleton_of(text, lang))
    skeleton, methods, classes = zip(*out) if out else ((), (), ())
    return pa.StructArray.from_arrays(
        [_column(skeleton), pa.array(methods, pa.int32()), pa.array(classes, pa.int32())], ["skeleton", "method_count", "class_count"]
    )


def definitions(content: pa.Array, is_py: pa.Array) -> pa.Array:
    """``array<struct<name, start, stop, chars>>`` per file: one entry per plain name."""
    sizes, rows = [], []
    for text, py in zip(_each(content), is_py.to_pylist()):
        before = len(rows)
        if text is not None:
            t = Text(text, bool(py))
            for name in t.names():
                at = t.find(name)
                rows.append((name, *at, t.chars(at)))
        sizes.append(len(rows) - before)
    name, *places = zip(*rows) if rows else ((), (), (), ())
    return _nested(sizes, ["name", "start", "stop", "chars"], [_column(name), *[pa.array(p, pa.int32()) for p in places]])


class _Last:
    """The texts read last: the rows of a file with very many requests follow each other."""

    def __init__(self):
        self.key, self.texts = None, []

    def read(self, texts: list[str | None], is_py: bool) -> list[Text | None]:
        if self.key != (texts, is_py):
            self.key, self.texts = (texts, is_py), [None if t is None else Text(t, is_py) for t in texts]
        return self.texts


def lengths(content: pa.Array, is_py: pa.Array, methods: pa.Array) -> pa.Array:
    """``array<struct<method, chars>>`` per file: the methods found in it and their bodies' lengths."""
    offsets, flat = _lists(methods)
    asked, last = _strings(flat), _Last()
    sizes, at, chars = [], [], []
    for i, (text, py) in enumerate(zip(_each(content), is_py.to_pylist())):
        before = len(at)
        (t,) = last.read([text], bool(py))
        for k in range(offsets[i], offsets[i + 1]) if t else ():
            name = asked[k]
            if name is None:
                continue
            plain = is_plain(name)
            found = t.find(name) if plain else t.scan(name)
            n = t.chars(found) if found else 0
            if found and (plain or n):
                at.append(k)
                chars.append(n)
        sizes.append(len(at) - before)
    return _nested(sizes, ["method", "chars"], [flat.take(pa.array(at, pa.int64())), pa.array(chars, pa.int32())])


#: Characters of bodies after which a batch ends.
BATCH_CHARS = 1 << 23


def bodies(batches):
    """Rows ``(repo, path, error, texts, is_py, methods)`` as ``(repo, path, error, known, method, body)``: every
    method asked for, with each of its bodies or with null.  ``known`` says whether there are texts at all."""
    last = _Last()
    for batch in batches:
        repo, path, error, texts, is_py, methods = batch.columns
        known = pc.is_valid(texts)
        offsets, flat = _lists(methods)
        asked = _strings(flat)
        text_offsets, held = _lists(texts)
        read = _each(pc.struct_field(held, [0]))
        owner, at, found, chars = [], [], [], 0

        def rows():
            file, request = pa.array(owner, pa.int64()), pa.array(at, pa.int64())
            columns = [repo.take(file), path.take(file), error.take(file), known.take(file), flat.take(request), _column(found)]
            return pa.RecordBatch.from_arrays(columns, ["repo", "path", "error", "known", "method", "body"])

        for i, py in enumerate(is_py.to_pylist()):
            own = last.read([next(read) for _ in range(text_offsets[i + 1] - text_offsets[i])], bool(py))
            for k in range(offsets[i], offsets[i + 1]):
                name = asked[k]
                got = (bodies_of(own, name) if own and name is not None else None) or [None]
                for body in got:
                    owner.append(i)
                    at.append(k)
                    found.append(body)
                    chars += len(body) if body else 0
                if chars > BATCH_CHARS:
                    yield rows()
                    owner, at, found, chars = [], [], [], 0
        if at:
            yield rows()


def _changes(column: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before it."""
    a, b = column[1:], column[:-1]
    nulls = pc.xor(pc.is_null(a), pc.is_null(b))
    return pc.or_kleene(pc.fill_null(pc.not_equal(a, b), False), nulls).to_numpy(zero_copy_only=False)


#: Methods of one file that one row holds at most.
CHUNK = 4096


def chunks(batches):
    """Rows ``(repo, path, method)``, sorted, as ``(repo, path, methods)``: a file's methods in one row or a few."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        repo, path, method = batch.columns
        first = np.concatenate([[True], _changes(repo) | _changes(path)])
        starts = np.flatnonzero(first)
        long = np.diff(np.append(starts, n)) > CHUNK
        if long.any():
            ends = np.append(starts[1:], n)
            starts = np.unique(np.concatenate([starts, *[np.arange(starts[k], ends[k], CHUNK) for k in np.flatnonzero(long)]]))
        at = pa.array(starts)
        offsets = pa.array(np.append(starts, n), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [repo.take(at), path.take(at), pa.ListArray.from_arrays(offsets, method)], ["repo", "path", "methods"]
        )
