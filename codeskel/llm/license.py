"""License scans: exact set-similarity join of text blocks with license templates.

Blocks are the windows of consecutive words, wherever lines break, of at most
:data:`SPAN` times the template's length.  A block matches a template if it contains
at least :data:`CONTAINMENT` of the template's distinct words, among them those that
tell it from other templates (:data:`MARKS`, or its numbers, and what a template that
alone would reach the threshold lacks).  Candidates are the templates of which the
whole document holds enough words; this join is exact and never compares all pairs:

* words are ordered by the number of lines of the whole corpus that hold them,
  rarest first (ties by spelling);
* prefix filter: of a template of n words, of which a block must hold a = ceil(c*n),
  the block holds one of the n-a+1 rarest; an index maps these to templates;
* length filter: the block has at least a distinct words;
* positional filter: with the first shared word at place i of the template, at most
  n-i can be shared;
* the remaining candidates are counted in full, then their blocks are looked for in
  one pass over the places of the template's words.

Templates are configuration: at most :data:`MAX_TEMPLATE_WORDS` words in all are
accepted, which bounds what is sent to the workers.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

CONTAINMENT = 0.8
#: Words of a block at most, as a multiple of the template's words.
SPAN = 1.5
MAX_TEMPLATE_WORDS = 200_000

#: Fixed values of the contract: phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Usual statements of licenses, by label.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    ("mit-permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-release", "released under the mit license"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4.0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright cc0 1.0 universal"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("rights-reserved", "copyright all rights reserved"),
)

#: Words without which a statement does not name the license.
MARKS = {
    "apache-2.0": "apache 2",
    "gpl-3.0": "gnu 3",
    "gpl-2.0": "gnu 2",
    "mit-permission": "permission",
    "mit-release": "mit license",
    "cc-by-4.0": "creative commons attribution 4",
    "cc-by-nc-4.0": "cc nc 4",
    "cc-by-sa-4.0": "cc sa 4",
    "cc0-1.0": "cc0",
    "bsd": "redistribution",
    "mpl-2.0": "mozilla 2",
    "rights-reserved": "rights reserved",
}

#: ASCII other than digits and letters parts words (the contract's words); A-Z become a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def line_words(text: bytes | None) -> list[list[bytes]]:
    """Words of each line."""
    return [ln.translate(_TABLE).split() for ln in (text or b"").split(b"\n")]


def template_words(templates) -> list[tuple[str, list[bytes]]]:
    return [(label, sorted({w for ln in line_words(t.encode()) for w in ln})) for label, t in templates]


class TemplateIndex:
    """Prefix index over the templates for a global word order."""

    def __init__(self, templates, counts: dict[bytes, int], containment: float):
        self.items = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for label, words in template_words(templates):
            if not words:
                continue
            words = sorted(words, key=lambda w: (counts.get(w, 0), w))
            need = max(1, math.ceil(containment * len(words) - 1e-9))
            for place, w in enumerate(words[: len(words) - need + 1]):
                self.prefix[w].append((len(self.items), place))
            self.items.append((label, words, need))
        self.rare = set(self.prefix)
        lengths = {label: sum(map(len, line_words(t.encode()))) for label, t in templates}
        places = defaultdict(list)
        for t, (_, words, _) in enumerate(self.items):
            for w in words:
                places[w].append(t)
        #: Per template: its words, how many a block must hold, those it must hold, and a block's length at most.
        self.blocks = {}
        for t, (label, words, need) in enumerate(self.items):
            own = set(words)
            marks = set(MARKS[label].encode().split()) & own if label in MARKS else {w for w in own if w.isdigit()}
            shared: dict[int, int] = defaultdict(int)
            for w in words:
                for other in places[w]:
                    shared[other] += 1
            for other, n in shared.items():
                if other != t and n >= need:
                    marks |= own.difference(self.items[other][1])
            self.blocks[label] = own, need, marks, max(len(words), int(SPAN * lengths[label]))

    def best_block(self, label: str, words: list[bytes]) -> float:
        """The largest containment of the template in a block of a document's words; 0 if none reaches it."""
        own, need, marks, width = self.blocks[label]
        at = [i for i, w in enumerate(words) if w in own]
        held: dict[bytes, int] = defaultdict(int)
        lo = distinct = marked = best = 0
        for i in at:
            w = words[i]
            held[w] += 1
            if held[w] == 1:
                distinct += 1
                marked += w in marks
            while at[lo] <= i - width:
                old = words[at[lo]]
                held[old] -= 1
                if not held[old]:
                    distinct -= 1
                    marked -= old in marks
                lo += 1
            if distinct >= need and marked == len(marks):
                best = max(best, distinct)
        return best / len(own)

    def matches(self, block: set[bytes]) -> Iterator[tuple[str, float]]:
        """Label and containment of every template that the block reaches."""
        first: dict[int, int] = {}
        for w in self.rare & block:
            for t, place in self.prefix[w]:
                first[t] = min(place, first.get(t, place))
        for t, place in first.items():
            label, words, need = self.items[t]
            if len(block) < need or len(words) - place < need:
                continue
            shared = sum(w in block for w in words[place:])
            if shared >= need:
                yield label, shared / len(words)


def scan(text: bytes | None, index: TemplateIndex, phrases: list[tuple[list[bytes], str]]) -> tuple:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score`` of a text."""
    words = [w for ln in line_words(text) for w in ln]
    held = set(words)
    base, places, score = set(), [], 0.0
    for phrase, label in phrases:
        if not held.issuperset(phrase):
            continue
        at, n = -1, len(phrase)
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if words[at : at + n] == phrase:
                places.append(at)
                base.add(label)
                score = 1.0
    found = set(base)
    for label, _ in index.matches(held):
        share = index.best_block(label, words)
        if share:
            found.add(label)
            score = max(score, share)
    ends = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(found)), score


def _line_counts(vocab: frozenset[bytes]):
    """Arrow batches of texts to lines by template word, summed per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                for t in b.column(0).slice(lo, 512).cast(pa.binary()).to_pylist():
                    for ln in (t or b"").split(b"\n"):
                        for w in vocab.intersection(ln.translate(_TABLE).split()):
                            seen[w] += 1
        yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return run


_OUT = (("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()))


def _scanner(index: TemplateIndex, phrases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                p = b.slice(lo, 512)
                rows = [scan(t, index, phrases) for t in p.column(1).cast(pa.binary()).to_pylist()]
                cols = [p.column(0).to_pylist(), *(list(c) for c in zip(*rows))] if rows else [[] for _ in _OUT]
                yield pa.record_batch([pa.array(c, k) for c, (_, k) in zip(cols, _OUT)], names=[n for n, _ in _OUT])

    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is 1 for a base phrase, else the largest containment that reached the
    threshold, else 0.  Null and empty texts have no words and no labels; rows of
    equal ids are reported each; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    vocab = frozenset(w for _, ws in template_words(templates) for w in ws)
    if len(vocab) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.select("text").mapInArrow(_line_counts(vocab), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {bytes(r["word"]): r["n"] for r in rows.collect()}  # a row per template word at most
    index = TemplateIndex(templates, counts, containment)
    split = [(p.encode().split(), label) for p, label in phrases]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.mapInArrow(_scanner(index, split), schema)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document scanned."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
