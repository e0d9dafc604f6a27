"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Words of the test items are counted over the whole corpus.
2. From every position of an item the shortest n-gram whose expected number of
   chance occurrences in the corpus, words being independent, is small becomes a
   seed.  Rarity is judged by words, not by the n-gram's own count, so a passage
   that leaked into very many documents keeps its seeds.
3. Documents are scanned for seeds.  A hit proposes the item and a diagonal.
4. The item is aligned with the document's words around each diagonal by local
   alignment (match +2, mismatch -1, gap -1); the score is divided by that of a
   perfect copy.
5. A run of :data:`RUN` words of an item is a copy too, also of a long item; its score
   is its part of the item.  Items of fewer than :data:`SHORT` words count only where
   they are the whole text.

The scan is row-local: no document text is shuffled.  The test items travel to
the workers in portions of at most :data:`PORTION_WORDS` words, one pass over the
documents for each portion, so a benchmark of any size fits.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, text_tag, without
from .words import words_of

MATCH, MISMATCH, GAP = 2, -1, -1
#: Part of a perfect copy's score from which a passage counts as a copy of the item.
MIN_SCORE = 0.5
#: A run of so many words of an item, word for word, counts as a copy whatever the item's length.
RUN = 13
#: Items of fewer words count only where they are a document's whole text.
SHORT = 3
#: Expected chance hits of a seed in the whole corpus.
CHANCE_HITS = 0.05
MAX_SEED = 8
#: Size (as a power of 2) of the hash tables that pass over most places without a seed.
SLOT_BITS = 20
#: Benchmark words per pass over the documents (bounds what is sent to the workers).
PORTION_WORDS = 2_000_000

def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and the first and last aligned position of ``doc``.

    One row per item word; gaps inside a row are resolved by a running maximum,
    as a gap costs the same at each step.
    """
    n = len(doc)
    score = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    steps = np.arange(n + 1) * GAP
    best = (0, 0, 0)
    for w in item:
        diag = score[:-1] + np.where(doc == w, MATCH, MISMATCH)
        up = score + GAP
        new, frm = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = diag > 0
        new[1:][take], frm[1:][take] = diag[take], start[:-1][take]
        take = up > new
        new[take], frm[take] = up[take], start[take]
        run = np.maximum.accumulate(new - steps)
        left = run + steps
        take = left > new
        if take.any():
            origin = np.maximum.accumulate(np.where(new - steps == run, np.arange(n + 1), 0))
            frm = np.where(take, frm[origin], frm)
            new = np.where(take, left, new)
        score, start = new, frm
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(start[j]), j - 1)
    return best


def longest_run(item: np.ndarray, doc: np.ndarray, off: int) -> tuple[int, int]:
    """The longest run of equal words on a diagonal: its length, and its first position in ``doc``."""
    lo, hi = max(0, -off), min(len(item), len(doc) - off)
    if hi <= lo:
        return 0, 0
    equal = np.zeros(hi - lo + 2, np.int8)
    equal[1:-1] = item[lo:hi] == doc[off + lo : off + hi]
    steps = np.diff(equal)
    first, end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    if not len(first):
        return 0, 0
    k = int((end - first).argmax())
    return int(end[k] - first[k]), off + lo + int(first[k])


def choose_seeds(items: dict[int, list[bytes]], counts: dict[bytes, int], total: int) -> dict[tuple, list[tuple[int, int]]]:
    """Seed n-gram to its (item, position) places.

    An item whose words are all too common, or too few, for a rare n-gram keeps
    its longest one from each position, so every item has seeds.
    """
    seeds: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    total = max(total, 1)
    rate = {w: math.log(max(c, 1) / total) for w, c in counts.items()}
    least = math.log(1 / total)
    for item, ws in items.items():
        rare = []
        for i in range(len(ws)):
            chance = math.log(total)
            for n in range(1, min(MAX_SEED, len(ws) - i) + 1):
                chance += rate.get(ws[i + n - 1], least)
                if n >= 2 and chance <= math.log(CHANCE_HITS):
                    rare.append((i, n))
                    break
        if not rare:
            n = min(MAX_SEED, len(ws))
            rare = [(i, n) for i in range(len(ws) - n + 1)] if n else []
        for i, n in rare:
            seeds[tuple(ws[i : i + n])].append((item, i))
    return dict(seeds)


class Matcher:
    """Finds the items of one portion in documents."""

    def __init__(self, items: dict[int, list[bytes]], counts: dict[bytes, int], total: int):
        self.code = {w: i for i, w in enumerate(sorted({w for ws in items.values() for w in ws}))}
        self.items = {k: np.array([self.code[w] for w in ws], np.int64) for k, ws in items.items()}
        self.seeds: dict[int, dict[tuple, list[tuple[int, int]]]] = defaultdict(dict)
        for gram, places in choose_seeds(items, counts, total).items():
            self.seeds[len(gram)][tuple(self.code[w] for w in gram)] = places
        self.maybe = {n: self._bits(grams) for n, grams in self.seeds.items()}

    @staticmethod
    def _slot(cols: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(cols[0]), np.uint64)
        for c in cols:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return h >> np.uint64(64 - SLOT_BITS)

    def _bits(self, grams) -> np.ndarray:
        """A hash table of the seeds of one length, without their values."""
        bits = np.zeros(1 << SLOT_BITS, bool)
        bits[self._slot(list(np.array(list(grams), np.int64).T))] = True
        return bits

    def _hits(self, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Places of seeds in a sequence of word codes: ``(position, item, diagonal)``."""
        known = doc >= 0
        for n, grams in self.seeds.items():
            if len(doc) < n:
                continue
            ok = known[: len(doc) - n + 1].copy()
            for j in range(1, n):
                ok &= known[j : len(doc) - n + 1 + j]
            at = np.flatnonzero(ok)
            at = at[self.maybe[n][self._slot([doc[at + j] for j in range(n)])]]
            for p, gram in zip(at.tolist(), zip(*[doc[at + j].tolist() for j in range(n)])):
                for item, i in grams.get(gram, ()):
                    yield p, item, p - i

    def find_all(self, texts: list[bytes | str | None]) -> Iterator[tuple[int, list]]:
        """``find`` for several texts: their numbers and results, where there are any.

        The texts' words lie in one array, an unknown word between two texts.
        """
        get = self.code.get
        split = [words_of(t) for t in texts]
        ends = np.cumsum([len(ws) + 1 for ws in split]) if split else np.zeros(0, np.int64)
        flat = np.fromiter((c for ws in split for c in (*(get(w, -1) for w in ws), -1)), np.int64, int(ends[-1]) if split else 0)
        by_text: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        hits = list(self._hits(flat))
        for (p, item, off), k in zip(hits, np.searchsorted(ends, [h[0] for h in hits], side="right").tolist()):
            by_text[k][item].add(off - (int(ends[k]) - len(split[k]) - 1))
        for k, diagonals in sorted(by_text.items()):
            lo = int(ends[k]) - len(split[k]) - 1
            found = self._aligned(flat[lo : lo + len(split[k])], diagonals)
            if found:
                yield k, found

    def _aligned(self, doc: np.ndarray, diagonals: dict[int, set[int]]) -> list[tuple[int, float, int, int]]:
        """``(item, score, first_word, last_word)`` of every proposed item with a copy (the best copy)."""
        out = []
        for item, offs in sorted(diagonals.items()):
            ids = self.items[item]
            if len(ids) < SHORT:
                if np.array_equal(doc, ids):
                    out.append((item, 1.0, 0, len(ids) - 1))
                continue
            margin = len(ids) // 2 + 2
            best = (0, 0, 0)
            spans: list[list[int]] = []
            for off in sorted(offs):  # nearby diagonals share a window
                lo, hi = max(0, off - margin), min(len(doc), off + len(ids) + margin)
                if spans and lo <= spans[-1][1] - len(ids) and hi - spans[-1][0] <= 6 * len(ids) + 64:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            own = np.zeros(len(self.code) + 1, bool)
            own[ids] = True  # an unknown word's code, -1, reads the last place
            need = MIN_SCORE * len(ids)
            for lo, hi in spans:
                if own[doc[lo:hi]].sum() < need:  # too few words of the item for any alignment
                    continue
                s, a, b = align(ids, doc[lo:hi])
                if s > best[0]:
                    best = (s, lo + a, lo + b)
            if len(ids) and best[0] >= MIN_SCORE * MATCH * len(ids):
                out.append((item, best[0] / (MATCH * len(ids)), best[1], best[2]))
            elif len(ids) > RUN:
                n, at = max(longest_run(ids, doc, off) for off in offs)
                if n >= RUN:
                    out.append((item, n / len(ids), at, at + n - 1))
        return out


def _counter(vocab):
    """Arrow batches of texts to one row per vocabulary word and task: occurrences, and all words at the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocab.value
        code = {w: i for i, w in enumerate(words)}.get
        seen = np.zeros(len(words) + 1, np.int64)  # the last place counts all other words
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                split = [words_of(t) for t in b.column(0).slice(lo, 256).cast(pa.binary()).to_pylist()]
                codes = np.fromiter((code(w, len(words)) for ws in split for w in ws), np.int64)
                seen += np.bincount(codes, minlength=len(words) + 1)
        yield pa.record_batch([pa.array([*words, b""], pa.binary()), pa.array([*seen[:-1], seen.sum()])], names=["word", "n"])

    return run


def _finder(matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                p = b.slice(lo, 256)
                ids, tags = p.column(0).to_pylist(), p.column(2).to_pylist()
                rows = [(ids[k], tags[k], *hit) for k, hits in m.find_all(p.column(1).cast(pa.binary()).to_pylist()) for hit in hits]
                if rows:
                    cols = list(zip(*rows))
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                    yield pa.record_batch(
                        [pa.array(c, k) for c, k in zip(cols, kinds)],
                        names=["doc_id", "tag", "item_id", "score", "first_word", "last_word"],
                    )

    return run


def _portions(benchmark: DataFrame) -> Iterator[dict[int, list[bytes]]]:
    """The items in portions that bound the words held at once; items without words drop out."""
    part: dict[int, list[bytes]] = {}
    held = 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null").distinct().toLocalIterator():
        ws = words_of(r[1])
        if not ws:
            continue
        if held + len(ws) > PORTION_WORDS and part or r[0] in part:
            yield part
            part, held = {}, 0
        part[r[0]] = ws
        held += len(ws)
    if part:
        yield part


MATCH_SCHEMA = "doc_id long, tag string, item_id long, score double, first_word int, last_word int"


def find_copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item of which it holds a copy: ``doc_id, tag, item_id,
    score, first_word, last_word`` (the text's digest; score 1: word for word; the span counts
    the document's words from 0).

    Null and empty texts match nothing, nor do items without words or id; rows of
    equal ids are reported each; empty tables give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_tag(F.col("text")).alias("tag"))
    out = spark.createDataFrame([], MATCH_SCHEMA)
    for items in _portions(benchmark):
        vocab = spark.sparkContext.broadcast(sorted({w for ws in items.values() for w in ws}))
        # at most one row per benchmark word of this portion comes back
        rows = docs.select("text").mapInArrow(_counter(vocab), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        counts = {bytes(r["word"]): r["n"] for r in rows.collect()}
        matcher = spark.sparkContext.broadcast(Matcher(items, counts, counts.pop(b"", 0)))
        out = out.union(docs.mapInArrow(_finder(matcher), MATCH_SCHEMA))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a copy of a test item; all columns stay.

    Rows that share an id, or have none, go each by its own text.
    """
    return without(docs, find_copies(docs, benchmark), "contaminated")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a benchmark item in any document."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return find_copies(read("documents"), read("benchmark")).drop("tag")
