"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

1. The terms are all words of a sample of labelled documents; document frequencies
   come from all documents.
2. A term that surely (lower confidence bound) stands in toxic documents more often
   than the sample's share of them weighs more, up to :data:`BOOST` times; no term
   is left out.
3. The sample's unit vectors form an index.  Terms that many examples hold are a
   matrix, whose products with a batch of documents are taken at once; the others
   are an inverted index.  The sums are cut into blocks of consecutive examples with
   the largest of each, so the nearest :data:`K` are looked for, exactly, in the
   blocks that can hold them.
4. Neighbours vote with their cosine, sharpened relative to the nearest one's, as
   weight, smoothed by the sample's share of toxic examples, which is also the score
   of a document without neighbours.

The sample holds at most about :data:`MAX_EXAMPLES` labelled documents, chosen by a
hash of the id; everything else covers all documents.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections import Counter
from collections.abc import Collection, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, fold_of, forget, ship, small_batches, text_tag, without
from .words import words_of

FOLDS, HELD_OUT_FOLD = 5, 0
#: Labelled documents learned from, in expectation (the documented bound of the sample).
MAX_EXAMPLES = 20_000
#: Standard errors from chance, and the largest factor on a term's weight (at a toxic share of 1).
Z, BOOST = 3.0, 1000.0
K = 15
#: Weight of the prior among the votes.
PRIOR_WEIGHT = 1.0
#: A neighbour's vote is its cosine times this power of its ratio to the largest cosine.
SHARPEN = 2
BLOCK = 64
#: Share of the examples from which a term is in the matrix.
FREQUENT = 0.05
#: Documents scored at once, those of them whose products are taken at once, examples indexed at once, and the
#: matrix's rows copied at once for a product.
BATCH, GROUP, BUILD, ROWS = 1000, 64, 256, 128
#: Kinds of documents (languages, subjects) by which those scored at once are grouped, and examples they are found from.
KINDS, KIND_EXAMPLES = 16, 2_000
#: Scored vectors a worker remembers.
CACHE = 10_000


class Weights:
    """The examples' unit weights, worked out anew wherever some are needed: kept are counts, a byte each as a rule, and lengths."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray):
        self.sizes, self.terms, self.counts, self.idf = sizes, terms, counts, idf
        self.begin = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.often = 1 + np.log(np.arange(1, int(counts.max(initial=1)) + 1, dtype=np.float64))
        self.length = np.ones(len(sizes))
        for e, (i, j) in enumerate(zip(self.begin[:-1].tolist(), self.begin[1:].tolist())):
            w = self.often[counts[i:j] - 1] * idf[terms[i:j]]
            self.length[e] = math.sqrt(float((w * w).sum())) or 1.0

    def of(self, examples: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Weights of the ``examples``, whose ``terms`` lie one after the other."""
        counts = np.concatenate([self.counts[i:j] for i, j in zip(self.begin[examples].tolist(), self.begin[examples + 1].tolist())])
        w = self.often[counts - 1] * self.idf[terms]
        w /= np.repeat(self.length[examples], self.sizes[examples])
        return w


class Given:
    """Weights that are held as they are."""

    def __init__(self, sizes: np.ndarray, weights: np.ndarray):
        self.begin, self.weights = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), weights

    def of(self, examples: np.ndarray, terms: np.ndarray) -> np.ndarray:
        return np.concatenate([self.weights[i:j] for i, j in zip(self.begin[examples].tolist(), self.begin[examples + 1].tolist())])


class BlockMaxIndex:
    """Unit vectors by term; finds the exact nearest by cosine, by the maxima of blocks.

    ``vectors`` are sorted by what ties are broken by: the earlier wins.
    """

    def __init__(self, vectors: list[dict[int, float]]):
        sizes = np.array([len(v) for v in vectors], np.int64)
        terms = np.fromiter((t for v in vectors for t in v), np.int32, int(sizes.sum()))
        weights = np.fromiter((w for v in vectors for w in v.values()), np.float64, len(terms))
        self._build(sizes, terms, Given(sizes, weights))

    @classmethod
    def from_arrays(cls, sizes: np.ndarray, terms: np.ndarray, weights: Weights) -> BlockMaxIndex:
        """The index of vectors of ``sizes``, whose ``terms`` lie one after the other."""
        self = cls.__new__(cls)
        self._build(sizes, terms, weights)
        return self

    def _build(self, sizes: np.ndarray, terms: np.ndarray, weights: Weights | Given) -> None:
        """Fill the matrix and the inverted index a few vectors at a time: nothing is held twice."""
        self.n, width = len(sizes), int(terms.max()) + 1 if len(terms) else 0
        #: What is kept is summed again exactly; the search itself is of single precision.
        self.terms, self.weights = terms, weights
        self.begin = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        parts = [(i, min(i + BUILD, self.n)) for i in range(0, self.n, BUILD)]
        held, most = np.zeros(width, np.int64), 0.0
        for i, j in parts:
            t = terms[self.begin[i] : self.begin[j]]
            held += np.bincount(t, minlength=width)
            most = max(most, float(weights.of(np.arange(i, j), t).max(initial=0)))
        frequent = np.flatnonzero(held > FREQUENT * self.n)
        self.column = np.full(width, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        self.matrix = np.zeros((len(frequent), self.n), np.float32)
        held[frequent] = 0
        self.first = np.concatenate(([0], np.cumsum(held)))
        # the place and the weight, in whole steps, side by side, so that one look finds both in little memory
        self.half, pair = (np.uint16, np.uint32) if self.n <= 1 << 16 else (np.uint32, np.uint64)
        self.step = most / np.iinfo(self.half).max or 1.0
        self.held = np.zeros(self.first[-1], pair)
        places, rare = self.held.view(self.half)[::2], self.held.view(self.half)[1::2]
        free = self.first[:-1].copy()
        for i, j in parts:
            place = np.repeat(np.arange(i, j), sizes[i:j])
            t = terms[self.begin[i] : self.begin[j]]
            w = weights.of(np.arange(i, j), t)
            column = self.column[t]
            dense = column >= 0
            self.matrix[column[dense], place[dense]] = w[dense]
            t, w, place = t[~dense], w[~dense], place[~dense]
            order = np.argsort(t, kind="stable")
            t = t[order]
            nth = np.arange(len(t)) - np.searchsorted(t, t)
            at = free[t] + nth
            places[at], rare[at] = place[order], np.rint(w[order] / self.step)
            free += np.bincount(t, minlength=width)
        self.query = np.zeros(width)
        self.kinds = self._kinds()

    def _kinds(self) -> np.ndarray:
        """Centres of some vectors' frequent terms (k-means): they only say which queries go together."""
        some = self.matrix[:, :: -(-self.n // KIND_EXAMPLES) or 1].T
        some = some[some.any(1)]
        some = some / np.linalg.norm(some, axis=1, keepdims=True)
        centres = some[:: -(-len(some) // KINDS) or 1]
        for _ in range(5):
            near = (some @ centres.T).argmax(1) if len(centres) else np.zeros(0, int)
            centres = np.array([some[near == c].mean(0) if (near == c).any() else x for c, x in enumerate(centres)], np.float32).reshape(centres.shape)
        return centres

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[int, float]]]:
        """Of each query (ascending terms, weights): the ``k`` vectors of largest positive cosine, nearest first."""
        if not self.n:
            return [[] for _ in queries]
        size = len(self.matrix)
        part = np.zeros((len(queries), size), np.float32)
        rare = []
        for row, (terms, weights) in zip(part, queries):
            known = terms < len(self.column)
            terms, weights = terms[known], weights[known]
            at = self.column[terms]
            row[at[at >= 0]] = weights[at >= 0]
            rare.append((terms, weights, at < 0))
        slack = 1e-9 + 4e-7 * (size + 8)  # these sums are of single precision; what is kept is summed again
        found: list = [None] * len(queries)
        # queries of one kind go together, so that a product takes the rows of few terms
        alike = np.argsort((part @ self.kinds.T).argmax(1), kind="stable") if len(self.kinds) else np.arange(len(queries))
        for i in range(0, len(queries), GROUP):
            group = alike[i : i + GROUP]
            mine = part[group]
            used = np.flatnonzero(mine.any(0))
            sums = np.zeros((len(group), self.n), np.float32)
            for j in range(0, len(used), ROWS):
                sums += mine[:, used[j : j + ROWS]] @ self.matrix[used[j : j + ROWS]]
            for q, few in zip(group.tolist(), sums):
                found[q] = self._nearest(*rare[q], few, slack, k)
        return found

    def _exact(self, terms: np.ndarray, weights: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Cosines of the vectors ``hit``, in double precision."""
        if not len(hit):
            return np.zeros(0)
        self.query[terms] = weights
        ranges = [slice(i, j) for i, j in zip(self.begin[hit].tolist(), self.begin[hit + 1].tolist())]
        sizes = self.begin[hit + 1] - self.begin[hit]
        held = np.concatenate([self.terms[r] for r in ranges])
        of = self.query.take(held)
        of *= self.weights.of(hit, held)
        out = np.zeros(len(hit))
        full = np.flatnonzero(sizes)
        if len(full):
            out[full] = np.add.reduceat(of, (np.cumsum(sizes) - sizes)[full])
        self.query[terms] = 0
        return out

    def _nearest(self, terms: np.ndarray, weights: np.ndarray, few: np.ndarray, sums: np.ndarray, slack: float, k: int) -> list[tuple[int, float]]:
        lo, hi = self.first[terms[few]], self.first[terms[few] + 1]
        sizes = hi - lo
        ends = np.cumsum(sizes)
        held = self.held[np.arange(sizes.sum()) + np.repeat(lo - ends + sizes, sizes)]
        places, rare = held.view(self.half)[::2], held.view(self.half)[1::2]
        slack += self.step * float(weights[few].sum())  # twice what rounding to steps can take
        full = np.zeros(-(-self.n // BLOCK) * BLOCK)
        full[: self.n] = np.bincount(places, rare * np.repeat(weights[few] * self.step, sizes), self.n) + sums
        blocks = full.reshape(-1, BLOCK)
        peaks = blocks.max(1)
        # k blocks of the largest maxima hold k sums at least as large as the last of these maxima
        floor = max(float(np.partition(peaks, -k)[-k]) - 2 * slack, 0.0) if len(peaks) >= k else 0.0
        open_ = np.flatnonzero(peaks >= floor)
        i, j = np.nonzero(blocks[open_] >= floor)
        hit = open_[i] * BLOCK + j
        hit = hit[hit < self.n]
        if len(hit) > k:
            hit = hit[full[hit] >= np.partition(full[hit], -k)[-k] - 2 * slack]
        exact = self._exact(terms, weights, hit)
        best = np.lexsort((hit, -exact))[:k]
        return [(int(hit[b]), float(exact[b])) for b in best if exact[b] > 0]

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[int, float]]:
        """The ``k`` vectors of largest positive cosine, nearest first."""
        terms = np.array(sorted(query), np.int64)
        return self.search([(terms, np.array([query[t] for t in terms.tolist()], float))], k)[0]


def unit(terms: list[int], counts: list[int], idf: np.ndarray) -> dict[int, float]:
    """The unit TF-IDF vector of a document's terms."""
    w = unit_weights(np.array(terms, np.int64), np.array(counts, np.int64), idf)
    return dict(zip(terms, w.tolist()))


def unit_weights(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[terms]
    return w / math.sqrt(float((w * w).sum())) if len(w) else w


def toxic_factor(clean: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Factors of the terms' weights: 1, or more as the lower bound of the toxic share lies above ``share``."""
    n = np.maximum(clean + toxic, 1)
    p = toxic / n
    lower = (p + Z * Z / (2 * n) - Z * np.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    return BOOST ** (np.clip(lower - share, 0, None) / max(1 - share, 1e-9))


class Terms:
    """Codes of the terms."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.code = None

    def __getstate__(self):
        return zlib.compress(b" ".join(self.words), 1)

    def __setstate__(self, state):
        self.__init__(zlib.decompress(state).split())

    def _of(self, words: Collection[bytes]) -> np.ndarray:
        """The words' codes, -1 for those that are no terms."""
        if self.code is None:
            self.code = {w: i for i, w in enumerate(self.words)}
        return np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))

    def held(self, text: bytes | str | None) -> np.ndarray:
        """A text's terms, each once, in any order."""
        codes = self._of(set(words_of(text)))
        return codes[codes >= 0]

    def of(self, text: bytes | str | None) -> tuple[np.ndarray, np.ndarray]:
        """A text's terms, ascending, and their counts."""
        held = Counter(words_of(text))
        codes = self._of(held)
        counts = np.fromiter(held.values(), np.int64, len(held))
        order = np.argsort(codes)[np.count_nonzero(codes < 0) :]
        return codes[order], counts[order]


class Scorer:
    """Votes of the nearest examples.  It travels as the examples' terms and counts; the index is built where it is used.

    Without ``terms`` it scores documents by their terms only, not texts.
    """

    def __init__(self, ids: list[int], labels: list[int], prior: float, idf: np.ndarray, terms: Terms | None, held: tuple[np.ndarray, ...]):
        self.ids, self.labels, self.prior, self.idf, self.terms = ids, labels, prior, idf, terms
        #: Examples' numbers of terms, and their terms (ascending) and counts, one example after the other.
        self.held = held
        self.index = None
        self.seen: dict = {}

    def __getstate__(self):
        sizes, terms, counts = self.held
        small = np.min_scalar_type(int(counts.max(initial=1)))
        packed = [(k.str, zlib.compress(x.astype(k).tobytes(), 1)) for x, k in ((sizes, np.dtype("<i4")), (np.diff(terms, prepend=0), np.dtype("<i4")), (counts, small))]
        return self.ids, self.labels, self.prior, self.idf, self.terms, packed

    def __setstate__(self, state):
        *rest, packed = state
        sizes, steps, counts = (np.frombuffer(zlib.decompress(x), k) for k, x in packed)
        self.__init__(*rest, (sizes, np.cumsum(steps, dtype=np.int32), counts))

    def _built(self) -> BlockMaxIndex:
        if self.index is None:
            (sizes, terms, counts), self.held = self.held, None
            # the index refers to nothing of this scorer, so both are freed as soon as nothing uses them
            self.index = BlockMaxIndex.from_arrays(sizes, terms, Weights(sizes, terms, counts, self.idf))
        return self.index

    def score(self, texts: list[bytes | str | None]) -> list[tuple[float, list[int], list[float]]]:
        """Scores, and the evidence: the nearest examples' ids and cosines."""
        return self.score_terms([self.terms.of(t) for t in texts])

    def score_terms(self, found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int], list[float]]]:
        """The same of documents' terms, ascending, and counts."""
        keys = [(t.tobytes(), c.tobytes()) for t, c in found]
        keys = [hashlib.blake2b(t + b"|" + c, digest_size=16).digest() for t, c in keys]
        if len(self.seen) > CACHE:
            self.seen.clear()
        new = {k: f for k, f in zip(keys, found) if k not in self.seen}
        near = self._built().search([(t, unit_weights(t, c, self.idf)) for t, c in new.values()], K)
        for k, hits in zip(new, near):
            weights = [c * (c / hits[0][1]) ** SHARPEN for _, c in hits]
            votes = sum(w * self.labels[i] for w, (i, _) in zip(weights, hits)) + PRIOR_WEIGHT * self.prior
            self.seen[k] = votes / (sum(weights) + PRIOR_WEIGHT), [self.ids[i] for i, _ in hits], [c for _, c in hits]
        return [self.seen[k] for k in keys]


def _code(terms):
    """Arrow batches of ids, texts and tags to ids, tags, terms (ascending) and counts, both as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        t = terms.value
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                p = b.slice(lo, BATCH)
                found = [t.of(text) for text in p.column(1).cast(pa.binary()).to_pylist()]
                coded = [pa.array([f[i].astype("<i4").tobytes() for f in found], pa.binary()) for i in (0, 1)]
                yield pa.record_batch([p.column(0), p.column(2), *coded], names=["doc_id", "tag", "terms", "counts"])

    return run


def _frequencies(width: int):
    """Arrow batches of documents' terms to documents by term, summed per task; term -1 counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(width, np.int64), 0
        for b in batches:
            seen += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4"), minlength=width)
            total += b.num_rows
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array([-1, *at.tolist()], pa.int32()), pa.array([total, *seen[at].tolist()], pa.int64())], names=["term", "n"])

    return run


def _score(scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        s = scorer.value
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                p = b.slice(lo, BATCH)
                coded = zip(p.column(2).to_pylist(), p.column(3).to_pylist())
                rows = s.score_terms([(np.frombuffer(t, "<i4").astype(np.int64), np.frombuffer(c, "<i4").astype(np.int64)) for t, c in coded])
                yield pa.record_batch(
                    [p.column(0), p.column(1), pa.array([r[0] for r in rows], pa.float64()),
                     pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))],
                    names=["doc_id", "tag", "score", "neighbours", "cosines"],
                )

    return run


def sample_labels(labels: DataFrame, column: str, folds: int, held_out: int) -> DataFrame:
    """``doc_id, label`` of the labelled documents to learn from, about MAX_EXAMPLES of them.

    Rows without id or label drop out; a document labelled both ways counts as 1;
    the held-out fold is never learned from.
    """
    ok = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col(column) > 0).cast("int")).alias("label"))
    )
    n = ok.count()
    share = min(1.0, MAX_EXAMPLES / max(n, 1))
    return ok.filter(F.pmod(F.xxhash64(F.lit("example"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def build_scorer(docs: DataFrame, labels: DataFrame) -> tuple[Scorer, DataFrame]:
    """What the labels teach, and the documents by their terms (``doc_id, tag, terms, counts``), each text split once.

    ``docs`` has ``doc_id`` (long) and ``text``.
    """
    spark = docs.sparkSession
    chosen = cut(sample_labels(labels.select("doc_id", "toxic"), "toxic", FOLDS, HELD_OUT_FOLD), "examples")
    known = cut(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").distinct(), "example-texts")  # bounded by MAX_EXAMPLES
    code: dict[bytes, int] = {}
    rows, found, held = [], array("i"), array("i")
    for r in known.withColumn("tag", F.md5(F.col("text").cast("binary"))).toLocalIterator():
        c = Counter(words_of(r["text"]))
        rows.append((r["doc_id"], r["label"], r["tag"] or "", len(found), len(c)))
        found.extend(code.setdefault(w, len(code)) for w in c)
        held.extend(c.values())
    drop(known)
    drop(chosen)
    found, held = np.frombuffer(found, np.int32) if found else np.zeros(0, np.int32), np.frombuffer(held, np.int32) if held else np.zeros(0, np.int32)
    rows.sort(key=lambda r: r[:3])
    # common words first: what is looked up often lies together
    words, often = list(code), np.bincount(found, minlength=len(code)).tolist()
    del code
    order = sorted(range(len(words)), key=lambda i: (-often[i], words[i]))
    words = [words[i] for i in order]
    place_of = np.zeros(len(words), np.int32)
    place_of[order] = np.arange(len(words))
    del order, often
    ids, labelled = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
    prior = float(labelled.mean()) if rows else 0.0
    sizes = np.array([r[4] for r in rows], np.int32)
    terms, counts = np.zeros(len(found), np.int32), np.zeros(len(found), np.int32)
    by_label = np.zeros((2, len(words)), np.int64)
    end = 0
    for _, y, _, i, size in rows:
        codes = place_of[found[i : i + size]]
        order = np.argsort(codes)
        begin, end = end, end + size
        terms[begin:end], counts[begin:end] = codes[order], held[i : i + size][order]
        by_label[y, codes] += 1
    del rows, found, held, place_of
    coder = Terms(words)
    sent = spark.sparkContext.broadcast(coder)
    with small_batches(spark):
        tagged = docs.withColumn("tag", text_tag(F.col("text")))
        coded = cut(tagged.mapInArrow(_code(sent), "doc_id long, tag string, terms binary, counts binary"), "terms")
        sent.destroy()  # workers drop it before they build the index
        df = coded.select("terms").mapInArrow(_frequencies(len(words)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(words) + 1, np.int64)
    n[df.column("term").to_numpy()] = df.column("n").to_numpy()  # the last place is that of term -1
    idf = (1 + np.log((n[-1] + 1) / (n[:-1] + 1))) * toxic_factor(*by_label, prior)
    return Scorer(ids, labelled.tolist(), prior, idf, coder, (sizes, terms, counts)), coded


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, tag, score, neighbours, cosines`` (the text's digest; the evidence).

    Null and empty texts, and texts without a word of any example, get the prior; so
    does every text when there are no labels (then 0).  Equal texts get equal
    scores; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scorer, coded = build_scorer(docs, labels)
    scorer.terms = None  # the documents' terms are known: no task holds both the words and the index
    scorer = docs.sparkSession.sparkContext.broadcast(scorer)
    with small_batches(docs.sparkSession):
        out = cut(coded.mapInArrow(_score(scorer), "doc_id long, tag string, score double, neighbours array<long>, cosines array<double>"), "scores")
    scorer.destroy()  # nothing of it stays where later steps run
    drop(coded)
    return out


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score at least ``threshold``; all columns stay.

    Rows that share an id, or have none, go each by its own text.
    """
    return without(docs, score_toxicity(docs, labels).filter(F.col("score") >= threshold), "toxic")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document scored."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return score_toxicity(read("documents"), read("labels")).select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "neighbours",
        "cosines",
    )
