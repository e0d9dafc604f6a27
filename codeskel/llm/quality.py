"""Quality by Bradley-Terry ranking.

A document's score is a weighted sum of features of its text.  The weights make
the better of two labelled documents win: logistic loss on the differences of
their features, over pairs of a document of quality 1 and one of quality 0.  The
threshold is the quantile of the learned documents' scores that leaves as large a
share below as is labelled 0, and the reported score is the logistic function of
the distance to it.

Weights come from about :data:`MAX_EXAMPLES` labelled documents, chosen by a hash
of the id, and :data:`PAIRS` pairs of them; every document is scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold_of, ship
from .toxicity import MAX_EXAMPLES, sample_labels

FOLDS, HELD_OUT_FOLD = 3, 1
#: Preference pairs of the fit.
PAIRS = 60_000
RIDGE = 1e-3
SEED = 10

_PUNCT = b".,;:!?'\"()-"
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _PUNCT)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))

FEATURES = (
    "log_words", "log_chars", "word_length", "longest_word", "repeat_share", "longest_repeat", "distinct_share", "top_share",
    "symbol_share", "symbol_words", "worst_line_symbols", "worst_line_repeats", "punct_share", "upper_share", "digit_share",
    "high_share", "short_words", "line_repeats", "words_per_line", "empty",
)


def _count(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def _repeats(words: list[bytes]) -> tuple[int, int]:
    """Words equal to the one before, and the longest run of equal words."""
    n = most = run = 0
    for a, b in zip(words, words[1:]):
        if a == b:
            n += 1
            run += 1
            if run > most:
                most = run
        else:
            run = 0
    return n, most + 1


def features(text: bytes | None) -> list[float]:
    """The features of a text; null counts as empty."""
    raw = text or b""
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    lines = [ln for ln in raw.split(b"\n") if ln.strip()]
    reps, run = _repeats(words)
    types: dict[bytes, int] = {}
    for w in words:
        types[w] = types.get(w, 0) + 1
    sym = _count(raw, _SYMBOL)
    line_sym = line_rep = 0.0
    if sym or reps:
        for ln in lines:
            ws = ln.split()
            line_sym = max(line_sym, _count(ln, _SYMBOL) / len(ln))
            line_rep = max(line_rep, _repeats(ws)[0] / len(ws))
    with_sym = sum(1 for w in words if w.translate(None, _SYMBOL) != w) if sym else 0
    short = sum(1 for w in words if len(w) <= 3)
    return [
        math.log1p(len(words)), math.log1p(len(raw)), len(raw) / n, math.log1p(max(map(len, words), default=0)),
        reps / n, math.log(run), math.log1p(len(types)) / math.log1p(n), max(types.values(), default=0) / n,
        sym / size, with_sym / n, line_sym, line_rep, _count(raw, _PUNCT) / size, _count(raw, _UPPER) / size,
        _count(raw, _DIGIT) / size, _count(raw, _HIGH) / size, short / n,
        1 - len(set(lines)) / max(len(lines), 1), math.log1p(n / max(len(lines), 1)), float(not words),
    ]


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights on raw features and the threshold, from features and 0/1 labels.

    Pairs are drawn by a fixed seed; Newton steps minimise the pairwise logistic
    loss.  With one class only, all weights are 0 and everything scores on that
    class's side.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = x.shape[1]
    if not len(good) or not len(bad):
        return np.zeros(d), 0.0 if not len(x) else (-1.0 if len(good) else 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    r = np.random.Generator(np.random.PCG64(SEED))
    diff = z[r.choice(good, PAIRS)] - z[r.choice(bad, PAIRS)]
    w = np.zeros(d)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # chance that the worse one wins
        grad = -(diff * p[:, None]).mean(axis=0) + RIDGE * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / PAIRS + RIDGE * np.eye(d)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    w = w / scale
    return w, float(np.quantile(x @ w, len(bad) / len(x), method="midpoint"))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])


def _scorer(weights: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                p = b.slice(lo, 512)
                x = np.array([features(t) for t in p.column(1).cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(FEATURES))
                raw = x @ weights
                score = 1 / (1 + np.exp(-np.clip(raw - threshold, -500, 500)))
                yield pa.record_batch([p.column(0), pa.array(score), pa.array(raw)], names=["doc_id", "score", "strength"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, score, strength`` (the Bradley-Terry strength).

    Null texts count as empty and are scored like any text; without labels every
    score is 0.5; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = cut(sample_labels(labels.select("doc_id", "quality"), "quality", FOLDS, HELD_OUT_FOLD), "examples")
    few = F.broadcast(chosen)  # bounded by MAX_EXAMPLES
    rows = docs.join(few, "doc_id").select("label", "text").mapInArrow(_featurize, "label int, x array<double>")
    data = rows.orderBy("label", "x").collect()  # the bounded sample's features, in an order that never changes
    x = np.array([r["x"] for r in data], np.float64).reshape(-1, len(FEATURES))
    weights, threshold = fit(x, np.array([r["label"] for r in data]))
    return docs.mapInArrow(_scorer(weights, threshold), "doc_id long, score double, strength double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document scored."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return score_quality(read("documents"), read("labels")).select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "strength",
    )
