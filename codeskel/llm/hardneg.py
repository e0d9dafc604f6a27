"""Hard negatives by rotated one-bit codes.

Vectors are taken as integers (``floor(256 * x)``); a score is an integer inner
product.  Each row stores, beside them, codes of its unit vector under a fixed
random rotation: the signs are a code vector of unit length, the *alignment* is the
vector's inner product with it, and what remains is coded again, :data:`LEVELS`
times, so that

    unit vector = sum of alignment * code vector + residual.

An anchor is rotated alike and rounded to :data:`QUERY_BITS` bits, kept as bit
planes: its product with a code vector is a weighted sum of popcounts.  The part of
the score that the codes do not show is at most |anchor| * |residual| by Cauchy-
Schwarz, and the rounding error at most its own length, so each level gives a
certain interval for every score.  Rows whose interval cannot reach the result are
dropped, level by level; the others are scored in integers.  Nothing is estimated in
the result.

All rows are dealt in chunks by a hash of their id, anchors in blocks; an anchor
visits every chunk, whose best rows are merged.  Positives are found first; their
scores bound the windows in which negatives are looked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, ship

LEVELS = 6
QUERY_BITS = 8
#: Rows that a task holds at once, and anchors that visit them in one task.
CHUNK_ROWS = 4096
BLOCK_ANCHORS = 4096
SCALE = 256
#: Integer components stay below this, so that scores fit 64 bits at any dimension.
MAX_COMPONENT = 1 << 23
POSITIVES, NEGATIVES = 5, 10
#: Negative scores lie between these percentages of the positive's score.
LOW_PERCENT, HIGH_PERCENT = 30, 90
#: Relative allowance for rounding in double precision.
SLACK = 1e-9

CODED = "dim int, vec_id long, label long, v array<int>, norm double, codes binary, aligned array<double>, rest double"


def padded(dim: int) -> int:
    """Dimension of the rotated space: a power of two, at least 64."""
    return max(64, 1 << max(0, dim - 1).bit_length())


@lru_cache
def _signs(width: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(width)).choice((-1.0, 1.0), (2, width))


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows under a fixed random rotation (sign flips and Walsh-Hadamard transforms, twice)."""
    n, dim = x.shape
    width = padded(dim)
    out = np.zeros((n, width))
    out[:, :dim] = x
    for flip in _signs(width):
        out *= flip
        h = 1
        while h < width:
            pair = out.reshape(n, -1, 2, h)
            out = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), axis=2).reshape(n, width)
            h *= 2
        out /= np.sqrt(width)
    return out


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Integer rows to norms, codes (row, level, bytes), alignments (row, level) and residual norms."""
    norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    left = rotate(v / np.where(norm > 0, norm, 1)[:, None])
    width = left.shape[1]
    codes = np.zeros((len(v), LEVELS, width // 8), np.uint8)
    aligned = np.zeros((len(v), LEVELS))
    for t in range(LEVELS):
        up = left > 0
        codes[:, t] = np.packbits(up, axis=1, bitorder="little")
        code = np.where(up, 1.0, -1.0) / np.sqrt(width)
        aligned[:, t] = (left * code).sum(axis=1)
        left = left - aligned[:, t, None] * code
    return norm, codes, aligned, np.sqrt((left * left).sum(axis=1))


class Anchor:
    """One anchor, rotated and rounded to bit planes."""

    def __init__(self, v: np.ndarray):
        q = rotate(v[None, :].astype(np.float64))[0]
        lo, top = q.min(), (1 << QUERY_BITS) - 1
        step = (q.max() - lo) / top
        u = np.rint((q - lo) / step).astype(np.int64) if step > 0 else np.zeros(len(q), np.int64)
        near = lo + step * u
        self.v, self.lo, self.step, self.total = v, lo, step, near.sum()
        self.error, self.length = np.sqrt(((q - near) ** 2).sum()), np.sqrt((near * near).sum())
        self.planes = np.packbits((u[None, :] >> np.arange(QUERY_BITS)[:, None]) & 1, axis=1, bitorder="little").view(np.uint64)

    def products(self, codes: np.ndarray) -> np.ndarray:
        """Inner products of the rounded anchor with code vectors, by popcounts."""
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.float64)
        weighted = np.zeros(len(codes))
        for j, plane in enumerate(self.planes):
            weighted += float(1 << j) * np.bitwise_count(codes & plane).sum(axis=1, dtype=np.float64)
        up = self.lo * ones + self.step * weighted
        return (2 * up - self.total) / np.sqrt(codes.shape[1] * 64)


class Chunk:
    """Rows of one task, ascending by id."""

    def __init__(self, rows: list[dict]):
        rows.sort(key=lambda r: r["vec_id"])
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], np.int64)
        self.v = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), -1)
        self.norm = np.array([r["norm"] for r in rows])
        self.aligned = np.array([r["aligned"] for r in rows])
        codes = np.stack([np.frombuffer(r["codes"], np.uint64).reshape(LEVELS, -1) for r in rows])
        self.codes = np.ascontiguousarray(codes.transpose(1, 0, 2))
        # length of what is not covered after each level; the last one as measured
        left = 1 - np.cumsum(self.aligned**2, axis=1)
        self.rest = np.sqrt(np.maximum(left, 0) + SLACK)
        self.rest[:, -1] = np.minimum(self.rest[:, -1], np.array([r["rest"] for r in rows]) + SLACK)

    def near(self, a: Anchor, at: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """Per window ``(low, high)`` of scores its ``k`` best ``(vec_id, score)`` among positions ``at``."""
        sum_ = np.zeros(len(at))
        for t in range(LEVELS):
            if not len(at):
                break
            sum_ = sum_ + self.aligned[at, t] * a.products(self.codes[t][at])
            mid = self.norm[at] * sum_
            half = self.norm[at] * (a.error + a.length * self.rest[at, t])
            half += SLACK * (1 + self.norm[at] * (a.length + a.error))
            lo, hi = mid - half, mid + half
            keep = np.zeros(len(at), bool)
            for low, high in windows:
                may = (hi >= low) & (lo <= high)
                sure = lo[(lo >= low) & (hi <= high)]
                if len(sure) > k:
                    may &= hi >= np.partition(sure, len(sure) - k)[len(sure) - k]
                keep |= may
            at, sum_ = at[keep], sum_[keep]
        score = self.v[at] @ a.v  # integers, so exact
        out = []
        for low, high in windows:
            fit = np.flatnonzero((score >= low) & (score <= high))
            best = fit[np.argsort(-score[fit], kind="stable")[:k]]  # positions ascend by id
            out.append(list(zip(self.ids[at[best]].tolist(), score[best].tolist())))
        return out


def score_window(positive: int, low: int = LOW_PERCENT, high: int = HIGH_PERCENT) -> tuple[int, int]:
    """Least and largest integer n with ``low * positive <= 100 * n <= high * positive``."""
    return -(-low * positive // 100), high * positive // 100


def _searcher(k: int, low: int, high: int):
    """Sorted rows of a chunk (anchor null) and then its anchors to what each finds there.

    Anchors without ``scores`` look for rows of their label; others, for each of
    their positives, for rows of other labels inside its window.
    """
    every = (-(1 << 62) * 2, (1 << 63) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, chunk = None, [], None
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                place = (r["dim"], r["chunk"], r["block"])
                if place != key:
                    key, held, chunk = place, [], None
                if r["anchor"] is None:
                    held.append(r)
                    continue
                if chunk is None:
                    if not held:
                        continue
                    chunk, held = Chunk(held), []
                a = Anchor(np.array(r["v"], np.int64))
                other = chunk.ids != r["vec_id"]
                if r["scores"] is None:
                    found = chunk.near(a, np.flatnonzero(other & (chunk.label == r["label"])), [every], k)
                else:
                    windows = [score_window(s, low, high) for s in r["scores"]]
                    found = chunk.near(a, np.flatnonzero(other & (chunk.label != r["label"])), windows, k)
                out += [(r["anchor"], i, v, s) for i, hits in enumerate(found) for v, s in hits]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                      names=["anchor", "slot", "vec_id", "score"])

    return run


def _coder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``dim, vec_id, label, v`` to :data:`CODED`."""
    for b in batches:
        dims = b.column(0).to_numpy()
        for dim in np.unique(dims):
            part = b.filter(pa.array(dims == dim))
            v = part.column(3).flatten().to_numpy().reshape(part.num_rows, dim)
            for lo in range(0, part.num_rows, 1024):
                norm, codes, aligned, rest = encode(v[lo : lo + 1024])
                yield pa.record_batch(
                    [*(c.slice(lo, 1024) for c in part.columns), pa.array(norm), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(list(aligned), pa.list_(pa.float64())), pa.array(rest)],
                    names=["dim", "vec_id", "label", "v", "norm", "codes", "aligned", "rest"],
                )


def integer_vectors(df: DataFrame, id_column: str, vector_column: str, label: Column) -> DataFrame:
    """``dim, vec_id, label, v`` of the rows that take part, each distinct row once."""
    v = F.transform(F.col(vector_column).cast("array<double>"), lambda e: F.floor(e * F.lit(float(SCALE))))
    bad = F.exists(F.col(vector_column).cast("array<double>"), lambda e: e.isNull() | F.isnan(e) | (F.abs(e) * SCALE >= MAX_COMPONENT))
    fit = F.col(id_column).isNotNull() & label.isNotNull() & F.col(vector_column).isNotNull() & ~F.coalesce(bad, F.lit(True))
    return df.filter(fit).select(
        F.size(vector_column).alias("dim"), F.col(id_column).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        v.cast("array<int>").alias("v"),
    ).distinct()


def _visit(rows: DataFrame, anchors: DataFrame, chunks: int, k: int, low: int, high: int) -> DataFrame:
    """``anchor, slot, vec_id, score``: what ``anchors`` find in every chunk of ``rows``."""
    blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    none = lambda kind: F.lit(None).cast(kind)
    asked = anchors.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int").alias("block"),
        "anchor", "scores", "vec_id", "label", "v", none("double").alias("norm"), none("binary").alias("codes"),
        none("array<double>").alias("aligned"), none("double").alias("rest"),
    )
    held = rows.select(
        "dim", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        none("long").alias("anchor"), none("array<long>").alias("scores"), "vec_id", "label", "v", "norm", "codes", "aligned", "rest",
    )
    both = held.unionByName(asked).repartition("dim", "chunk", "block")
    both = both.sortWithinPartitions("dim", "chunk", "block", F.col("anchor").asc_nulls_first())
    return both.mapInArrow(_searcher(k, low, high), "anchor long, slot int, vec_id long, score long")


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` come from :func:`integer_vectors`; ``anchor`` tells which of them are
    anchors.  An anchor's positives are the ``positives`` best other rows of its
    label; for each, the ``negatives`` best rows of other labels are returned whose
    score lies between ``low`` and ``high`` percent of the positive's.  Ties go to
    the smaller id.  Rows that are null, non-finite or without id or label take no
    part (nor do components of 2**15 or more: their scores could leave 64 bits);
    equal rows count once; rows that share the anchor's id are not its partners;
    vectors of different lengths have no score; an anchor without positives, a
    positive without negatives and an empty table give no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    coded = cut(rows.mapInArrow(_coder, CODED), "coded")
    chunks = max(1, -(-coded.count() // CHUNK_ROWS))
    key = F.monotonically_increasing_id().alias("anchor")
    anchors = cut(coded.filter(anchor).select(key, "dim", "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("scores")), "anchors")

    order = [F.col("score").desc(), "vec_id"]
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    best = _visit(coded, anchors, chunks, positives, low, high).withColumn("r", rank).filter(F.col("r") <= positives)
    mine = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("p"))
    paired = cut(anchors.drop("scores").join(mine, "anchor").withColumn("scores", F.col("p.score")), "paired")

    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*order))
    found = _visit(coded, paired, chunks, negatives, low, high).withColumn("rank", rank).filter(F.col("rank") <= negatives)
    named = paired.select("anchor", F.col("vec_id").alias("anchor_id"), "p")
    positive = F.col("p")[F.col("slot")]
    return found.join(named, "anchor").select(
        "anchor_id", positive["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: anchors with ids divisible by 100; ids divisible by 7 carry a wrong label."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(integer_vectors(df, "vec_id", "embedding", label), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER w AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
WHERE 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 10
"""
