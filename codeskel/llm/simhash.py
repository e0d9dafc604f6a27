"""SimHash near-duplicates by multi-index hashing.

1. A text's fingerprint has the bits that more than half of its shingles' 64-bit
   hashes have.  Texts with equal fingerprints are one *node* from here on, so a
   group of copies of any size is one row.
2. Fingerprints are cut into ``m`` segments.  Two that differ in at most
   :data:`RADIUS` bits differ in few bits of some segment: with
   ``RADIUS = m * s + a``, in at most ``s`` bits of one of the first ``a + 1``
   segments or in at most ``s - 1`` of one of the others.  So each fingerprint
   enters one bucket per segment (its value) and probes the values of the small
   Hamming ball around it.  As a pair is found when either side probes, only
   values above the own are probed.
3. Members of a bucket compare all 64 bits.  A task keeps a spanning forest of
   what it links, never all pairs.  A bucket of more than :data:`BLOCK` rows is
   dealt in blocks: every two blocks meet in a cell of their own.
4. The forests' edges give connected components by minimum labels.

The number of segments follows the number of distinct fingerprints (segments of
about log2(n) bits keep buckets small); every choice finds exactly the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship
from .neardup import components

BITS = 64
#: Differing bits up to which two fingerprints link.
RADIUS = 4
#: Shingle length of stages on documents; the contract query sets 4.
SHINGLE_WORDS = 5
SEED = 42
#: Rows of a bucket that one block holds.
BLOCK = 2048
#: Cells of at most so many rows are compared together, by shifts.
SMALL_CELL = 32
#: Rows of small cells that are compared at once.
CHUNK_ROWS = 1 << 17
#: Rows with one fingerprint that one task joins.
HOT_ROWS = 1000
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: bytes | None, k: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a UTF-8 text over its ``k``-word shingles, repeats included.

    A-Z are lower-cased, words part at ASCII white space, a shingle is its words
    joined by blanks.  A text of fewer words is one shingle; one without words
    (null, empty, blank) has fingerprint zero.
    """
    from xxhash import xxh64_intdigest as digest

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - k + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    stops = ends[k - 1 :] if len(words) >= k else ends[-1:]
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, CHUNK):
        spans = zip(starts[lo : lo + CHUNK].tolist(), stops[lo : lo + CHUNK].tolist())
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, min(CHUNK, n - lo))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, k) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


def segments_for(n: int) -> int:
    """Segments for ``n`` distinct fingerprints: their width is near log2(n)."""
    return int(np.clip(round(BITS / max(16, int(n).bit_length())), 2, RADIUS))


def segment_plan(m: int) -> list[tuple[int, int, int]]:
    """``(shift, width, radius)`` of each of ``m`` segments; radius -1 cannot occur for m <= RADIUS + 1."""
    s, a = divmod(RADIUS, m)
    edges = [BITS * i // m for i in range(m + 1)]
    return [(lo, hi - lo, s if i <= a else s - 1) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]


def _ball(width: int, radius: int) -> np.ndarray:
    """Masks of 0 to ``radius`` set bits."""
    sets = [c for r in range(radius + 1) for c in combinations(range(width), r)]
    return np.array([sum(1 << b for b in c) for c in sets], np.uint64)


def _probes(m: int):
    plan = [(i, np.uint64(lo), np.uint64((1 << w) - 1), _ball(w, r)) for i, (lo, w, r) in enumerate(segment_plan(m))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(whole), 8192):
                fp = whole[lo : lo + 8192]
                for i, shift, mask, ball in plan:
                    own = (fp >> shift) & mask
                    value = own[:, None] ^ ball[None, :]
                    used = value >= own[:, None]
                    bucket = (value[used].astype(np.int64)) | (i << 32)
                    out = np.repeat(fp, used.sum(axis=1))
                    yield pa.record_batch([pa.array(bucket), pa.array(out.view(np.int64))], names=["bucket", "fp"])

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's component."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= RADIUS


def _small_pairs(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked positions among rows of equal ``cell`` (ascending)."""
    found = []
    at = np.arange(len(cell))
    for d in range(1, SMALL_CELL):
        at = at[at + d < len(cell)]
        at = at[cell[at] == cell[at + d]]
        if not len(at):
            break
        hit = at[_close(fp[at], fp[at + d])]
        found.append((hit, hit + d))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def _forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, breadth first.

    Each node compares itself once with those not reached yet, so a dense group
    costs about one pass.
    """
    left = np.arange(len(fp))
    queue: list[np.ndarray] = []
    edges = []
    while len(left):
        if not queue:
            queue.append(left[:1])
            left = left[1:]
        front = queue.pop()
        for lo in range(0, len(front), 64):
            part = front[lo : lo + 64]
            close = _close(fp[part][:, None], fp[left][None, :])
            hit = close.any(axis=0)
            if hit.any():
                new = left[hit]
                edges.append((part[close[:, hit].argmax(axis=0)], new))
                queue.append(new)
                left = left[~hit]
    return tuple(np.concatenate([e[i] for e in edges]) if edges else np.zeros(0, np.int64) for i in (0, 1))


def _edges(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links between positions as a star around each component's first fingerprint."""
    if len(a):
        nodes, code = np.unique(fp[np.concatenate((a, b))], return_inverse=True)
        root = _roots(len(nodes), code[: len(a)], code[len(a) :])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.record_batch([pa.array(nodes[root[moved]].view(np.int64)), pa.array(nodes[moved].view(np.int64))], names=["a", "b"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell ``(bucket, i, j)`` to links ``(a, b)``; holds one cell or one chunk of small ones."""
    held: list[np.ndarray] = []

    def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, rows.shape[1]))
        cell, fp = np.cumsum(new), rows[3].view(np.uint64)
        few = np.repeat((size > 1) & (size <= SMALL_CELL), size)
        yield from _edges(fp[few], *_small_pairs(cell[few], fp[few]))
        for i in np.flatnonzero(size > SMALL_CELL):
            one = np.unique(fp[first[i] : first[i] + size[i]])
            yield from _edges(one, *_forest(one))

    for b in batches:
        held.append(np.stack([b.column(i).to_numpy().astype(np.int64, copy=False) for i in range(4)]))
        if sum(h.shape[1] for h in held) >= CHUNK_ROWS:
            rows = np.concatenate(held, axis=1)
            last = int((rows[:3] == rows[:3, -1:]).all(axis=0).argmax())  # where the cell that may go on begins
            held = [rows[:, last:]]
            if last:
                yield from settle(rows[:, :last])
    if held and sum(h.shape[1] for h in held):
        yield from settle(np.concatenate(held, axis=1))


def links(nodes: DataFrame, m: int | None = None, block: int = BLOCK) -> DataFrame:
    """``a, b``: edges that connect all fingerprints ``nodes (fp)`` within :data:`RADIUS` bits, written."""
    ship(nodes.sparkSession)
    m = m or segments_for(nodes.count())
    rows = nodes.select("fp").mapInArrow(_probes(m), "bucket long, fp long")
    size = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    size = cut(size.select("bucket", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("parts")), "sizes")
    large = size.filter("parts > 1")  # at most rows / block of them
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    cells = (
        rows.join(large, "bucket", "left")
        .select("bucket", F.explode(F.when(F.col("parts") > 1, meet).otherwise(one)).alias("c"), "fp")
        .select("bucket", "c.i", "c.j", "fp")
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
    )
    return cut(cells.mapInArrow(_link, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, fingerprint, component_id``.

    ``fingerprint`` is 16 hexadecimal digits.  Documents whose fingerprints differ
    in at most :data:`RADIUS` bits are linked; ``component_id`` is the least doc_id
    that links reach, the own included.  Texts without words (null, empty, blank)
    have fingerprint zero and are linked like any other; rows with equal ids are
    judged by their texts; a null id has a null component only if nothing else is
    linked with it; repeated rows appear each; an empty table gives no rows; other
    columns are not read.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = cut(texts.mapInArrow(_fingerprints(k), "doc_id long, fp long"), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    label = components(links(nodes)).toDF("fp", "comp")
    least = label.join(nodes.select("fp", "first"), "fp").groupBy("comp").agg(F.min("first").alias("least"))
    known = nodes.join(label.join(least, "comp").select("fp", "least"), "fp", "left").select(
        "fp", F.coalesce("least", "first").alias("component_id"), F.ceil(F.col("n") / F.lit(HOT_ROWS)).cast("int").alias("parts")
    )
    known = cut(known, "known")
    # rows of a frequent fingerprint are dealt over copies of its one known row
    hot = known.filter("parts > 1").select("fp", F.col("parts").alias("hot"))
    dealt = rows.withColumn("nr", F.monotonically_increasing_id()).join(hot, "fp", "left")
    dealt = dealt.withColumn("salt", F.pmod(F.col("nr"), F.coalesce("hot", F.lit(1)).cast("long")).cast("int"))
    spread = known.select("fp", "component_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    return dealt.join(spread, ["fp", "salt"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: four-word shingles over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4)
