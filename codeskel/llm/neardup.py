"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Each text becomes its set of word shingles.  Texts with equal sets form one
   *class*, named by the set's digest, so a group of copies of any size is one
   row from here on.
2. A class signs its set with ``BANDS * ROWS`` minimum hashes.  Classes that agree
   on all rows of a band share a bucket.
3. Buckets propose pairs in rounds.  In a pivot round each bucket names its most
   central class (the one with most bucket mates in all bands, as an original has
   among its copies; then one outside the bucket's largest component) and pairs it
   with the members of other components: one pair per member, never all pairs.
   What is left is settled exactly: the members outside a bucket's largest
   component are compared with all members of other components, signatures only,
   in blocks that stream past each other; only survivors become rows.  Their
   signatures are longer, as many pairs hinge on them.
4. A pair's signatures (a byte of each hash) are compared batch by batch.  After
   each batch the posterior of the similarity, given the agreements so far, bounds
   the chance that it reaches the threshold; pairs below :data:`MISS` are dropped.
   Survivors are verified on their full sets.
5. Verified links give connected components by minimum labels, in rounds of joins.
   Later links are drawn between the labels found so far.

Links, labels and candidates stay distributed; each round's table is written to
the shared folder.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, drop, kept, ship, small_batches

#: Shingle length and similarity of stages on documents; the contract query sets 4.
SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80
#: 40 bands of 6 rows: a pair at similarity 0.8 shares no bucket with chance 5e-6.
BANDS = 40
ROWS = 6
#: Chance, per comparison, with which a true link may be dropped unverified.
MISS = 1e-5
#: Signature positions compared before each decision.
BATCH = 16
PIVOT_ROUNDS = 2
#: Further hashes of the classes that are compared with many others.
MORE = 784
#: Members of a bucket compared with its other members at once.
BLOCK = 256
#: Shingles hashed at once while signing.
CHUNK = 256

_WORD = re.compile(rf"[^{SPACE}]+".encode())
_M32 = (1 << 32) - 1


def _params(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and masks of ``n`` hash functions on 32-bit values."""
    r = np.random.Generator(np.random.PCG64(seed))
    return r.integers(0, _M32, n, np.uint32, endpoint=True) | np.uint32(1), r.integers(0, _M32, n, np.uint32, endpoint=True)


_A, _B = _params(BANDS * ROWS)
_MORE = _params(MORE, 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, remembered up to a bound."""
    import xxhash

    known = kept("word hashes", dict)
    if len(known) > 150_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``k``-word shingles.

    A-Z are lower-cased; a text of fewer than ``k`` words is one shingle; a text
    without words has none.
    """
    h = _hashes(_WORD.findall((text or b"").lower()))
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    out = np.full(n, np.uint64(min(len(h), k)))
    for j in range(min(k, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def signature(s: np.ndarray, params: tuple[np.ndarray, np.ndarray] = (_A, _B)) -> np.ndarray:
    """Minimum hashes of a set, in chunks of bounded size."""
    mul, mask = params
    best = np.full(len(mul), _M32, np.uint32)
    short = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(s), CHUNK):
        x = short[None, i : i + CHUNK] ^ mask[:, None]
        x *= mul[:, None]
        np.minimum(best, x.min(axis=1), out=best)
    return best


@lru_cache
def _prune_limits(width: int) -> tuple[int, ...]:
    """Per batch of a signature of ``width``, the least agreements with which a pair goes on.

    With a uniform prior the posterior after ``m`` agreements of ``n`` is
    Beta(m+1, n-m+1); its tail above the threshold t is the binomial sum
    P(Bin(n+1, t) <= m).  The least m whose tail exceeds MISS is the limit.
    """
    t, out = THRESHOLD_PERCENT / 100, []
    for n in range(BATCH, width + 1, BATCH):
        tail = 0.0
        for m in range(n + 1):
            ways = math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
            tail += math.exp(ways + m * math.log(t) + (n + 1 - m) * math.log(1 - t))
            if tail > MISS:
                out.append(m)
                break
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices stay candidates after every batch."""
    alive = np.arange(len(a))
    agreed = np.zeros(len(a), np.int64)
    for i, least in enumerate(_prune_limits(a.shape[1])):
        cols = slice(i * BATCH, (i + 1) * BATCH)
        if not len(alive):
            break
        agreed[alive] += (a[alive, cols] == b[alive, cols]).sum(axis=1)
        alive = alive[agreed[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Bucket keys of a signature, one per band; the band is part of the key."""
    rows = sig.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return key


def _sign(k: int):
    """Arrow batches of (doc_id, tag, text) to rows with class, set size, signature bytes and bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [shingle_set(t, k) for t in part.column(2).cast(pa.binary()).to_pylist()]
                sigs = [signature(s) if len(s) else None for s in sets]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array([_digest(s) for s in sets], pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([None if g is None else g.astype(np.uint8).tobytes() for g in sigs], pa.binary()),
                     pa.array([None if g is None else band_keys(g).tobytes() for g in sigs], pa.binary())],
                    names=["doc_id", "tag", "cls", "n_shingles", "sig", "bands"],
                )

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (cls, bands) to one row per band: bucket key and class."""
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            part = b.slice(lo, 1024)
            keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
            cls = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))
            yield pa.record_batch([pa.array(keys), cls], names=["bucket", "cls"])


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _long(rows: pa.RecordBatch) -> np.ndarray:
    """Both parts of the signatures of :func:`_cross` rows."""
    return np.concatenate((_matrix(rows.column(5), np.uint8), _matrix(rows.column(7), np.uint8)), axis=1)


def _codes(column: pa.Array) -> np.ndarray:
    """Digests as an array that compares element by element."""
    return np.array(column.to_pylist(), object)


def _more(k: int):
    """Arrow batches of (cls, text) to (cls, further hashes); a text of another class is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                p = b.slice(lo, 128)
                sets = [shingle_set(t, k) for t in p.column(1).cast(pa.binary()).to_pylist()]
                mine = [_digest(s) == c for s, c in zip(sets, p.column(0).to_pylist())]
                sigs = [signature(s, _MORE).astype(np.uint8).tobytes() for s in sets]
                yield pa.record_batch([p.column(0), pa.array(sigs, pa.binary())], names=["cls", "more"]).filter(pa.array(mine, pa.bool_()))

    return run


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rest members against their bucket's members; yields surviving pairs.

    Rows are (bucket, block, side, cls, comp, sig, bands, more), sorted by the first three:
    side 0 is the block, which is held; side 1 streams past.  A pair that shares
    several buckets is reported by the first band alone.
    """
    key, held = None, []
    mine: tuple | None = None
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        bucket, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        side = batch.column(2).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(block) != 0) | (np.diff(side) != 0)) + 1
        edges = sorted({0, rows, *cuts.tolist(), *range(0, rows, 1024)})
        for lo, hi in zip(edges, edges[1:]):
            p = batch.slice(lo, hi - lo)
            if (bucket[lo], block[lo]) != key:
                key, held, mine = (bucket[lo], block[lo]), [], None
            if side[lo] == 0:
                held.append(p)
                mine = None
                continue
            if not held:
                continue
            if mine is None:
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                mine = (t.column(3).to_pylist(), _codes(t.column(4)), _long(t), _matrix(t.column(6), np.uint64))
            cls, comp = p.column(3).to_pylist(), _codes(p.column(4))
            sig, bands = _long(p), _matrix(p.column(6), np.uint64)
            here = np.uint64(int(bucket[lo]) & ((1 << 64) - 1))
            for i, (c, g) in enumerate(zip(mine[0], mine[1])):
                band = np.flatnonzero(mine[3][i] == here)[0]
                other = np.flatnonzero((comp != g) & ((bands == mine[3][i]).argmax(axis=1) == band))
                other = other[survives(np.broadcast_to(mine[2][i], (len(other), sig.shape[1])), sig[other])]
                if len(other):
                    pairs = [(min(c, cls[j]), max(c, cls[j])) for j in other.tolist()]
                    yield pa.record_batch([pa.array(x, pa.binary()) for x in zip(*pairs)], names=["a", "b"])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (a, b, sig_a, sig_b) to the (a, b) that the posterior keeps."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            p = batch.slice(lo, 2048)
            yield p.select([0, 1]).filter(pa.array(survives(_matrix(p.column(2), np.uint8), _matrix(p.column(3), np.uint8))))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (a, b, set_a, set_b) to the (a, b) whose full sets reach the threshold."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            p = batch.slice(lo, 256)
            ok = []
            for x, y in zip(p.column(2).to_pylist(), p.column(3).to_pylist()):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= THRESHOLD_PERCENT * (len(s) + len(t) - both))
            yield p.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _full_sets(k: int):
    """Arrow batches of (cls, text) to (cls, set); a text of another class (a shared id) is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                p = b.slice(lo, 128)
                sets = [shingle_set(t, k) for t in p.column(1).cast(pa.binary()).to_pylist()]
                mine = [_digest(s) == c for s, c in zip(sets, p.column(0).to_pylist())]
                out = pa.record_batch([p.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "words"])
                yield out.filter(pa.array(mine, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """``cls, comp`` for every class in ``links (a, b)``; comp is the component's least class.

    Each round a class takes the least label among itself, its neighbours and its
    label's own label, so chains shrink geometrically.  Labels are aggregated
    map-side, so a class with very many links is no hot task.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = cut(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        up = label.select(F.col("cls").alias("comp"), F.col("comp").alias("up"))
        new = cut(
            label.join(near, "cls").join(up, "comp", "left")
            .select("cls", F.least("comp", "near", "up").alias("comp"), (F.least("near", "up") < F.col("comp")).alias("moved")),
            "labels",
        )
        drop(label)
        label = new
        if label.filter("moved").isEmpty():
            break
    drop(both)
    return label.select("cls", "comp")


class _Linker:
    """Components of the classes of one corpus, from links verified round by round.

    ``docs`` has ``doc_id, text``; ``heads`` has ``cls, doc_id, sig, bands``: each class
    with its signature and a document that shows its set.
    """

    def __init__(self, docs: DataFrame, heads: DataFrame, k: int):
        self.docs, self.heads, self.k = docs, heads, k
        rows = heads.select("cls", "bands").mapInArrow(_buckets, "bucket long, cls binary")
        many = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = cut(rows.join(many, "bucket"), "shared")
        mates = shared.groupBy("cls").agg(F.sum("n").alias("mates"))
        self.buckets = cut(shared.drop("n").join(mates, "cls"), "buckets")
        drop(shared)
        self.label: DataFrame | None = None
        self.tested: DataFrame | None = None

    def _pruned(self, pairs: DataFrame) -> DataFrame:
        """Candidates ``(a, b)`` that their signatures keep, written."""
        sig = self.heads.select("cls", "sig")
        return cut(
            pairs.join(sig.toDF("b", "sb"), "b").join(sig.toDF("a", "sa"), "a").select("a", "b", "sa", "sb")
            .mapInArrow(_prune, "a binary, b binary"),
            "kept",
        )

    def _verified(self, kept: DataFrame) -> DataFrame:
        """Candidates ``(a, b)`` to verified links, written."""
        used = kept.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        sets = cut(
            self._texts(used).mapInArrow(_full_sets(self.k), "cls binary, words binary"),
            "sets",
        )
        out = cut(
            kept.join(sets.toDF("b", "wb"), "b").join(sets.toDF("a", "wa"), "a").select("a", "b", "wa", "wb")
            .mapInArrow(_verify, "a binary, b binary").distinct(),
            "verified",
        )
        drop(sets)
        return out

    def _merge(self, links: DataFrame) -> None:
        """Add links to the labels: each is drawn between the labels of its ends, if they differ."""
        if self.label is None:
            self.label = components(links)
            return
        drawn = (
            links.join(self.label.toDF("a", "ca"), "a", "left").join(self.label.toDF("b", "cb"), "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a != b").distinct()
        )
        up = components(drawn).toDF("comp", "up")
        old = self.label.join(up, "comp", "left").select("cls", F.coalesce("up", "comp").alias("comp"))
        new = up.join(self.label.select(F.col("cls").alias("comp")), "comp", "left_anti").toDF("cls", "comp")
        self.label = cut(old.union(new), "labels")

    def _texts(self, classes: DataFrame) -> DataFrame:
        """``cls, text`` of the documents that show the given classes."""
        shown = self.heads.select("cls", F.col("doc_id").alias("shown")).join(classes, "cls")
        return self.docs.join(shown, F.col("doc_id").eqNullSafe(F.col("shown"))).select("cls", "text")

    def _labelled(self) -> DataFrame:
        """Bucket rows with each class's component so far (itself, if it has no link)."""
        if self.label is None:
            return self.buckets.withColumn("comp", F.col("cls"))
        return self.buckets.join(self.label, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    def _open(self) -> DataFrame:
        """Rows of the buckets that still hold more than one component, written."""
        rows = cut(self._labelled(), "rows")
        mixed = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
        out = cut(rows.join(mixed, "bucket"), "open")
        drop(rows)
        return out

    def _round(self, rows: DataFrame, pairs: DataFrame, pruned: bool = False) -> bool:
        """Test the pairs that no earlier round tested; False if there are none.

        ``pruned`` pairs have passed the comparison of signatures already.
        """
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs")
        drop(rows)
        if pairs.isEmpty():
            return False
        kept = pairs if pruned else self._pruned(pairs)
        self._merge(self._verified(kept))
        if not pruned:
            drop(kept)
        self.tested = pairs if self.tested is None else cut(self.tested.union(pairs), "tested")
        return True

    @staticmethod
    def _main(rows: DataFrame) -> DataFrame:
        """Each bucket's largest component."""
        size = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
        return size.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("m")).select("bucket", F.col("m.comp").alias("main"))

    def run(self) -> DataFrame | None:
        """``cls, comp`` of the classes with links; None if no two classes were compared."""
        for turn in range(PIVOT_ROUNDS):
            rows = self._open()
            if turn:
                rows = rows.join(self._main(rows), "bucket").withColumn("mates", F.when(F.col("comp") == F.col("main"), 0).otherwise(F.col("mates")))
            pivot = rows.groupBy("bucket").agg(F.max(F.struct("mates", "cls", "comp")).alias("p"))
            pivot = pivot.select("bucket", F.col("p.cls").alias("p"), F.col("p.comp").alias("pc"))
            star = rows.join(pivot, "bucket").filter(F.col("comp") != F.col("pc"))
            if not self._round(rows, star.select(F.least("cls", "p").alias("a"), F.greatest("cls", "p").alias("b"))):
                break
        self._settle()
        return self.label

    def _settle(self) -> None:
        """Compare the members outside each bucket's largest component with all of other components."""
        rows = self._open()
        more = cut(self._texts(rows.select("cls").distinct()).mapInArrow(_more(self.k), "cls binary, more binary").dropDuplicates(["cls"]), "more")
        signed = self.heads.select("cls", "sig", "bands").join(more, "cls")
        known = rows.join(self._main(rows), "bucket").join(signed, "cls")
        rest = F.col("comp") != F.col("main")
        blocks = rows.join(self._main(rows), "bucket").filter(rest).groupBy("bucket").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")
        )
        sided = known.join(blocks, "bucket").withColumn(
            "to",
            F.concat(
                F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("block"), F.lit(1).alias("side"))),
                F.when(rest, F.array(F.struct(F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("block"), F.lit(0).alias("side"))))
                .otherwise(F.array().cast("array<struct<block:int,side:int>>")),
            ),
        ).select("bucket", F.explode("to").alias("to"), "cls", "comp", "sig", "bands", "more")
        streams = sided.select("bucket", "to.block", "to.side", "cls", "comp", "sig", "bands", "more").repartition("bucket", "block")
        found = streams.sortWithinPartitions("bucket", "block", "side").mapInArrow(_cross, "a binary, b binary")
        self._round(rows, found, pruned=True)
        drop(more)


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, n_shingles, component_id, kept, tag, group``.

    Documents are linked when 100 * |A and B| >= 80 * |A or B| of their shingle
    sets.  ``component_id`` is the least doc_id of the connected component, the
    document's own id included; ``kept`` tells whether it is its own; ``tag``
    (MD5 of the text) tells rows with equal ids apart; ``group`` names the connected
    component (null without words).  Null and wordless texts
    have no shingles and are linked with nothing; rows with equal ids are judged
    by their texts; a null id is its component only if nothing else is; an empty
    table gives no rows.
    """
    ship(docs.sparkSession)
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, k)


def _near_duplicates(docs: DataFrame, k: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tagged = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tag"), "text")
    rows = cut(tagged.mapInArrow(_sign(k), "doc_id long, tag string, cls binary, n_shingles long, sig binary, bands binary"), "signed")
    heads = cut(
        rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
        .join(rows.select(F.col("cls").alias("c"), F.col("doc_id").alias("d"), "sig", "bands"), (F.col("cls") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d")))
        .select("cls", "doc_id", "sig", "bands").dropDuplicates(["cls"]),
        "heads",
    )
    label = _Linker(docs, heads, k).run()
    first = heads.select("cls", F.col("doc_id").alias("first"), F.col("cls").alias("group"))
    if label is not None:
        label = label.join(first.drop("group"), "cls")
        least = label.groupBy("comp").agg(F.min("first").alias("least"))
        first = first.join(label.join(least, "comp").select("cls", "least", "comp"), "cls", "left").select(
            "cls", F.coalesce("least", "first").alias("first"), F.coalesce("comp", "group").alias("group")
        )
    first = cut(first, "first")
    return rows.select("doc_id", "tag", "cls", "n_shingles").join(first, "cls", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("first", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("first", "doc_id")).alias("kept"),
        "tag",
        "group",
    )


def keep_one(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; all columns stay.

    The kept row is that of the least id, of equal or no ids that of the least text
    digest, and of repeated rows any one.  Different groups that share an id each
    keep a row.  Documents without words form no groups: each is kept, repeated rows once.
    """
    rows = near_duplicates(docs.select("doc_id", "text"), k).select("group", F.col("doc_id").alias("_k_id"), F.col("tag").alias("_k_tag"))
    least = F.min(F.struct(F.col("_k_id").isNull(), "_k_id", "_k_tag")).alias("m")
    first = rows.filter("group is not null").groupBy("group").agg(least).select("m._k_id", "m._k_tag")
    wordless = rows.filter("group is null").select("_k_id", "_k_tag").distinct()
    tag = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    joined = docs.withColumn("_tag", tag).join(
        first.union(wordless), F.col("doc_id").eqNullSafe(F.col("_k_id")) & (F.col("_tag") == F.col("_k_tag"))
    )
    return joined.dropDuplicates(["doc_id", "_tag"]).select(*docs.columns)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: four-word shingles over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4).drop("tag", "group")
