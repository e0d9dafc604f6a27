"""Cross-tokenizer alignment by inverted pair bitmaps.

Two tokenizers cut the same bytes.  Offsets where both end a token cut a text into
groups; two tokens are *linked* where their byte ranges overlap.

1. A task tokenizes its documents, numbers them within blocks of at most
   :data:`BLOCK_DOCS` and inverts them: per pair of linked ids, a compressed bitmap
   of the block's documents that hold the pair (plane 0), and bitmaps of the binary
   digits of how often beyond once (planes 1, 2, ...).  Sets are kept as sorted
   16-bit positions or, where that is smaller, as plain bits.
2. Bitmaps of one pair, block and plane are OR-merged.  Their popcounts are the
   pair's document count (plane 0) and, weighted by the planes' digits, its link
   count.
3. Each pair gets its score: the link count, and whether no other pair with the same
   second id has more.
4. The postings return the scores: a block's bitmaps, with the scores of their
   pairs, are added up into the block's documents.

No key gathers the corpus: a pair that every document holds has one bitmap per block.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship

#: Documents of a block (positions are 16 bits wide), and links after which it ends early.
BLOCK_DOCS = 1 << 16
BLOCK_LINKS = 8_000_000
#: Links that a task holds before it writes their bitmaps.
HELD_LINKS = 1_500_000
#: Words that a worker remembers (twice: those seen since the last turnover, and before).
MEMORY = 250_000
#: From so many members on, a set is stored as bits.
DENSE = BLOCK_DOCS // 16
_PAIR_SHIFT = 20

DOC_COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
POSTING_COLUMNS = "pair long, plane int, ones long, bits binary"
INVERTED = f"block long, pos int, {DOC_COLUMNS}, {POSTING_COLUMNS}"
STATS = "pair long, n_docs long, n_links long"

#: A text may be cut before a blank or line feed between two characters that are not white space,
#: and after such a line feed.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")
_WHITE = re.compile(r"\s")
#: A word whose letters end before other characters that are not white space.
_TAIL = re.compile(r"( ?[^\W\d_]+)([^\w\s]\S*)")
#: How a byte-level vocabulary's tokenizer cuts a text before it merges.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = "", np.zeros(0, np.int64), 0, 0, 0


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes, in order,
    for the characters from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_level_encoder(path: str):
    """``(encode, bytes of each id)`` of a byte-level BPE file; special tokens in a text are plain text.

    Where the file is plain byte-level BPE whose merges are ranked by their ids, the
    same merges run several times faster as a rank table.
    """
    chars = byte_of_char()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    special = {t["id"] for t in spec.get("added_tokens") or []}
    of_id = {i: bytes(chars[c] for c in s) for s, i in vocab.items() if i not in special and all(c in chars for c in s)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    first = len(vocab) - len(merges) - sum(i in special for i in vocab.values())
    cuts = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges") and v}
    if spec.get("pre_tokenizer") == cuts and not spec.get("normalizer") and model == {"type": "BPE"} and all(
        vocab.get(x + y) == first + i for i, (x, y) in enumerate(merges)
    ):
        import tiktoken

        ranked = tiktoken.Encoding("pair", pat_str=_BYTE_LEVEL, mergeable_ranks={v: i for i, v in of_id.items()}, special_tokens={})
        return ranked.encode_ordinary, of_id
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return (lambda text: tok.encode(text, add_special_tokens=False).ids), of_id


class TokenizerPair:
    """Both tokenizers with the bytes of their ids, and a bounded memory of aligned words.

    Neither joins characters across a cut of :data:`_CUT`, nor between letters and
    other marks where no piece holds the two characters side by side (both checked
    on the second's vocabulary), so a text's alignment is that of its units in order.
    """

    def __init__(self, a_path: str, b_path: str, memory: int = MEMORY):
        from sentencepiece import SentencePieceProcessor

        self.a, self.a_bytes = byte_level_encoder(a_path)
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_len, self.b_len = {i: len(x) for i, x in self.a_bytes.items()}, [len(x) for x in self.b_bytes]
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.together = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.limit = memory
        # words without the blank before them, and other units as they are
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.tails: dict[str, tuple] = {}

    def _ids_b(self, text: str) -> list[int]:
        """Ids of ``text``, which follows others unless it begins with a blank (the one that the tokenizer adds)."""
        if text.startswith(" "):
            return self.b.encode(text[1:], num_threads=1) if len(text) > 1 else []
        return self.b.encode("\n" + text, num_threads=1)[2:]  # nothing merges with the line feed before it

    def align(self, text: str) -> tuple[bytes, bytes, int, int] | None:
        """Groups, linked pairs (64-bit integers) and numbers of ids; None if the bytes differ."""
        raw = text.encode()
        a, b = self.a(text), self._ids_b(text)
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        groups, pairs = [], array("q")
        i = j = i0 = j0 = end_a = end_b = 0
        a_len, b_len, n_a, n_b = self.a_len, self.b_len, len(a), len(b)
        while i < n_a or j < n_b:
            # take the token that ends first; the one it lies in is the other side's current token
            if end_a == end_b:
                if i > i0:
                    groups.append((i0, i, j0, j))
                i0, j0 = i, j
                end_a, end_b = end_a + a_len[a[i]], end_b + b_len[b[j]]
                i, j = i + 1, j + 1
            elif end_a < end_b:
                end_a += a_len[a[i]]
                i += 1
            else:
                end_b += b_len[b[j]]
                j += 1
            pairs.append(a[i - 1] << _PAIR_SHIFT | b[j - 1])
        if i > i0:
            groups.append((i0, i, j0, j))
        a, b = [str(x) for x in a], [str(x) for x in b]
        said = ";".join([f"{','.join(a[p:q])}|{','.join(b[r:s])}" for p, q, r, s in groups])
        return said.encode(), pairs.tobytes(), n_a, n_b

    def _tail(self, unit: str) -> tuple | None:
        """A unit that begins with marks or a line feed."""
        got = self.tails.get(unit)
        if got is None:
            got = self.align(unit)
            if got and len(unit) <= 8:
                if len(self.tails) >= self.limit:
                    self.tails.clear()
                self.tails[unit] = got
        return got

    def _word(self, word: str) -> tuple | None:
        """A blank and a word without white space in it."""
        got = self.new.get(word)
        if got:
            return got
        got = self.old.get(word)
        if not got:
            parts = _TAIL.fullmatch(word)
            if parts and parts[1][-1] + parts[2][0] not in self.together:
                return _joined([self._word(parts[1]), self._tail(parts[2])])
            got = self.align(" " + word)
        if got and len(word) <= 64:
            if len(self.new) >= self.limit:
                self.old, self.new = self.new, {}
            self.new[word] = got
        return got

    def _unit(self, unit: str) -> tuple | None:
        if unit[0] == " " and not _WHITE.search(unit, 1):
            return self._word(unit[1:])
        return self._tail(unit)

    def _known(self, word: str) -> tuple | None | bool:
        """The word's alignment; False where it tells that the text's blanks do not part its words."""
        if not _WHITE.search(word):
            return self._word(word) if word else False
        if word[0].isspace() or word[-1].isspace():
            return False
        return _joined([self._unit(u) for u in _CUT.split(" " + word)])

    def document(self, text: str | None) -> tuple[str, np.ndarray, int, int, int]:
        """``groups_sha256``, links as pairs, ``n_a``, ``n_b``, ``n_groups`` of a whole text."""
        if not text:
            return _NONE
        if self.cuts:
            get, known = self.new.get, self._known
            got = [get(w) or known(w) for w in text.split(" ")]
            if False in got:
                got = [self._unit(u) for u in _CUT.split(" " + text)]
        else:
            got = [self.align(" " + text)]
        if None in got:  # bytes that one tokenizer does not give back
            return _NONE
        groups, pairs, n_a, n_b = zip(*got)
        said = b";".join(groups)
        return hashlib.sha256(said).hexdigest(), np.frombuffer(b"".join(pairs), np.int64), sum(n_a), sum(n_b), said.count(b"|")


def _joined(parts: list[tuple | None]) -> tuple | None:
    if None in parts:
        return None
    groups, pairs, n_a, n_b = zip(*parts)
    return b";".join(groups), b"".join(pairs), sum(n_a), sum(n_b)


_pairs: dict[tuple[str, str], TokenizerPair] = {}


def tokenizer_pair(a_path: str, b_path: str) -> TokenizerPair:
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = TokenizerPair(a_path, b_path)
    return _pairs[a_path, b_path]


def planes_of(count: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(plane, mask)``: plane 0 for every count, plane i + 1 where ``count - 1`` has binary digit i."""
    yield 0, np.ones(len(count), bool)
    more, i = count - 1, 0
    while (more >> i).any():
        mask = (more >> i & 1).astype(bool)
        if mask.any():
            yield i + 1, mask
        i += 1


def weight(plane: int) -> int:
    return 1 << max(plane - 1, 0)


def compress(pos: np.ndarray) -> bytes:
    """Ascending distinct positions as 16-bit numbers, or as bits from :data:`DENSE` members on."""
    if len(pos) < DENSE:
        return pos.astype("<u2").tobytes()
    bits = np.zeros(BLOCK_DOCS, np.uint8)
    bits[pos] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def positions(bits: bytes) -> np.ndarray:
    if len(bits) < BLOCK_DOCS // 8:
        return np.frombuffer(bits, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))


def merge(parts: list[bytes]) -> tuple[int, bytes]:
    """Popcount and OR of sets."""
    if len(parts) == 1:
        one = parts[0]
        return (len(one) // 2 if len(one) < BLOCK_DOCS // 8 else int(np.bitwise_count(np.frombuffer(one, np.uint8)).sum())), one
    both = np.unique(np.concatenate([positions(p) for p in parts]))
    return len(both), compress(both)


def _batch(rows: int, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in INVERTED.split(", ")]
    return pa.record_batch([columns[n] if n in columns else pa.nulls(rows, kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def postings(pair: np.ndarray, pos: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """Links ``(pair, pos)`` of some documents of a block to its bitmaps."""
    order = np.lexsort((pos, pair))
    pair, pos = pair[order], pos[order]
    first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (pos[1:] != pos[:-1]))))
    pair, pos, count = pair[first], pos[first], np.diff(np.append(first, len(pair)))
    for plane, mask in planes_of(count):
        p, at = pair[mask], pos[mask]
        start = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        ones = np.diff(np.append(start, len(p)))
        for lo in range(0, len(start), 8192):
            part = slice(lo, lo + 8192)
            bits = [compress(at[s : s + n]) for s, n in zip(start[part].tolist(), ones[part].tolist())]
            k = len(bits)
            yield _batch(
                k, block=pa.array(np.full(k, block)), pair=pa.array(p[start[part]]), plane=pa.array(np.full(k, plane, np.int32)),
                ones=pa.array(ones[part].astype(np.int64)), bits=pa.array(bits, pa.binary()),
            )


def _invert(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = tokenizer_pair(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        pos = held = links = 0
        pairs: list[np.ndarray] = []
        at: list[np.ndarray] = []

        def write() -> Iterator[pa.RecordBatch]:
            if pairs:
                yield from postings(np.concatenate(pairs), np.concatenate(at), block)
            pairs.clear()
            at.clear()

        for b in batches:
            docs = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if pos == BLOCK_DOCS or links >= BLOCK_LINKS:
                    yield from write()
                    block, pos, held, links = block + 1, 0, 0, 0
                sha, found, n_a, n_b, n_groups = two.document(text)
                docs.append((block, pos, doc_id, n_a, n_b, n_groups, len(found), sha))
                if len(found):
                    pairs.append(found)
                    at.append(np.full(len(found), pos, np.uint16))
                pos, held, links = pos + 1, held + len(found), links + len(found)
                if held >= HELD_LINKS:
                    yield from write()
                    held = 0
            if docs:
                names = ["block", "pos", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string()]
                yield _batch(len(docs), **{n: pa.array(c, k) for n, c, k in zip(names, zip(*docs), kinds)})
        yield from write()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps sorted by ``(pair, block, plane)`` to :data:`STATS`; holds those of one pair, block and plane."""
    key, parts = None, []
    docs = links = 0
    out: list[tuple] = []
    for b in batches:
        for k in zip(*(b.column(i).to_pylist() for i in range(4))):
            if k[:3] != key:
                if parts:
                    ones, _ = merge(parts)
                    docs, links = docs + (ones if key[2] == 0 else 0), links + ones * weight(key[2])
                if key and key[0] != k[0]:
                    out.append((key[0], docs, links))
                    docs = links = 0
                key, parts = k[:3], []
            parts.append(k[3])
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["pair", "n_docs", "n_links"])
            out = []
    if key:
        ones, _ = merge(parts)
        last = (key[0], docs + (ones if key[2] == 0 else 0), links + ones * weight(key[2]))
        yield pa.record_batch([pa.array([x], pa.int64()) for x in last], names=["pair", "n_docs", "n_links"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by block, documents first: scored bitmaps added into their documents."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    block, docs = None, []
    best, total = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)

    def close() -> Iterator[pa.RecordBatch]:
        if docs:
            rows = pa.Table.from_batches(docs)
            at = rows.column("pos").to_numpy()
            scores = {"n_best": pa.array(best[at]), "count_sum": pa.array(total[at])}
            for b in pa.table([scores.get(n, rows.column(n) if n not in scores else None) for n in names], names=names).to_batches():
                yield b
        docs.clear()
        best.fill(0)
        total.fill(0)

    def add(rows: pa.RecordBatch) -> None:
        bits = rows.column("bits")
        size = np.diff(np.frombuffer(bits.buffers()[1], np.int32, len(bits) + 1, bits.offset * 4))
        w = np.left_shift(1, np.maximum(rows.column("plane").to_numpy().astype(np.int64) - 1, 0))
        score, top = w * rows.column("score").to_numpy(), w * rows.column("best").to_numpy()
        dense = size == BLOCK_DOCS // 8
        few = bits.filter(pa.array(~dense))
        if len(few):
            off = np.frombuffer(few.buffers()[1], np.int32, len(few) + 1, few.offset * 4)
            at = np.frombuffer(few.buffers()[2], np.uint8)[off[0] : off[-1]].view("<u2").astype(np.int64)
            n = size[~dense] // 2
            np.add.at(total, at, np.repeat(score[~dense], n))
            np.add.at(best, at, np.repeat(top[~dense], n))
        for i in np.flatnonzero(dense).tolist():
            at = positions(bits[i].as_py())
            total[at] += score[i]
            best[at] += top[i]

    for b in batches:
        blocks = b.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
        for lo, hi in zip(edges, edges[1:]):
            if blocks[lo] != block:
                yield from close()
                block = blocks[lo]
            part = b.slice(lo, hi - lo)
            is_doc = part.column("pair").is_null()
            if is_doc.true_count:
                docs.append(part.filter(is_doc))
            if is_doc.false_count:
                add(part.filter(part.column("pair").is_valid()))
    yield from close()


def invert(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The written index of ``docs (doc_id, text)``: rows of documents (pair null) and of bitmaps."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(_invert(a_path, b_path), INVERTED), "inverted")


def pair_counts(index: DataFrame) -> DataFrame:
    """``pair, n_docs, n_links`` of every linked pair, from its OR-merged bitmaps, written."""
    rows = index.filter("pair is not null").select("pair", "block", "plane", "bits").repartition("pair")
    return cut(rows.sortWithinPartitions("pair", "block", "plane").mapInArrow(_count, STATS), "pairs")


def scored(counts: DataFrame) -> DataFrame:
    """``pair, score, best``: the link count, and 1 where it is the highest of the pair's second id."""
    second = F.col("pair").bitwiseAND((1 << _PAIR_SHIFT) - 1)
    top = counts.groupBy(second.alias("id")).agg(F.max("n_links").alias("top"))
    return counts.join(top, second == F.col("id")).select("pair", F.col("n_links").alias("score"), (F.col("n_links") == F.col("top")).cast("long").alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of ``docs (doc_id, text)`` its alignment and the scores of its links.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``; the
    first tokenizer is byte-level BPE and reads a blank before the text, the second
    adds it.  Texts that are null or empty, or that a tokenizer does not give back
    byte by byte, have no tokens: zeros and an empty digest.  Repeated rows and rows
    with equal or null ids are documents of their own; ties for the best count all
    count; other columns are not read; an empty table gives no rows.
    """
    index = invert(docs, a_path, b_path)
    scores = scored(pair_counts(index))
    none = lambda kind: F.lit(None).cast(kind)
    told = [c.split()[0] for c in DOC_COLUMNS.split(", ")]
    back = index.filter("pair is not null").select("pair", "block", "plane", "bits").join(scores, "pair")
    back = back.select("block", none("int").alias("pos"), *(none(c.split()[1]).alias(c.split()[0]) for c in DOC_COLUMNS.split(", ")),
                       "pair", "plane", "bits", "score", "best")
    heads = index.filter("pair is null").select(
        "block", "pos", *told, none("long").alias("pair"), none("int").alias("plane"), none("binary").alias("bits"),
        none("long").alias("score"), none("long").alias("best"),
    )
    both = heads.unionByName(back).repartition("block").sortWithinPartitions("block", F.col("pair").isNotNull())
    return both.mapInArrow(
        _add_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: byte-level BPE against pieces with byte fallback, over all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
