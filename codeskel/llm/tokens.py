"""Token-ID output: fixed-width bit packing with block offsets.

Format.  A corpus is a Parquet table with one row per *block* of consecutive
whole documents, in ascending document order:

    shard int        number of the writing task, ascending with doc_id
    block int        number inside the shard
    first long       ids of the shard before this block (the block offset)
    n_ids long       ids in this block
    bits int         width of one id: the bits that the vocabulary needs
    doc_ids          the block's documents
    doc_lens         and their numbers of ids
    payload binary   the ids, ``bits`` bits each, lowest bit first, one after another

An id starts at bit ``i * bits``, so any range of ids is cut out without reading
what precedes it, and a block unpacks with a handful of numpy operations.
Spark's Parquet writer commits the files task by task, so a lost executor only
repeats its unfinished tasks.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, kept, ship, small_batches

END_ID = 1
#: Ids after which a block is closed (a longer document has a block of its own).
BLOCK_IDS = 1 << 16
#: Distinct words of one generation of a worker's memory (about 200 bytes each; there are two).
CACHE_WORDS = 300_000
#: Text bytes that are tokenized at once.
BATCH_BYTES = 4 << 20

BLOCK_SCHEMA = (
    "shard int, block int, first long, n_ids long, bits int, doc_ids array<long>, doc_lens array<long>, payload binary"
)
INDEX_SCHEMA = "shard int, block int, pos int, doc_id long, at long, n_tokens long, ids_crc32 long"


def bit_width(n_vocab: int) -> int:
    """Bits that hold every id below ``n_vocab``."""
    return max(1, int(n_vocab - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive ``bits``-bit little-endian fields."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 8:
        return ids.astype("u1").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from field ``start`` on, as uint32; reads only the bytes that hold them."""
    if count <= 0:
        return np.zeros(0, np.uint32)
    if bits in (8, 16):
        kind = "<u2" if bits == 16 else "u1"
        return np.frombuffer(payload, kind, count, start * bits // 8).astype(np.uint32)
    lo = start * bits
    raw = np.frombuffer(payload, np.uint8, offset=lo // 8, count=-(-(lo + count * bits) // 8) - lo // 8)
    flat = np.unpackbits(raw, bitorder="little")[lo % 8 : lo % 8 + count * bits].reshape(count, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


#: ASCII letters before ASCII marks: the tokenizer parts them, too.
_TAILED = re.compile(rb"([a-z]+)([!-/:-@\[-`{-~].*)", re.DOTALL)
#: Plain words that are encoded in one text.
_JOINED = 64


class _Memory:
    """Words with their ids, laid end to end."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}
        self.start = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def add(self, words: list[bytes], counts: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.seen)
        while first + len(words) > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[first : first + len(words)] = counts
        self.start[first : first + len(words)] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.seen.update(zip(words, range(first, first + len(words))))

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words numbered ``at``, and each word's count."""
        counts = self.length[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[at] - (ends - counts), counts) + np.arange(total)], counts


class WordEncoder:
    """Encodes texts word by word through a bounded memory of words already seen.

    The tokenizer drops white space and never joins characters across it, lower-
    cases its input and treats every word on its own, so a text's ids are its
    words' ids in order.  Only new words reach the tokenizer, many in one call:
    plain ones (lower-case letters) are one piece each, whose last id ends a piece;
    the others are told apart by the offsets that it returns.

    The memory has two generations: when the young one is full it becomes the old
    one, and words found there move on, so frequent words are learned once.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.limit = cache_words
        self.n_vocab = self.tok.get_vocab_size()
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.bare = self._bare(path)
        self.young, self.old = _Memory(), _Memory()

    def _bare(self, path: str):
        """The same model without the steps that leave plain words as they are; None if the file has other steps."""
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(self.tok.to_str())
        normal, cuts = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        if (
            {n["type"] for n in normal.get("normalizers", [])} != {"NFC", "Replace", "Lowercase"}
            or [c["type"] for c in cuts.get("pretokenizers", [])] != ["Split", "ByteLevel"]
            or spec["model"].get("end_of_word_suffix") != "</w>"
        ):
            return None
        bare = Tokenizer.from_file(path)
        bare.normalizer = None
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), level])
        return bare

    def _plain(self, word: bytes) -> bool:
        """Lower-case letters that the tokenizer leaves as they are: one piece."""
        if word.isascii():
            return word.isalpha() and word.islower()
        text = word.decode("utf-8")
        return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)

    def _learn_plain(self, words: list[bytes]) -> None:
        texts = [b" ".join(words[i : i + _JOINED]).decode("utf-8") for i in range(0, len(words), _JOINED)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)])
        counts = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(counts) != len(words):  # a vocabulary whose pieces end otherwise
            self._learn(words)
        else:
            self.young.add(words, counts, ids)

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8") for w in words]
        enc = self.tok.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(enc.ids, np.uint32)
        begins = np.fromiter((o[0] for o in enc.offsets), np.int64, len(ids))
        edges = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.young.add(words, np.diff(np.searchsorted(begins, edges)), ids)

    def _know(self, new: set[bytes]) -> None:
        """Take words that the young generation does not know from the old one, or learn them."""
        before = self.old.seen
        known = [w for w in new if w in before]
        if known:
            ids, counts = self.old.ids(np.fromiter((before[w] for w in known), np.int64, len(known)))
            self.young.add(known, counts, ids)
        fresh = [w for w in new if w not in before] if known else list(new)
        plain = [w for w in fresh if self._plain(w)] if self.bare else []
        if plain:
            self._learn_plain(plain)
        taken = set(plain)
        other = [w for w in fresh if w not in taken]
        if other:
            self._learn(other)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 texts to all their ids, :data:`END_ID` after each, and each text's count."""
        # bytes methods: ASCII letters and ASCII white space only; special tokens match before lower-casing
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.young.seen) > self.limit:
            self.old, self.young = self.young, _Memory()
        seen = self.young.seen
        new = set().union(*split).difference(seen)
        tailed = [m for m in map(_TAILED.fullmatch, new) if m]
        new.difference_update(m[0] for m in tailed)
        new.update(p for m in tailed for p in m.groups() if p not in seen)
        self._know(new)
        if tailed:
            pairs = np.fromiter((seen[p] for m in tailed for p in m.groups()), np.int64, 2 * len(tailed))
            ids, counts = self.young.ids(pairs)
            self.young.add([m[0] for m in tailed], counts.reshape(-1, 2).sum(axis=1), ids)
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        numbers = map(seen.__getitem__, chain.from_iterable(split))
        body, lens = self.young.ids(np.fromiter(numbers, np.int64, int(n_words.sum())))
        at = np.concatenate(([0], np.cumsum(lens)))[np.cumsum(n_words)]  # ids of this and all earlier texts
        return np.insert(body, at, END_ID).astype(np.uint32), np.diff(at, prepend=0) + 1


def encoder(path: str) -> WordEncoder:
    return kept(("encoder", path), lambda: WordEncoder(path))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of (doc_ids, texts) of about BATCH_BYTES."""
    for b in batches:
        ids = b.column(0).to_pylist()
        texts = b.column(1)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(ids)] if len(ids) else [0]
        for lo, hi in zip(cuts, cuts[1:]):
            yield ids[lo:hi], [t or b"" for t in texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]


def _packer(path: str):
    schema = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()),
         ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("payload", pa.binary())]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        bits = bit_width(max(enc.n_vocab, END_ID + 1))
        shard = TaskContext.get().partitionId()
        block, first = 0, 0
        docs: list = []
        lens: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def close():
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            return pa.record_batch(
                [[shard], [block], [first], [len(ids)], [bits], [docs], [lens], [pack_ids(ids, bits)]], schema=schema
            )

        for doc_ids, texts in _pieces(batches):
            ids, counts = enc.encode(texts)
            ends = np.cumsum(counts)
            for d, n, end in zip(doc_ids, counts.tolist(), ends.tolist()):
                docs.append(d)
                lens.append(n)
                parts.append(ids[end - n : end])
                held += n
                if held >= BLOCK_IDS:
                    yield close()
                    block, first, held = block + 1, first + held, 0
                    docs, lens, parts = [], [], []
        if docs:
            yield close()

    return pack


def write_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Tokenize ``doc_id, text`` and write the packed corpus; returns the written blocks, read back.

    The table is range-partitioned by id (rows that share an id by their text's
    hash too), so shards follow each other in ascending order.  Null text counts
    as empty, null ids come first, repeated rows are written each.
    """
    ship(docs.sparkSession)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "h")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
        .select("doc_id", "text")
    )
    with small_batches(docs.sparkSession):
        return cut(ordered.mapInArrow(_packer(tokenizer_path), BLOCK_SCHEMA), "tokens")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unpack every block; per document its place in the shard, its length and checksum."""
    for b in batches:
        for r in b.to_pylist():
            ids = unpack_ids(r["payload"], r["bits"], 0, r["n_ids"]).astype("<u4")
            lens = np.array(r["doc_lens"], np.int64)
            ends = np.cumsum(lens)
            crc = [zlib.crc32(ids[e - n : e].data) for e, n in zip(ends.tolist(), lens.tolist())]
            k = len(lens)
            yield pa.record_batch(
                [pa.array([r["shard"]] * k, pa.int32()), pa.array([r["block"]] * k, pa.int32()),
                 pa.array(np.arange(k), pa.int32()), pa.array(r["doc_ids"], pa.int64()),
                 pa.array(r["first"] + ends - lens, pa.int64()), pa.array(lens), pa.array(crc, pa.int64())],
                names=["shard", "block", "pos", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_index(blocks: DataFrame) -> DataFrame:
    """Per document, from the written blocks: ``doc_id, start, n_tokens, ids_crc32`` and where it lies.

    A shard's offset is the sum of the ids of earlier shards: one row per shard.
    """
    ship(blocks.sparkSession)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
        .select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    docs = blocks.mapInArrow(_index, INDEX_SCHEMA)
    return docs.join(offsets, F.col("shard") == F.col("s")).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", "block", "pos"
    )


def read_range(blocks: DataFrame, shard: int, start: int, count: int) -> np.ndarray:
    """Random access: ``count`` ids of a shard from its id ``start`` on.

    Only blocks that overlap the range are read (the filter reaches the Parquet scan).
    """
    hit = blocks.filter(
        (F.col("shard") == shard) & (F.col("first") < start + count) & (F.col("first") + F.col("n_ids") > start)
    ).select("first", "n_ids", "bits", "payload").orderBy("first")
    out = [np.zeros(0, np.uint32)]
    for r in hit.toLocalIterator():
        lo, hi = max(start, r["first"]), min(start + count, r["first"] + r["n_ids"])
        out.append(unpack_ids(bytes(r["payload"]), r["bits"], lo - r["first"], hi - lo))
    return np.concatenate(out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_output(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Contract query: every document packed, written, read back and checked."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_index(write_tokens(docs, tokenizer_path or default_tokenizer()))
