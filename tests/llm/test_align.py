"""Cross-tokenizer alignment against a whole-text brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from codeskel.llm import align

from .test_llm import ODD, sentence, table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello world", "  two  blanks  ", "\nline\nline \n\n x", "tab\there\r\nand  　wide blank", "Größe naïve 漢字かな交じり文 🙂👍🏽",
    "a▁b", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "it's we'll 'tis 123456 a1b2", "\x00\x01\x1c \x1d", ";\r\n}\r", " lead", "trail ", "don't, (they're) e.g. www.x.com? \"No!\" te.&&& x², é́, a\nB\n c d", "Schön, Ça! — “q”… 3,5% #a_b",
    "x" * 3000, "ab " * 5000, "é ﬁ ½ ​ zero", "﻿bom", "\n", " ", " sep par",
]


def slow(texts):
    """Per text (n_a, n_b, n_groups, links, groups) from whole encodings and byte offsets."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    chars = align.byte_of_char()
    out = []
    for t in texts:
        out.append((0, 0, 0, [], ""))
        if not t:
            continue
        a, b = ta.encode(" " + t, add_special_tokens=False), tb.encode(t)
        ids, ba = a.ids, [bytes(chars[c] for c in s) for s in a.tokens]
        bb = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            continue
        ends = [np.cumsum([len(x) for x in y]).tolist() for y in (ba, bb)]
        owner = [np.repeat(np.arange(len(y)), [len(x) for x in y]).tolist() for y in (ba, bb)]
        links = sorted(set(zip(*owner)))
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for e in common:
            p, q = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append(",".join(map(str, ids[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        out[-1] = (len(ids), len(b), len(groups), [(ids[x], b[y]) for x, y in links], ";".join(groups))
    return out


def brute(rows):
    found = slow([t for _, t in rows])
    count = Counter(p for f in found for p in f[3])
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    return [
        (i, f[0], f[1], f[2], len(f[3]), sum(count[p] == top[p[1]] for p in f[3]), sum(count[p] for p in f[3]),
         hashlib.sha256(f[4].encode()).hexdigest() if f[3] else "")
        for (i, _), f in zip(rows, found)
    ]


def test_units_align_like_whole_texts():
    two = align.TokenizerPair(A, B, memory=3)
    assert two.cuts
    for t, want in zip(TEXTS, slow(TEXTS)):
        sha, pairs, n_a, n_b, n_groups = two.document(t)
        assert (n_a, n_b, n_groups, len(pairs)) == (*want[:3], len(want[3])), repr(t)
        assert sha == (hashlib.sha256(want[4].encode()).hexdigest() if want[3] else "")
        assert Counter((p >> 20, p & 0xFFFFF) for p in pairs.tolist()) == Counter(want[3])
    assert two.old and two.tails  # both memories were turned over or used
    for t in ("a▁b", "", None):
        sha, pairs, *counts = two.document(t)
        assert (sha, len(pairs), counts) == ("", 0, [0, 0, 0])


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 60000])
def test_compressed_sets(n):
    pos = np.sort(np.random.default_rng(n).choice(1 << 16, n, replace=False))
    raw = align.compress(pos)
    assert (align.positions(raw) == pos).all() and len(raw) <= 8192
    half = pos[::2], pos[1::3]
    both = np.union1d(*half)
    ones, merged = align.merge([align.compress(h) for h in half])
    assert ones == len(both) and (align.positions(merged) == both).all()


@pytest.mark.parametrize("held,links", [(50, 400), (1_500_000, 8_000_000)])
def test_equals_brute_force(spark, monkeypatch, held, links):
    r = random.Random(4)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, sentence(r, r.randint(1, 80))) for i in range(60)]
    rows += [(7, TEXTS[0]), (7, TEXTS[0]), (300, sentence(r, 30_000))] + [(i, t) for i, t, _ in ODD]
    df = table(spark, [(i, t, "s") for i, t in rows]).repartition(3)
    invert = align._invert

    def small(a, b):
        def run(batches):
            align.HELD_LINKS, align.BLOCK_LINKS = held, links
            yield from invert(a, b)(batches)
        return run

    monkeypatch.setattr(align, "_invert", small)
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    got = sorted((tuple(x) for x in align.align(df, A, B).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def test_pair_counts_and_test_tables(spark):
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(x["doc_id"], x["text"]) for x in rows][::5]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(x) for x in align.align(df, A, B).collect()) == sorted(brute(rows))
    found = slow([t for _, t in rows])
    links = Counter(a << 20 | b for f in found for a, b in f[3])
    docs = Counter(x for f in found for x in {a << 20 | b for a, b in f[3]})
    got = align.pair_counts(align.invert(df, A, B)).collect()
    assert {x.pair: (x.n_docs, x.n_links) for x in got} == {p: (docs[p], n) for p, n in links.items()}


def test_empty_table(spark):
    out = align.align(table(spark, []), A, B)
    assert out.columns[0] == "doc_id" and out.count() == 0
