"""SimHash by multi-index hashing against brute force."""

import random

import numpy as np
import pytest
import xxhash

from codeskel.llm import simhash

from .test_llm import ODD, WORD, sentence, table


def slow_fingerprint(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    grams = [w[i : i + k] for i in range(len(w) - k + 1)] or [w]
    h = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(keys, link):
    """Least position reachable from each."""
    left, out = set(range(len(keys))), {}
    while left:
        root = min(left)
        todo = [root]
        left.discard(root)
        while todo:
            i = todo.pop()
            out[i] = root
            near = [j for j in left if link(keys[i], keys[j])]
            left.difference_update(near)
            todo += near
    return out


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "a B c d", "Grüße AN alle Ärzte\x0bund\x0cmehr  Leute", "x " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode(), 4) == slow_fingerprint(text, 4)


@pytest.mark.parametrize("m", [2, 3, 4])
def test_segments_find_every_close_pair(m):
    """Two fingerprints within the radius share a bucket, whatever bits differ."""
    r = random.Random(m)
    base = [r.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 4))) for b in base]
    import pyarrow as pa

    fps = np.array(base + near, np.uint64)
    rows = list(simhash._probes(m)(iter([pa.record_batch([pa.array(fps.view(np.int64))], names=["fp"])])))
    where = {}
    for b in rows:
        for bucket, fp in zip(b.column(0).to_pylist(), b.column(1).to_numpy().view(np.uint64).tolist()):
            where.setdefault(fp, set()).add(bucket)
    assert all(where[a] & where[b] for a, b in zip(base, near))


def _clusters(r, n=30, size=40):
    """Chains and balls of fingerprints, and single ones."""
    out = [0]
    for _ in range(n):
        c = r.getrandbits(64)
        for _ in range(r.randint(1, size)):
            out.append(c)
            c ^= sum(1 << i for i in r.sample(range(64), r.randint(1, 6)))
    return sorted(set(out))


@pytest.mark.parametrize("m,block", [(2, 2048), (3, 16), (4, 5), (4, 2048)])
def test_links_connect_what_is_close(spark, m, block):
    fps = _clusters(random.Random(m * block)) + [(0xFFFF << 40) ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = [(np.int64(x.a).view(np.uint64), np.int64(x.b).view(np.uint64)) for x in simhash.links(nodes, m, block).collect()]
    at = {f: i for i, f in enumerate(fps)}
    a, b = (np.array([at[int(x[i])] for x in got]) for i in (0, 1))
    roots = simhash._roots(len(fps), a, b)
    want = slow_components(fps, lambda x, y: (x ^ y).bit_count() <= 4)
    assert {i: int(x) for i, x in enumerate(roots)} == want


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(3)
    base = sentence(r, 400)
    rows = [(i, sentence(r, r.randint(1, 60)), "s") for i in range(40)]
    for i in range(40, 90):
        w = base.split()
        for _ in range(i % 3):
            w[r.randrange(400)] = "edited"
        rows.append((i, " ".join(w), "hot"))
    rows += [(7, base, "hot"), (7, base.upper(), "hot"), (95, sentence(r, 30_000), "s")] + [(200 + i, base, "hot") for i in range(1500)] + ODD
    got = sorted(((x.doc_id if x.doc_id is not None else -1), x.fingerprint, x.component_id) for x in simhash.near_duplicates(table(spark, rows), 4).collect())
    fps = [slow_fingerprint(t, 4) for _, t, _ in rows]
    nodes = sorted(set(fps))
    comp = slow_components(nodes, lambda x, y: (x ^ y).bit_count() <= 4)
    of = {f: comp[i] for i, f in enumerate(nodes)}
    least = {}
    for (i, _, _), f in zip(rows, fps):
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    want = sorted((-1 if i is None else i, f"{f:016x}", least.get(of[f], i)) for (i, _, _), f in zip(rows, fps))
    assert got == want


def test_empty_table(spark):
    out = simhash.near_duplicates(table(spark, []))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0
