"""The training-data operators against brute force, round trips and planted cases on small tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from codeskel.llm import ann, chat, decontam, license, mixing, neardup, quality, tokens, toxicity, urls

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Documents with two columns whose names clash with the operators' own."""
    full = [(i, t, "en", s, len(t) if t is not None else None, 0.5, 1) for i, t, s in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


ODD = [(901, None, None), (902, "", "a"), (903, " \n\t ", "a"), (904, "one", None), (905, "one", None), (None, "none at all", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    rows = [(i, sentence(r, r.randint(1, 120)), f"s{i % 4}") for i in range(60)]
    base = sentence(r, 100)
    for i in range(60, 90):  # edited copies of one text, many of one source
        ws = base.split()
        for _ in range(i % 4):
            ws[r.randrange(100)] = "edited"
        rows.append((i, " ".join(ws), "s0"))
    rows += [(90, base, "s0"), (91, base.upper(), "s0"), (91, base.upper(), "s0"), (92, sentence(r, 30_000), "s1")]
    return table(spark, rows + ODD), rows + ODD


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


# ------------------------------------------------------------------ tokens


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 24])
def test_packing_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    raw = tokens.pack_ids(ids, bits)
    assert len(raw) == -(-1000 * bits // 8)
    assert (tokens.unpack_ids(raw, bits, 0, 1000) == ids).all()
    assert (tokens.unpack_ids(raw, bits, 331, 77) == ids[331:408]).all()


def test_word_encoder_equals_the_tokenizer():
    enc = tokens.WordEncoder(tokens.default_tokenizer(), cache_words=5)
    for text in ["", " a", "Don't STOP, don't! 12ab", "É Σας İstanbul\x85x\x1cy.", "a<|endoftext|>b <|ENDOFTEXT|>", "한국 👍🏽\x00"]:
        assert enc.encode([text.encode()])[0].tolist() == [*enc.tok.encode(text, add_special_tokens=False).ids, tokens.END_ID]


def test_token_output(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 500)
    df, rows = docs
    enc = tokens.WordEncoder(tokens.default_tokenizer())
    blocks = tokens.write_tokens(df, tokens.default_tokenizer())
    got = sorted((tuple(r)[:4] for r in tokens.read_index(blocks).collect()), key=lambda r: r[1])
    want = sorted(((i, enc.tok.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0]))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sorted((g[0] or -1, g[2], g[3]) for g in got) == sorted(
        (w[0] or -1, len(w[1]), zlib.crc32(np.array(w[1], "<u4").tobytes())) for w in want
    )
    assert [g[1] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]
    first = blocks.filter("block = 1").first()
    whole = tokens.read_range(blocks, first["shard"], 0, first["first"] + 100)
    assert (tokens.read_range(blocks, first["shard"], first["first"] - 50, 100) == whole[first["first"] - 50 : first["first"] + 50]).all()
    assert tokens.read_index(tokens.write_tokens(empty, tokens.default_tokenizer())).count() == 0


# ------------------------------------------------------------------ mixing


def test_mixing(spark, docs, empty):
    df, rows = docs
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({s for *_, s in rows if s is not None}) + [None]
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    capped, want = set(), {}
    while True:  # share again until none is above
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        w = sum(weight[s] for s in sources if s not in capped)
        want = {s: 3 * total[s] if s in capped else left * weight[s] / w for s in sources}
        more = {s for s in sources if want[s] > 3 * total[s]}
        if not more:
            break
        capped |= more
    for s in sources:
        mine = [r for r in got if r.source == s]
        assert {r.mix_source_size for r in mine} == {total[s]}
        assert all(abs(r.mix_target - want[s]) < 1e-6 for r in mine)
        taken = sum(r.mix_copies * r.mix_size + r.mix_cut_words for r in mine)
        assert abs(taken - want[s]) <= 2
        assert all(r.mix_copies * r.mix_size + r.mix_cut_words <= 3 * r.mix_size for r in mine)
    out = mixing.expand(mixing.mix(df))
    assert out.columns == df.columns
    words = sum(size(r.text) for r in out.collect())
    assert abs(words - sum(total.values())) <= 2 * len(sources)
    assert mixing.mix(empty).count() == 0


# ------------------------------------------------------------------ near duplicates


def shingles(text, k):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    ws = WORD.findall(low)
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute_components(rows, k):
    sets = [shingles(t, k) for _, t, _ in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, *_), x in zip(rows, label):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [(i, len(s), least.get(x)) for (i, *_), s, x in zip(rows, sets, label)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, docs, empty, k):
    df, rows = docs
    got = neardup.near_duplicates(df, k).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_components(rows, k), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = neardup.keep_one(df, k)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) == len({c for _, _, c in brute_components(rows, k)})
    assert neardup.near_duplicates(empty, k).count() == 0 and neardup.keep_one(empty, k).count() == 0


def test_signatures_estimate_and_prune():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 63, 1000, np.uint64))
    b = np.concatenate((a[:900], np.unique(r.integers(0, 1 << 63, 100, np.uint64))))
    sa, sb = (neardup.signature(np.unique(x)) for x in (a, b))
    assert abs((sa == sb).mean() - 900 / 1100) < 0.12
    far = neardup.signature(np.unique(r.integers(0, 1 << 63, 1000, np.uint64)))
    low = [x.astype(np.uint8)[None] for x in (sa, sb, far)]
    assert neardup.survives(low[0], low[1])[0] and not neardup.survives(low[0], low[2])[0]


def test_cross_blocks_report_each_pair_once(spark):
    """The residual comparison finds the links that pivots leave over."""
    r = random.Random(3)
    base = [sentence(r, 1) + str(i) for i in range(60)]
    rows = [(i, " ".join(base[:i] + ["x%d" % i] + base[i + 1 :]), "a") for i in range(1, 59, 6)]
    rows += [(100 + i, " ".join(base[: 60 - 2 * i]), "a") for i in range(8)]
    df = table(spark, rows)
    neardup.PIVOT_ROUNDS, old = 0, neardup.PIVOT_ROUNDS
    try:
        got = neardup.near_duplicates(df, 4).collect()
    finally:
        neardup.PIVOT_ROUNDS = old
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(brute_components(rows, 4))


# ------------------------------------------------------------------ decontamination


def plain_align(a, b):
    best = 0
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_plain_recurrence():
    r = np.random.default_rng(2)
    for _ in range(60):
        a, b = r.integers(0, 4, r.integers(1, 15)), r.integers(0, 4, r.integers(0, 25))
        assert decontam.align(a, b)[0] == plain_align(a.tolist(), b.tolist())


def test_decontamination(spark, docs, empty):
    df, rows = docs
    r = random.Random(8)
    items = [(i, sentence(r, 25)) for i in range(5)] + [(5, None), (6, ""), (7, "short"), (None, "no id at all")]
    ws = items[1][1].split()
    edited = " ".join(w for i, w in enumerate(ws) if i % 9)  # words left out
    mixed = " ".join(w if i % 6 else f"new{i}" for i, w in enumerate(items[2][1].upper().split()))  # words replaced, upper case
    more = [(201, sentence(r, 50) + " " + items[0][1] + " " + sentence(r, 9), "a"), (202, edited, "a"), (203, sentence(r, 40) + "\n" + mixed, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    full = table(spark, rows + more)
    got = {(x.doc_id, x.item_id): x for x in decontam.find_copies(full, bench).collect()}
    assert set(got) == {(201, 0), (202, 1), (203, 2)}
    assert got[201, 0].score == 1 and (got[201, 0].first_word, got[201, 0].last_word) == (50, 74)
    clean = decontam.decontaminate(full, bench)
    assert clean.columns == full.columns and clean.count() == len(rows)
    assert decontam.find_copies(empty, bench).count() == 0 and decontam.find_copies(full, bench.limit(0)).count() == 0


def test_excerpts_of_long_items_and_short_items():
    words = [f"w{i}".encode() for i in range(500)]
    m = decontam.Matcher({1: words, 2: [b"one"], 3: [b"two", b"words"]}, {w: 1 for w in words}, 10_000)
    text = lambda ws: b" ".join([b"before", *ws, b"after"])
    got = dict(m.find_all([text(words[100:340]), text(words[7:20]), text(words[7:19]), b"there is one", b"two words more", b"One", b"Two, words"]))
    assert {k: [h[0] for h in hits] for k, hits in got.items()} == {0: [1], 1: [1], 5: [2], 6: [3]}
    assert got[0] == [(1, 240 / 500, 1, 240)] and got[1] == [(1, 13 / 500, 1, 13)]


# ------------------------------------------------------------------ toxicity and quality


def test_block_max_search_is_exact():
    r = random.Random(4)
    idf = np.linspace(1, 3, 30)
    vecs = []
    for _ in range(400):
        t = sorted(r.sample(range(30), r.randint(1, 5)))
        vecs.append(toxicity.unit(t, [r.randint(1, 3) for _ in t], idf))
    index = toxicity.BlockMaxIndex(vecs)
    for _ in range(60):
        t = sorted(r.sample(range(30), r.randint(1, 4)))
        q = toxicity.unit(t, [1] * len(t), idf)
        all_ = sorted((-round(sum(q[k] * v.get(k, 0) for k in q), 9), i) for i, v in enumerate(vecs))
        want = [c for c, _ in all_[:7] if c < 0]
        assert [-round(c, 9) for _, c in index.nearest(q, 7)] == want


def labelled(spark, column):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = sentence(r, 60).split()
        if bad and column == "toxic":
            words[7] = r.choice(["vile", "nasty"])
        if bad and column == "quality":
            words = [w for w in words[:10] for _ in range(6)] if i % 8 else [w + "$$$" for w in words]
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(bad) if column == "toxic" else int(not bad), 3))
    odd = [(None, 1, 3), (1, None, 3), (7777, 1, 3)]
    return table(spark, rows + ODD), spark.createDataFrame(labels + odd, f"doc_id long, {column} int, text int"), {i: y for i, y, _ in labels}


def test_toxicity(spark, empty):
    df, labels, truth = labelled(spark, "toxic")
    got = toxicity.score_toxicity(df, labels).collect()
    assert len(got) == 400 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all((r.score >= 0.5) == truth[r.doc_id] for r in held)
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == 300 + len(ODD)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(df, labels.limit(0)).collect()} == {0.0}


def test_toxicity_reaches_words_outside_a_lexicon(spark):
    """A copy of a toxic example whose words are rare finds it, on a handful of labels too."""
    r = random.Random(12)
    texts = [sentence(r, 40) for _ in range(30)]
    learned = [i for i in range(30) if zlib.crc32(str(i).encode()) % 5]
    bad = learned[3]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(100, texts[bad], "a"), (101, texts[bad] + " one more", "a"), (102, texts[learned[5]], "a")]
    labels = spark.createDataFrame([(i, int(i == bad)) for i in range(30)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(table(spark, rows), labels).collect()}
    assert got[100].score >= 0.5 and got[101].score >= 0.5 and got[102].score < 0.5
    assert got[100].neighbours[0] == bad and abs(got[100].cosines[0] - 1) < 1e-9
    assert got[102].neighbours[0] == learned[5]


def test_rows_of_one_id_go_by_their_own_text(spark):
    """Clean rows stay beside a rejected row of the same or of no id."""
    r = random.Random(21)
    texts = [sentence(r, 40) for _ in range(30)]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    bad = next(i for i in range(30) if zlib.crc32(str(i).encode()) % 5)
    clean = [(i, sentence(r, 40), "a") for i in (None, None, 77, 77)]
    df = table(spark, rows + [(None, texts[bad], "a"), (77, texts[bad], "a"), *clean])
    labels = spark.createDataFrame([(i, int(i == bad)) for i in range(30)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, texts[bad])], "item_id long, text string")
    want = sorted(t for _, t, _ in rows + clean if t != texts[bad])
    assert sorted(x.text for x in toxicity.drop_toxic(df, labels).collect()) == want
    assert sorted(x.text for x in decontam.decontaminate(df, bench).collect()) == want


def test_one_row_of_each_group_stays(spark):
    """Groups whose rows share an id or have none keep one row; unrelated rows of one id all stay."""
    r = random.Random(33)
    a, b, c = (sentence(r, 200) for _ in range(3))
    edit = lambda t, w: " ".join([*t.split()[:-1], w])
    rows = [(5, a), (5, edit(a, "x")), (5, b), (None, edit(a, "y")), (None, c), (None, edit(c, "z")), (None, c), (7, edit(b, "w")),
            (8, ""), (8, None), (9, " "), (9, " ")]
    kept = neardup.keep_one(table(spark, [(i, t, "s") for i, t in rows])).collect()
    groups = [sum(x.text is not None and x.text[:50] == t[:50] for x in kept) for t in (a, b, c)]
    assert groups == [1, 1, 1]
    assert sorted((x.doc_id for x in kept if x.text and x.text[:50] == b[:50])) == [5]
    assert sorted((x.doc_id or 0) for x in kept if not (x.text or "").strip()) == [8, 9]


def test_quality(spark, empty):
    df, labels, truth = labelled(spark, "quality")
    got = quality.score_quality(df, labels).collect()
    assert len(got) == 400 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert quality.score_quality(empty, labels).count() == 0
    assert {r.score for r in quality.score_quality(df, labels.limit(0)).collect()} == {0.5}


# ------------------------------------------------------------------ licenses


def test_licenses(spark, docs, empty):
    text = "Hello\nLicensed under the Apache License, Version 2.0.\nmit\nlicense and CC BY; GNU general public license é"
    df = table(spark, [(1, text, "a"), (2, "released under\nthe MIT License", "a"), (3, "under the version", "a"), *ODD])
    got = {r.doc_id: r for r in license.scan_licenses(df).collect() if r.doc_id}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word) == (len(words), 4, words.index("apache"), words.index("gnu"))
    assert got[1].base_labels == "apache,cc-by,gpl,mit" and "apache-2.0" in got[1].labels and got[1].score == 1
    assert got[2].base_labels == "mit" and "mit-release" in got[2].labels.split(",")
    assert (got[3].labels, got[3].score, got[3].first_word) == ("", 0.0, None)
    assert got[901].n_words == 0 and got[902].labels == ""
    assert license.scan_licenses(empty).count() == 0


def test_licenses_that_must_be_absent(spark):
    cases = {
        "This work is licensed under the GNU General Public License, version 3.": {"gpl-3.0"},
        "this work is licensed under the gnu general public license version 2": {"gpl-2.0"},
        "Licensed under CC BY-NC 4.0": {"cc-by-nc-4.0"},
        "licensed under cc by-sa 4.0": {"cc-by-sa-4.0"},
        "released mit dem\nunter der under gehen\nthe " + "wort " * 30 + "license": set(),
        "released under the apache license": set(),
        "mit " + "wort " * 12 + "released under the license": set(),
    }
    df = table(spark, [(i, t, "a") for i, t in enumerate(cases)])
    base = {label for _, label in license.PHRASES}
    got = {r.doc_id: set(r.labels.split(",")) - base - {""} for r in license.scan_licenses(df).collect()}
    assert got == dict(enumerate(cases.values()))


def test_licenses_over_many_lines(spark):
    narrow = "this work\nis licensed\nunder the\ngnu general\npublic license\nversion 3"
    spaced = "permission is hereby granted free\n\nof charge to any person\n\nobtaining a copy of this software"
    r = random.Random(2)
    long = sentence(r, 300)
    wrapped = "\n".join(re.findall(r"(?:\S+ ?){1,8}", long))
    df = table(spark, [(1, narrow, "a"), (2, spaced, "a"), (3, "before it " + wrapped, "a")])
    got = {x.doc_id: x for x in license.scan_licenses(df, (*license.TEMPLATES, ("long", long))).collect()}
    assert "gpl-3.0" in got[1].labels.split(",") and got[2].labels == "mit-permission" and got[3].labels == "long"
    assert got[2].score == got[3].score == 1


def test_template_index_equals_all_pairs():
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(25)]
    templates = [(f"t{i}", " ".join(r.sample(vocab, r.randint(1, 9)))) for i in range(30)]
    counts = {w.encode(): r.randint(0, 50) for w in vocab}
    index = license.TemplateIndex(templates, counts, 0.7)
    sets = [(label, {w for ln in license.line_words(t.encode()) for w in ln}) for label, t in templates]
    for _ in range(300):
        block = {w.encode() for w in r.sample(vocab, r.randint(0, 14))}
        want = {(label, len(s & block) / len(s)) for label, s in sets if len(s & block) >= math.ceil(0.7 * len(s) - 1e-9)}
        assert set(index.matches(block)) == want


# ------------------------------------------------------------------ chat


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 60)
    texts = ["\\### Assistant: </turn> ok", "<|end|><|turn|>\\", "  lead\n", "", None, "é👍🏽 \\<|", "<\\|end|>", "x" * 300]
    rows = [(c, t, ("user", "assistant", "<|text|>", None)[(c + t) % 4], texts[(3 * c + t) % 8]) for c in range(6) for t in range(12)]
    rows.append((None, 0, "assistant", "no id"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", __import__("pyspark").sql.functions.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df, chat.default_tokenizer())).collect()}
    assert len(got) == 7
    for c in [*range(6), None]:
        mine = [(role or "", text or "") for x, t, role, text in sorted(rows, key=lambda r: r[1]) if x == c]
        said = "".join(t for role, t in mine if role == "assistant")
        r = got[c]
        assert r.n_turns == len(mine) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.formatted_chars == len(chat.render(mine)[0])
    assert chat.digests(chat.format_chats(df.limit(0), chat.default_tokenizer())).count() == 0


def test_parts_encode_like_the_whole():
    tok = chat.chat_tokenizer(chat.default_tokenizer())
    a, b = chat.render([("user", " x  y\n"), ("assistant", "\n z")])[0], chat.render([("user", " q")])[0]
    ids = lambda s: tok.encode(s, add_special_tokens=False).ids
    assert ids(a + b) == ids(a) + ids(b)


# ------------------------------------------------------------------ nearest neighbours


def test_nearest_neighbours(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(700, 16))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(700 + i, x[50].tolist(), 1) for i in range(30)]  # one vector many times
    rows += [(800, None, 1), (850, [0.0] * 16, 1), (900, [1.0, None] * 8, 1), (950, [float("nan")] * 16, 1), (1000, [float("inf")] * 16, 1)]
    rows += [(1050, [1.0, 2.0], 1), (1051, [2.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    queries = ann._vectors(df, "vec_id", "embedding").filter("vec_id % 50 = 0")
    got = ann.search(ann.build_index(df), queries).collect()
    ok = {i: np.array(v, np.float32).astype(np.float64) for i, v, _ in rows if i < 800 or i > 1000}
    want, have = set(), {(g.query_id, g.vec_id) for g in got}
    for q in [i for i in ok if i % 50 == 0]:
        near = sorted(
            (-float(ok[q] @ v / math.sqrt((ok[q] @ ok[q]) * (v @ v))), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])
        )[:5]
        want |= {(q, i) for _, i in near}
        mine = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(near) + 1))
        assert all(abs(m[2] - ok[q] @ ok[m[1]] / math.sqrt((ok[q] @ ok[q]) * (ok[m[1]] @ ok[m[1]]))) < 1e-12 for m in mine)
    assert len(want & have) >= 0.95 * len(want)
    assert [g.vec_id for g in sorted(got, key=lambda g: g.rank) if g.query_id == 50] == [700, 701, 702, 703, 704]
    assert ann.search(ann.build_index(df.limit(0)), queries.limit(0)).count() == 0


# ------------------------------------------------------------------ urls


def test_url_rules_and_parts(spark):
    cases = {
        "https://A.Example.ORG/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://org/x": ("org", "/x", "org/", "allow"),
        "http://myorg/x": ("myorg", "/x", None, "allow"),
        "http://x.org": ("x.org", "", None, "allow"),
        "http://b.com/de/9": ("b.com", "/de/9", "com/de/", "block"),
        "no scheme": ("", "", None, "allow"),
        "http://é.net?a://b/c": ("é.net", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "p") for i, u in enumerate(cases)], "page_id long, url string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_url_templates_learn_from_rules(spark):
    rules = (("block", "h.net", "/ads/1"), ("allow", "h.net", "/news/1"))
    rows = [f"http://h.net/ads/{i}.html" for i in range(1, 400)] + [f"http://h.net/news/{i}/x" for i in range(1, 400)]
    rows += [f"http://other.net/user{i}x/ads" for i in "abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = urls.judge_urls(df, rules).collect()
    assert {r.verdict for r in got if r.path.startswith("/ads/")} == {"block"}
    assert {r.verdict for r in got if r.path.startswith("/news/") or r.host == "other.net"} == {"allow"}
    assert {r.template for r in got if r.path.startswith("/ads/")} == {"//ads/{n}.html"}
    assert {r.template for r in got if r.host == "other.net"} == {"//*/ads"}
