"""The scorer's index: freed with the scorer, its sums those of plain double-precision vectors."""

import gc
import pickle
import weakref

import numpy as np

from codeskel.llm import toxicity


def _scorer():
    texts = [b"good plain words here", b"bad bad words", b"other words stand here", b"bad rude text here"]
    words = sorted({w for t in texts for w in t.split()})
    coder = toxicity.Terms(words)
    held = [coder.of(t) for t in texts]
    sizes = np.array([len(t) for t, _ in held], np.int32)
    terms, counts = (np.concatenate([h[i] for h in held]).astype(np.int32) for i in (0, 1))
    idf = np.linspace(1, 2, len(words))
    scorer = toxicity.Scorer([1, 2, 3, 4], [0, 1, 0, 1], 0.5, idf, toxicity.Terms(words), (sizes, terms, counts))
    return pickle.loads(pickle.dumps(scorer)), held, idf


def test_scorer_and_index_are_freed_without_a_collection():
    """A worker drops a scorer by its last reference; a cycle through the index kept it until a full collection."""
    scorer, _, _ = _scorer()
    scorer.score([b"bad words"])
    gone = weakref.ref(scorer), weakref.ref(scorer.index)
    gc.disable()
    try:
        del scorer
        assert [g() for g in gone] == [None, None]
    finally:
        gc.enable()


def test_weights_of_the_examples_are_worked_out_once(monkeypatch):
    """Cosines of the nearest are products of the unit vectors; a search takes no logarithm of an example's counts."""
    scorer, held, idf = _scorer()
    index = scorer._built()
    want = [toxicity.unit_weights(t, c, idf) for t, c in held]
    terms, counts = scorer.terms.of(b"bad words unknown bad here")
    mine = toxicity.unit_weights(terms, counts, idf)
    by_term = dict(zip(terms.tolist(), mine.tolist()))
    cosines = {i: sum(by_term.get(t, 0.0) * w for t, w in zip(held[i][0].tolist(), want[i].tolist())) for i in range(4)}
    taken = []
    log = np.log
    monkeypatch.setattr(toxicity.np, "log", lambda *a, **k: taken.append(1) or log(*a, **k))
    (found,) = index.search([(terms, mine)], 4)
    assert not taken
    assert [i for i, _ in found] == sorted(cosines, key=lambda i: (-cosines[i], i))
    assert np.allclose([c for _, c in found], [cosines[i] for i, _ in found], rtol=0, atol=1e-12)


def test_terms_of_a_text():
    coder = toxicity.Terms([b"a", b"b", b"c"])
    terms, counts = coder.of("c x A c")
    assert terms.tolist() == [0, 2] and counts.tolist() == [1, 2]
    assert sorted(coder.held("c x A c").tolist()) == [0, 2]
    assert [len(x) for x in coder.of(None)] == [0, 0] and len(coder.held("")) == 0


def test_scorer_without_words_scores_by_terms():
    """What a scoring task gets holds no words; documents' terms give what their texts give."""
    scorer, _, _ = _scorer()
    texts = [b"bad words unknown bad here", None, b"", "good rude text", b"unknown"]
    want = scorer.score(texts)
    found = [scorer.terms.of(t) for t in texts]
    scorer, _, _ = _scorer()
    scorer.terms = None
    assert pickle.loads(pickle.dumps(scorer)).score_terms(found) == want
    assert [w[0] for w in want[1:3]] == [0.5, 0.5] and want[0][1]


def test_rare_terms_take_four_bytes_and_none_is_missed(monkeypatch):
    """Rare terms' places and weights in whole steps, queries grouped by kind: the nearest are those of brute force."""
    monkeypatch.setattr(toxicity, "GROUP", 3)
    rng = np.random.default_rng(5)
    vectors = []
    for i in range(300):
        terms = np.unique(np.concatenate([rng.integers(0, 12, 4) + 12 * (i % 3), rng.integers(36, 3000, 12)]))
        w = rng.random(len(terms)) ** 6 + 1e-9
        vectors.append(dict(zip(terms.tolist(), (w / np.sqrt((w * w).sum())).tolist())))
    index = toxicity.BlockMaxIndex(vectors)
    assert index.held.itemsize == 4 and len(index.matrix) and len(index.held)
    queries = vectors[:40] + [{}]
    got = index.search([(np.array(sorted(q), np.int64), np.array([q[t] for t in sorted(q)], float)) for q in queries], 7)
    for q, found in zip(queries, got):
        cosines = [sum(w * v.get(t, 0.0) for t, w in q.items()) for v in vectors]
        best = sorted((i for i in range(300) if cosines[i] > 0), key=lambda i: (-cosines[i], i))[:7]
        assert [i for i, _ in found] == best
        assert np.allclose([c for _, c in found], [cosines[i] for i in best], rtol=0, atol=1e-12)


def test_scores_are_written_once_and_the_rest_is_dropped(spark):
    """Of what a scoring writes, only the scores stay; the texts' terms and the examples' texts are deleted."""
    import os

    docs = spark.createDataFrame([(i, f"word{i} bad here" if i % 2 else f"good plain{i}") for i in range(40)] + [(None, "bad here"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    kept = spark.sparkContext.getCheckpointDir().removeprefix("file:").rsplit("/", 1)[0]
    before = {d for d, _, _ in os.walk(kept)}
    scored = toxicity.score_toxicity(docs, labels)
    assert scored.count() == 42
    new = {os.path.basename(d).rsplit("-", 1)[0] for d, _, _ in os.walk(kept) if d not in before and os.path.basename(d).startswith("llm-")}
    assert new == {"llm-scores"}


def test_examples_counts_take_a_byte_and_weights_are_the_same_doubles():
    """The index keeps no double for every term of every example; what it works out are the unit vectors, bit by bit."""
    scorer, held, idf = _scorer()
    index = scorer._built()
    assert index.weights.counts.itemsize == 1
    got = index.weights.of(np.array([0, 2, 3]), np.concatenate([held[i][0] for i in (0, 2, 3)]))
    assert got.tolist() == [w for i in (0, 2, 3) for w in toxicity.unit_weights(*held[i], idf).tolist()]
    # counts beyond a byte stay whole
    many = toxicity.Scorer([1], [1], 0.5, idf, None, (np.array([1], np.int32), np.array([2], np.int32), np.array([70_000], np.int32)))
    assert pickle.loads(pickle.dumps(many)).held[2].tolist() == [70_000]


def test_products_take_few_rows_of_the_matrix_at_once(monkeypatch):
    """A batch's product is summed over runs of frequent terms; the nearest and their cosines stay the same."""
    rng = np.random.default_rng(6)
    vectors = [{t: float(w) for t, w in enumerate(rng.random(20) + 0.1)} for _ in range(100)]
    vectors = [{t: w / sum(x * x for x in v.values()) ** 0.5 for t, w in v.items()} for v in vectors]
    whole = [toxicity.BlockMaxIndex(vectors).nearest(q, 5) for q in vectors[:9]]
    monkeypatch.setattr(toxicity, "ROWS", 3)
    index = toxicity.BlockMaxIndex(vectors)
    assert len(index.matrix) == 20
    assert [index.nearest(q, 5) for q in vectors[:9]] == whole


def test_a_scoring_task_frees_what_another_stage_left_in_its_worker():
    """Workers outlive a stage: the tokenizer and the words it learned went on taking memory beside the scorer."""
    from codeskel.llm import tokens

    path = tokens.default_tokenizer()
    assert tokens.encoder(path) is tokens.encoder(path)
    for task in (toxicity._code, toxicity._score):
        gone = weakref.ref(tokens.encoder(path))

        class Sent:
            value = None

        assert gone() is not None
        assert list(task(Sent)(iter([]))) == []
        assert gone() is None
