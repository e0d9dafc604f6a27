"""The whole pipeline on a small folder against what its stages must leave, worked out by hand."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from codeskel.llm import tokens

from .test_llm import ODD, labelled, sentence, table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    df, labels, truth = labelled(spark, "toxic")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    clean = [i for i, y in truth.items() if not y]
    r = random.Random(44)
    base, item = sentence(r, 90), sentence(r, 40)
    near = [" ".join([*base.split()[:-n], *(["edited"] * n)]) for n in (1, 2, 3)]
    rows += [(500, base), (None, near[0]), (500, near[1]), (502, near[2]), (502, near[2])]  # one group, shared and null ids
    rows += [(600, f"{sentence(r, 30)} {item} {sentence(r, 30)}"), (601, item.upper())]  # leaked
    rows += [(602, sentence(r, 50))]
    table(spark, [(i, t, "a") for i, t in rows]).repartition(3).write.parquet(f"{out}/documents.parquet")
    labels.write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    text_of = dict(rows)
    want = {i: text_of[i] for i in clean} | {500: base, 602: rows[-1][1], 901: None, 902: "", 903: " \n\t ", 904: "one", None: "none at all"}
    assert all(i in want or i is None for i, _, _ in ODD if i != 905)
    return str(out), want


def test_pipeline_leaves_what_it_must(spark, folder):
    """Toxic, repeated and leaked documents go, odd rows stay, and one source is taken once and whole."""
    from tokenizers import Tokenizer

    path, want = folder
    got = corpus_pipeline.run(spark, path).collect()
    tok = Tokenizer.from_file(tokens.default_tokenizer())
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in want.items()}
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in got) == sorted(-1 if i is None else i for i in want)
    for r in got:
        mine = np.array(ids[r.doc_id], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(mine), zlib.crc32(mine.tobytes()))
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order)])[:-1].tolist()
    assert [r.doc_id for r in order if r.doc_id is not None] == sorted(i for i in want if i is not None)


def test_stages_keep_the_columns_and_stand_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder[0])
        assert out.count() == 0
        assert name == "tokens" or out.columns == docs.columns
