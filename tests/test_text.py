"""Python string semantics reproduced with column functions (splitlines, strip, tokens, rounding)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeskel.functions import text as T

SAMPLES = ["", "a", "a\n", "a\n\nb\n", "x\r\ny\rz", "p\x0bq\x0cr\x1cs\x85t u", "  lead\t ", "　wide "]


def test_split_strip_indent_match_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "t string")
    rows = df.select(
        "t", T.split_lines(F.col("t")).alias("lines"), T.py_strip(F.col("t")).alias("s"),
        T.indent_width(F.col("t")).alias("ind"), T.tokens_ceil(F.col("t")).alias("tc"),
        T.tokens_floor(F.length("t")).alias("tf"),
    ).collect()
    for r in rows:
        assert r.lines == r.t.splitlines()
        assert r.s == r.t.strip()
        assert r.ind == len(r.t) - len(r.t.lstrip())
        assert r.tf == max(1, int(len(r.t) / 3.8))
        assert r.tc == (0 if not r.t else max(1, -(-len(r.t) * 10 // 38)))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nab#{}()\"'\r\x0b ", max_size=30), min_size=1, max_size=8))
def test_splitlines_property(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", T.split_lines(F.col("t")).alias("l"), T.py_strip(F.col("t")).alias("s")
    ).collect()
    for r in rows:
        assert r.l == r.t.splitlines()
        assert r.s == r.t.strip()


def test_round1_and_ratio(spark):
    df = spark.createDataFrame([(1, 3), (10, 4), (0, 0), (125, 90)], "raw long, used long")
    rows = df.select(T.ratio_string(F.col("raw"), F.col("used")).alias("r"),
                     T.saved_pct(F.col("used"), F.col("raw")).alias("p")).collect()
    assert [r.r for r in rows] == ["0.3x", "2.5x", "0.0x", "1.4x"]
    assert rows[2].p == 0.0


def test_decode_ignores_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"ok\xff\xfe line\r\nnext"),)], "b binary")
    from codeskel.sources.files import decode_content

    assert df.select(decode_content("b").alias("c")).first().c == "ok line\nnext"
