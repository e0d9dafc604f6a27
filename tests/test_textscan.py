"""The scanner of texts against the column expressions of the same rules, and what the summary with fetches needs (F1)."""

import random

from pyspark.sql import functions as F

from codeskel.functions.text import split_lines
from codeskel.operators.lookup import extract_method_body, fetch_tokens, prepare_files
from codeskel.operators.skeleton import file_ext, language, skeleton_column, skeletonize
from codeskel.operators.textscan import Text, skeleton_of
from codeskel.plans import queries as Q

from .test_skeleton_scale import _tables

PY = """def f(a):|    def g(self, x):|        return h(x)|async def k(a,|        b):|    return 1|class A(B):|    class C:|\"\"\"Doc.\"\"\"
    \"\"\"Doc|more\"\"\"|@deco|    @prop(1)|import os|from a import (|    b,|)|X = 1|y: int|z += 1|# c(||   |x = "a # (" + '('|s = "\\"" + f(1)
v = 1 \\|(a, b) = 1, 2|print(1); def q(): pass|def one(a): return 1|  def  sp (x):|größe = h(2)|def ²x(a):|x½ = 1|def नमस्ते(a):
import́x|Ⅷ = 1|a‍b(1)|﻿import os|functionpublicgo (1)|r"doc"|''|if x:|d = {|}|a: b = c""".replace("\n", "|").split("|")
JS = """function f(a) {|  return h(a);|}|};|  g(x) {|export default class A {| x class y|const t = (x) => {|let z = 1;|var w|// c {|type T = {|  static async get(x): P<T> {
  if (x > 3) {|{|}}|} else {|for (;;) { a(); }||größe(x) {|const ²x = (a) => {|functioń a() {|Ⓐ(x) {|　g2(x)　{|$load(a) {|functionpublicgo (1)|const q =(x)=>z""".replace("\n", "|").split("|")
JAVA = """package a.b;|public class A {|  public int f(int x) {|  public int g(int x)|  {|    return h(x);|  }|}|};|@Override|struct S {|  if (x > 3) {||int k(int a) { return 1; }
void z(|  int a)|{|}}|} (a) {|x(a){{|　{|\x1f{|my class x|go ( 1 )|publicx(a) }|operator==(x) {""".replace("\n", "|").split("|")
NAMES = ["f", "g", "h", "k", "one", "sp", "größe", "²x", "x½", "नमस्ते", "b", "go", "publicgo", "x", "if", "$load", "operator==", "", "nope", "Ⓐ"]


def _texts():
    r = random.Random(5)
    ends = ["\n"] * 9 + ["\r\n", "\x0c", " "]
    for n in range(240):
        ext, pool = ((".py", PY), (".ts", JS), (".c", JAVA), (".md", JS))[n % 4]
        pool = r.sample(pool, r.randint(2, len(pool)))
        text = "".join(r.choice(pool) + r.choice(ends if n % 3 else ["\n"]) for _ in range(r.choice((0, 1, 3, 8, 20, 60, 200))))
        if n % 8 == 0:  # many of these parse
            text = "\n".join(ln for ln in text.splitlines() if not any(c in ln for c in "()[]{}\"'\\")) + "\ndef f(a):\n    return 1\n"
        yield "r", f"{n}{ext}", text
    yield from (("r", f"null{e}", None) for e in (".py", ".ts", ".c", ".md"))


def test_scanner_gives_what_the_column_expressions_give(spark):
    files = spark.createDataFrame(list(_texts()), "repo string, path string, content string")
    held = files.withColumn("_lines", split_lines(F.col("content"))).withColumn("_lang", language(file_ext("path")))
    want = {r.path: tuple(r.s) for r in held.select("path", F.explode(F.array(skeleton_column("content", "_lines", "_lang"))).alias("s")).collect()}
    got = {r.path: (r.skeleton, r.method_count, r.class_count) for r in skeletonize(files).collect()}
    assert got == want and len({s for s, _, _ in got.values()}) > 150
    asked = files.crossJoin(spark.createDataFrame([(n,) for n in NAMES], "method string")).select("repo", "path", "method")
    scan = asked.join(prepare_files(files), ["repo", "path"]).withColumn("chars", F.length(extract_method_body()))
    chars = {(r.path, r.method): r.chars for r in scan.select("path", "method", "chars").collect() if r.chars}
    tokens = {(r.path, r.method): r.tokens for r in fetch_tokens(files, asked).collect()}
    assert tokens == {k: max(1, -(-n * 10 // 38)) for k, n in chars.items()} and len(tokens) > 400


def test_texts_are_scanned_once_and_without_folds(spark):
    """An interpreted fold over every line took most of the time of the summary with fetches (F1)."""
    files = spark.createDataFrame([("r", "a.js", "function f(a) {\n  g(a);\n}")], "repo string, path string, content string")
    asked = spark.createDataFrame([("r", "a.js", "f"), ("r", "a.js", "f"), ("r", "a.js", None)], "repo string, path string, method string")
    fetched = fetch_tokens(files, asked)
    for df in (skeletonize(files), fetched):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in plan and plan.count("ArrowEvalPython") == 1
    assert [r.tokens for r in fetched.collect()] == [7, 7]


def test_summary_with_fetches_keeps_no_skeletons(spark, tmp_path):
    """It reads them once; the same rows come out when they are kept."""
    sf = _tables(spark, tmp_path)
    alone = sorted(map(tuple, Q.repo_summary_with_fetches(spark, sf).collect()))
    assert (spark.sparkContext.applicationId, sf) not in Q._METRICS
    Q.file_skeleton_metrics(spark, sf).count()
    assert alone == sorted(map(tuple, Q.repo_summary_with_fetches(spark, sf).collect()))
    assert sum(r[4] for r in alone) == 160  # 200 line items; the names in .md files stand before no bracket


def test_bytes_that_are_no_utf8_stay(spark):
    bad = b"function f(a) {\n  x\xff;\n}\n\xfe"
    files = spark.createDataFrame([("r", "a.js", bytearray(bad))], "repo string, path string, content binary")
    files = files.withColumn("content", F.col("content").cast("string"))
    got = skeletonize(files).select(F.col("skeleton").cast("binary").alias("s")).first().s
    assert bytes(got) == b"function f(a) {\n  /* [Body compressed: 2 lines] */\n}"
    md = files.withColumn("path", F.lit("a.md"))
    assert bytes(skeletonize(md).select(F.col("skeleton").cast("binary").alias("s")).first().s) == bad


def test_scanner_is_linear_in_lines():
    import time

    def seconds(n):
        text = "\n".join(f"function g{i}(a) {{\n  h(a);\n}}" for i in range(n))
        t = time.perf_counter()
        skeleton_of(text, "js_ts")
        found = Text(text, False)
        assert all(found.find(f"g{i}") == (3 * i, 3 * i + 2) for i in range(n))
        return time.perf_counter() - t

    seconds(1_000)
    small, large = seconds(5_000), seconds(40_000)
    assert large < 16 * small + 1
