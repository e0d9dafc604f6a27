"""Method lookup (the reference's test), symbol search against brute force, repo references."""


from codeskel.operators import search as S
from codeskel.operators.lookup import definition_index, extract_method_body, fetch_tokens, method_bodies, prepare_files
from codeskel.operators.skeleton import skeletonize
from codeskel.sources.files import repo_ref_normalise, scan_supported_files

from .test_skeleton import G1, G3


def test_method_body_python_and_brace(spark):
    files = spark.createDataFrame([("r", "ledger.py", G1), ("r", "f.js", G3)], "repo string, path string, content string")
    req = spark.createDataFrame(
        [("r", "ledger.py", "total"), ("r", "f.js", "f"), ("r", "f.js", "nope"), ("r", "gone.py", "x")],
        "repo string, path string, method string",
    )
    rows = {(r.path, r.method): r for r in method_bodies(files, req).collect()}
    total = rows[("ledger.py", "total")]
    assert total.status == "found" and "def total(" in total.body and "s += r" in total.body
    assert total.body.splitlines()[-1].strip() == "return math.floor(s * 100) / 100"
    assert rows[("f.js", "f")].body == G3.rstrip("\n")
    assert rows[("f.js", "nope")].status == "method not found"
    assert rows[("gone.py", "x")].result == "Error: File 'gone.py' not found."


def test_reference_search_matches_brute_force(spark):
    texts = {"a.txt": "alpha beta\nthe other\n  gamma the\n", "b.txt": "nothing\nthe end"}
    files = spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repo string, path string, content string")
    lines = S.search_lines(files)
    syms = spark.createDataFrame([("the",), ("zzz",), ("a",), (" the",), ("e o",)], "symbol string")
    rep = S.reference_report(S.match_symbols(lines, syms), syms, n=2, lines=lines).collect()
    for sym in ["the", "a", " the", "e o"]:
        brute = [(p, i + 1, ln.strip()) for p, t in sorted(texts.items()) for i, ln in enumerate(t.split("\n")[:-1] if t.endswith("\n") else t.split("\n")) if sym in ln]
        got = sorted((r.path, r.line_no, r.text) for r in rep if r.symbol == sym)
        assert got == brute[:2]
        assert {r.ref_count for r in rep if r.symbol == sym} == {len(brute)}
    assert [r.ref_count for r in rep if r.symbol == "zzz"] == [0]


def test_repo_refs_golden(spark):
    refs = ["https://github.com/a/b.git", "github.com/a/b/", "git@host:org/r.git", "https://x.org/a.github.io", "/data/proj"]
    df = spark.createDataFrame([(r,) for r in refs], "ref string")
    got = {r.ref: (r.is_url, r.repo_name) for r in repo_ref_normalise(df).collect()}
    assert got == {
        "https://github.com/a/b.git": (True, "b"),
        "github.com/a/b/": (True, "b"),
        "git@host:org/r.git": (True, "r"),
        "https://x.org/a.github.io": (True, "ahub.io"),
        "/data/proj": (False, "proj"),
    }


def test_scan_filter(spark):
    paths = ["src/a.py", "node_modules/x/a.js", "build/a.java", "docs/readme.md", ".hidden/.bashrc", "pkg/__init__.py"]
    df = spark.createDataFrame([("r", p, "") for p in paths], "repo string, path string, content string")
    got = sorted(r.path for r in scan_supported_files(df).collect())
    assert got == ["pkg/__init__.py", "src/a.py"]


def test_method_bodies_of_formatted_python(spark):
    """Wrapped headers, strings at column 0, defs inside docstrings, equal names at two depths, names with ``$``."""
    py = '''"""Usage:

def h(): ...
"""


def f(
    a,
    b,
):
    s = """
text at column 0
"""
    return (a,
b)


class K:
    def g(self):
        return 1


def g(x):
    return 2


def h():
    return 3
'''
    js = "x = 1;\nfunction $load(a) {\n  b();\n}\n"
    files = spark.createDataFrame([("r", "a.py", py), ("r", "b.js", js)], "repo string, path string, content string")
    reqs = spark.createDataFrame([("r", "a.py", m) for m in "fgh"] + [("r", "b.js", "$load")], "repo string, path string, method string")
    got = {r.method: r.body for r in method_bodies(files, reqs).collect()}
    lines = py.split("\n")
    assert got["f"] == "\n".join(lines[6:15])
    assert got["g"] == "def g(x):\n    return 2"
    assert got["h"] == "def h():\n    return 3"
    assert got["$load"] == js.rstrip("\n")[len("x = 1;\n"):]


def test_local_reference_edge_cases(spark):
    df = spark.createDataFrame([("/",), (".",), ("a/b/",)], "ref string")
    assert {r.ref: r.repo_name for r in repo_ref_normalise(df).collect()} == {"/": "/", ".": ".", "a/b/": "b"}


PY = """class A:
    def run(self):
        if x:
            def inner(a):
                return call(a)

        # a comment
        return inner(2)

    async def stop(self): pass


def run(a,
        b):
    return stop(a)
def last(): return asyncrun (1)
"""
BROKEN = "def f(:\n    g(1)\n    x = (\n"
JAVA = """class T {
  publicint go(int x) {
    if (x > 0) { stop(); }
    return x;
  }
  void stop()
  {
    go(1);
  }
}
"""


LONG = "\n".join(
    f"function g{n}(x) {{\n" + "  x = f(x);\n" * n + "}" for n in (14, 15, 16, 17, 60, 147, 148, 149, 200)
) + "\nfunction open(x) {\n  y(x);"
LONG_PY = "z = (\n" + "\n".join(f"def g{n}(x):\n" + "    x = f(x)\n" * n for n in (14, 15, 16, 17, 60, 148, 149, 200))


def test_index_answers_like_a_scan_of_the_lines(spark):
    """Every name that occurs, and some that do not, against the per-request scan of the file's lines."""
    files = spark.createDataFrame(
        [("r", "a.py", PY), ("r", "b.py", BROKEN), ("r", "T.java", JAVA), ("r", "e.py", ""), ("r", "n.js", None), ("q", "a.py", "x = run(1)\n" + PY),
         ("q", "long.js", LONG), ("q", "long.py", LONG_PY)],
        "repo string, path string, content string",
    )
    names = ["A", "run", "inner", "call", "stop", "last", "asyncrun", "f", "g", "go", "int", "publicint", "T", "if", "x", "nope", "return", "b", "a.b", "$x", "", "y", "open", *(f"g{n}" for n in (14, 15, 16, 17, 60, 147, 148, 149, 200))]
    asked = files.select("repo", "path").crossJoin(spark.createDataFrame([(n,) for n in names], "method string"))
    scan = asked.join(prepare_files(files), ["repo", "path"]).withColumn("body", extract_method_body())
    want = {(r.repo, r.path, r.method): r.body or None for r in scan.select("repo", "path", "method", "body").collect()}
    got = {(r.repo, r.path, r.method): r.body for r in method_bodies(files, asked).collect()}
    assert got == want and sum(v is not None for v in got.values()) > 15
    assert got["r", "a.py", "run"].startswith("def run(a,") and got["r", "a.py", "inner"].endswith("return call(a)")
    tokens = {(r.repo, r.path, r.method): r.tokens for r in fetch_tokens(files, asked).collect()}
    assert tokens == {k: max(1, -(-len(v) * 10 // 38)) for k, v in got.items() if v}


def test_index_is_linear_in_functions(spark):
    """Eight times the functions take at most about eight times as long (a quadratic fold: 64 times)."""
    import time

    def seconds(n):
        text = "\n".join(f"def f{i}(a):\n    return a" for i in range(n)) + "\n"
        js = "\n".join(f"function g{i}(a) {{\n  h(a);\n}}" for i in range(n))
        df = spark.createDataFrame([("r", "a.py", text), ("r", "a.js", js)], "repo string, path string, content string")
        t = time.time()
        assert definition_index(df).filter("name like 'f%' or name like 'g%'").count() == 2 * n
        assert skeletonize(df).filter(f"method_count = {n}").count() == 2
        return time.time() - t

    seconds(100)
    small, large = seconds(500), seconds(4_000)
    assert large < 12 * small + 2


def test_matches_are_written_by_line(spark):
    """What the search writes has one row a line, however many symbols stand in it; copies of a line count once."""
    import os

    symbols = sorted({w[i:j] for w in ("abcdefghij",) for i in range(10) for j in range(i + 1, 11)} | {"j k", "klé"})
    rows = [("r", "a.txt", n, "abcdefghij klé") for n in (1, 2, 2)] + [("r", "b.txt", 1, "zzz"), ("r", "c.txt", 1, None)]
    lines = spark.createDataFrame(rows, "repo string, path string, line_no int, line string")
    kept = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = {d for d, _, _ in os.walk(kept)}
    matches = S.match_symbols(lines, spark.createDataFrame([(s,) for s in symbols], "symbol string"))
    (new,) = [d for d, _, _ in os.walk(kept) if d not in before and os.path.basename(d).startswith("rdd-")]
    got = sorted((r.symbol, r.path, r.line_no) for r in matches.collect())
    assert got == sorted((s, "a.txt", n) for s in symbols for n in (1, 2))
    assert sum(os.path.getsize(os.path.join(new, f)) for f in os.listdir(new)) < 20_000
