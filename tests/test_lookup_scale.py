"""Requests are joined to their files a file at a time (F2)."""

from codeskel.operators.lookup import _asked_methods, method_bodies
from codeskel.operators.textscan import CHUNK, bodies, chunks

import pyarrow as pa

REQ = "repo string, path string, method string"


def test_requests_meet_their_file_in_one_join(spark):
    """Before, every request was joined twice more, by its method, and the texts were dealt out three times."""
    files = spark.createDataFrame([("r", "a.js", "function f(a) {\n  g(a);\n}")], "repo string, path string, content string")
    asked = spark.createDataFrame([("r", "a.js", "f"), ("r", "b.js", "f")], REQ)
    df = method_bodies(files, asked)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "aggregate(" not in plan
    assert sorted((r.path, r.status) for r in df.collect()) == [("a.js", "found"), ("b.js", "file not found")]


def test_a_file_with_very_many_requests_is_answered_in_parts(spark):
    n = 2 * CHUNK + 5
    text = "".join(f"function f{i}(a) {{\n  g(a);\n}}\n" for i in range(3))
    files = spark.createDataFrame([("r", "a.js", text), ("r", "n.js", None)], "repo string, path string, content string")
    asked = spark.range(n).selectExpr("'r' as repo", "'a.js' as path", "concat('f', id % 5) as method")
    more = spark.createDataFrame([("r", "a.js", None), ("r", None, "f1"), (None, None, None), ("r", "n.js", "f1"), ("r", "a.js", "f1")], REQ)
    asked = asked.union(more)
    rows = _asked_methods(asked).collect()
    assert max(len(r.methods) for r in rows) <= CHUNK and sum(len(r.methods) for r in rows) == n + 5
    got = method_bodies(files, asked).groupBy("path", "method", "status").count().collect()
    count = {(r.path, r.method, r.status): r["count"] for r in got}
    assert count.pop(("a.js", "f1", "found")) == len(range(1, n, 5)) + 1
    assert count.pop(("a.js", None, "method not found")) == 1 and count.pop(("n.js", "f1", "method not found")) == 1
    assert count.pop((None, "f1", "file not found")) == 1 and count.pop((None, None, "file not found")) == 1
    assert sum(count.values()) == n - len(range(1, n, 5)) and {s for _, _, s in count} == {"found", "method not found"}


def test_rows_of_one_path_are_cut_from_each_of_its_texts(spark):
    """Two rows of a path: every request once for each row, with the lines found in either cut out of both."""
    one, two = "function f(a) {\n  g(a);\n}", "\nfunction f(b) {\n  h(b);\n}"
    files = spark.createDataFrame([("r", "a.js", one, None), ("r", "a.js", two, None), ("r", "b.js", one, None), ("r", "b.js", two, "bad")],
                                  "repo string, path string, content string, error string")
    asked = spark.createDataFrame([("r", "a.js", "f"), ("r", "a.js", "nope"), ("r", "b.js", "f")], REQ)
    got = [(r.path, r.method, r.status, r.body) for r in method_bodies(files, asked).collect()]
    cut = [one, "\n".join(one.split("\n")[1:]), "\nfunction f(b) {\n  h(b);", two[1:]]
    assert sorted(b for p, m, _, b in got if (p, m) == ("a.js", "f")) == sorted(2 * cut)
    assert [x for x in got if x[1] == "nope"] == 2 * [("a.js", "nope", "method not found", None)]
    assert sorted((s, b or "") for p, _, s, b in got if p == "b.js") == [("found", one), ("read error", "")]


def test_batches_of_bodies_are_bounded():
    """A batch in may ask for more text than a batch out should hold."""
    text = "function f(a) {\n" + "  g(a);\n" * 140 + "}\n"
    cols = [pa.array(["r"] * 9), pa.array([f"{i}.js" for i in range(9)]), pa.array([None] * 9, pa.string()),
            pa.array([[{"content": text}]] * 9), pa.array([False] * 9), pa.array([["f"] * 3000] * 9)]
    out = list(bodies([pa.RecordBatch.from_arrays(cols, ["repo", "path", "error", "texts", "is_py", "methods"])]))
    assert sum(b.num_rows for b in out) == 27_000 and len(out) > 2 and max(b.nbytes for b in out) < 20_000_000
    sorted_rows = pa.RecordBatch.from_arrays([pa.array(["r", "r", None, None]), pa.array(["a", "b", "b", "b"]), pa.array(["x", None, "y", "z"])], ["repo", "path", "method"])
    (held,) = chunks([sorted_rows])
    assert held.to_pylist() == [{"repo": "r", "path": "a", "methods": ["x"]}, {"repo": "r", "path": "b", "methods": [None]}, {"repo": None, "path": "b", "methods": ["y", "z"]}]
