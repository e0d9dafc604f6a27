"""Streaming equals batch (T1, T2); the tree source keeps hidden, underscore and empty files."""

import os

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from codeskel.operators.lookup import method_bodies
from codeskel.operators.search import searched_files
from codeskel.operators.skeleton import METRIC_COLUMNS, skeletonize
from codeskel.plans import report as R
from codeskel.sources.files import IGNORED_DIRS, SUPPORTED_EXTS
from codeskel.sources.tree import _Listing, list_tree, read_tree
from codeskel.streaming import stream as ST

from .test_skeleton import G1, G2, G4


def _files(spark):
    rows = [("r1", "a/pay.py", ".py", G1), ("r1", "b/x.ts", ".ts", G2), ("r2", "A.java", ".java", G4),
            ("r2", "node_modules/y.ts", ".ts", G2)]
    return spark.createDataFrame(rows, "repo string, path string, ext string, content string")


def test_stream_skeletons_equal_batch(spark):
    files = _files(spark)
    folder = ST.stage_files(files)
    streamed = sorted(tuple(r) for r in ST.stream_skeletons(spark, folder, files_per_trigger=1).select("repo", "path", "skeleton", *METRIC_COLUMNS).collect())
    scanned = files.filter(~F.col("path").startswith("node_modules/"))
    batch = sorted(tuple(r) for r in skeletonize(scanned, keep_content=False).select("repo", "path", "skeleton", *METRIC_COLUMNS).collect())
    assert streamed == batch


def test_stream_totals_equal_batch(spark):
    files = _files(spark)
    folder = ST.stage_files(files)
    got = {r.repo: (r.total_files_scanned, r.total_raw_tokens) for r in ST.stream_scan_totals(spark, folder).collect()}
    m = skeletonize(files.filter(~F.col("path").startswith("node_modules/")), keep_content=False)
    want = {r.repo: (r.n, r.raw) for r in m.groupBy("repo").agg(F.count("*").alias("n"), F.sum("raw_tokens_est").alias("raw")).collect()}
    assert got == want


def test_a_new_scan_replaces_the_totals_of_the_repo(spark):
    files = _files(spark)
    folder = ST.stage_files(files.repartition(3), scan_id=1)
    ST.stage_files(files.filter("repo = 'r1'").coalesce(1), folder, scan_id=2)
    ST.stage_files(files.filter("path = 'b/x.ts'").coalesce(1), folder, scan_id=0)  # an older scan that comes late
    want = {"r1": 2, "r2": 1}
    for per_trigger in (1, None):
        got = ST.stream_scan_totals(spark, folder, per_trigger)
        assert got.columns == ["repo", "total_files_scanned", "total_raw_tokens", "total_skeleton_tokens"]
        assert {r.repo: r.total_files_scanned for r in got.collect()} == want


def _tree(tmp_path):
    base = tmp_path / "repoA"
    for d in ("pkg", "node_modules/x", ".git", "src/build"):
        (base / d).mkdir(parents=True)
    (base / "pkg" / "__init__.py").write_text("")
    (base / ".hidden").write_text("h")
    (base / "_private.py").write_bytes(b"ok\xffbad\r\nnext")
    (base / "node_modules/x/z.js").write_text("z")
    (base / "src/build/o.py").write_text("o")
    (base / "gone.py").symlink_to(base / "nowhere.py")
    (base / "loop.py").symlink_to(base / "loop.py")
    (base / "pkg/up").symlink_to(base)  # a link to a directory above is not followed
    (tmp_path / "repoB").mkdir()
    (tmp_path / "repoB" / "b.PY").write_text("b")
    return base


def test_tree_source_reads_every_file(spark, tmp_path):
    _tree(tmp_path)
    rows = {(r.repo, r.path): r for r in read_tree(spark, str(tmp_path)).collect()}
    read = {k: r.content for k, r in rows.items() if r.status != "unreadable"}
    assert read == {
        ("repoA", "pkg/__init__.py"): "", ("repoA", ".hidden"): "h", ("repoA", "_private.py"): "okbad\nnext",
        ("repoA", "node_modules/x/z.js"): "z", ("repoA", "src/build/o.py"): "o", ("repoB", "b.PY"): "b",
    }
    assert rows["repoA", "_private.py"].status == "repaired" and rows["repoA", ".hidden"].status == "ok"
    bad = {k[1]: r for k, r in rows.items() if r.status == "unreadable"}
    assert set(bad) == {"gone.py", "loop.py"} and all(r.error and r.content is None for r in bad.values())
    assert read_tree(spark, f"file://{tmp_path}").count() == len(rows)
    assert read_tree(spark, str(tmp_path / "nothing")).count() == 0


def test_tree_source_leaves_subtrees_and_extensions_unread(spark, tmp_path):
    base = _tree(tmp_path)
    wanted = read_tree(spark, str(tmp_path), extensions=SUPPORTED_EXTS, skip_dirs=IGNORED_DIRS)
    assert sorted((r.repo, r.path) for r in wanted.collect()) == [
        ("repoA", "_private.py"), ("repoA", "gone.py"), ("repoA", "loop.py"), ("repoA", "pkg/__init__.py"), ("repoB", "b.PY")]
    # the filter is part of the walk, and ignored directories are never listed
    listing = _Listing({"path": str(tmp_path), "skipDirs": "/".join(IGNORED_DIRS)})
    assert list(listing.pushFilters([EqualTo(("repo",), "repoA"), In(("ext",), (".py",)), EqualTo(("full_path",), "x")])) == [EqualTo(("full_path",), "x")]
    walked = [n for p in listing.partitions() for b in listing.read(p) for n in b.column("full_path").to_pylist()]
    assert sorted(os.path.basename(n) for n in walked) == ["__init__.py", "_private.py", "gone.py", "loop.py"]
    os.chmod(base / "node_modules", 0)  # not even listed: nothing to trip over
    assert list_tree(spark, str(tmp_path), IGNORED_DIRS).filter("ext = '.py'").count() == 5


def test_files_that_cannot_be_read_are_isolated(spark, tmp_path):
    """Banners in the map, read-error answers, and no part in totals and searches."""
    _tree(tmp_path)
    files = read_tree(spark, str(tmp_path), extensions=SUPPORTED_EXTS, skip_dirs=IGNORED_DIRS)
    metrics = R.scanned_metrics(files)
    assert {r.path for r in metrics.collect()} == {"_private.py", "pkg/__init__.py", "b.PY"}
    rows = {(r.repo, r.path): r.entry for r in R.skeleton_map(metrics, R.failed_files(files)).collect()}
    assert "Files Scanned: 2 " in rows["repoA", None]
    assert rows["repoA", "gone.py"].startswith("--- FILE: gone.py (Error parsing: ") and rows["repoA", "gone.py"].endswith(") ---")
    asked = spark.createDataFrame([("repoA", "gone.py", "f"), ("repoA", "none.py", "f"), ("repoA", "_private.py", "f")], "repo string, path string, method string")
    got = {r.path: r for r in method_bodies(files, asked).collect()}
    assert [got[p].status for p in ("gone.py", "none.py", "_private.py")] == ["read error", "file not found", "method not found"]
    assert got["gone.py"].result.startswith("Error reading 'gone.py': ")
    assert {r.path for r in searched_files(read_tree(spark, str(tmp_path))).collect()} == {
        "_private.py", "pkg/__init__.py", ".hidden", "b.PY"}


def test_map_sink_keeps_the_order(spark, tmp_path):
    """Entries of a repo, its files read in name order, are the map's text."""
    rows = [("r1", f"f{i:03d}.md", f"--- {i}\nline {i}\n") for i in range(200)] + [("r2", "a.md", "x\n"), ("r1", None, "head\n\n"), ("r2", None, "h\n\n")]
    df = spark.createDataFrame(rows, "repo string, path string, entry string").repartition(7)
    R.write_map(df, str(tmp_path / "map"), 5)
    for repo in ("r1", "r2"):
        text = "".join(p.read_text() for p in sorted((tmp_path / "map" / f"repo={repo}").glob("part-*")))
        mine = sorted((r for r in rows if r[0] == repo), key=lambda r: r[1] or "")
        assert text == mine[0][2] + "\n".join(e for _, _, e in mine[1:]) + "\n"
    assert len(list((tmp_path / "map" / "repo=r1").glob("part-*"))) > 1
    back = R.read_map(spark, str(tmp_path / "map"))
    assert back.filter("repo = 'r2'").count() == 4


def test_queries_that_read_the_corpus_once_keep_no_copy(spark, tmp_path):
    """The tree round trip and the streams read the corpus a single time; nothing stays persisted for them."""
    from codeskel.plans import queries as Q

    part = "select cast(id as long) p_partkey, 'B' p_brand, 'T' p_type, 1 p_size from range(10)"
    item = "select cast(id as long) l_orderkey, cast(id % 10 as long) l_partkey, cast(1 as long) l_suppkey, 1 l_linenumber, 1.0D l_extendedprice from range(30)"
    spark.sql(part).write.parquet(f"{tmp_path}/part.parquet")
    spark.sql(item).write.parquet(f"{tmp_path}/lineitem.parquet")
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert Q.scan_tree(spark, str(tmp_path)).count() == 10
    assert Q.stream_scan_totals(spark, str(tmp_path)).count() == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
