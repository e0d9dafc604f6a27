"""Queries skeletonize the files they need; filters on a metric do not repeat the work."""

from pyspark.sql import functions as F

from codeskel.operators.skeleton import skeletonize
from codeskel.plans import queries as Q


def _tables(spark, tmp_path):
    spark.range(40).selectExpr(
        "id as p_partkey", "concat('Brand#', id % 2) as p_brand", "'STEEL' as p_type", "cast(id % 7 as int) as p_size"
    ).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(200).selectExpr(
        "id as l_orderkey", "cast(id % 7 + 1 as int) as l_linenumber", "id % 40 as l_partkey", "id % 3 as l_suppkey",
        "cast(id as double) as l_extendedprice",
    ).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_queries_of_some_files_make_no_other_skeletons(spark, tmp_path):
    """The same rows as from the shared metrics, which these queries do not make."""
    sf = _tables(spark, tmp_path)
    key = (spark.sparkContext.applicationId, sf)
    names = ("skeleton_js_ts", "skeleton_c_like", "skeleton_python", "skeleton_map_sink")
    alone = {n: sorted(map(tuple, getattr(Q, n)(spark, sf).collect())) for n in names}
    assert key not in Q._METRICS
    assert len(alone["skeleton_js_ts"]) == 16 and len(alone["skeleton_map_sink"]) == 2
    Q.file_skeleton_metrics(spark, sf).count()
    assert key in Q._METRICS
    assert alone == {n: sorted(map(tuple, getattr(Q, n)(spark, sf).collect())) for n in names}


def test_filter_on_a_metric_stays_above_the_lines(spark):
    """A filter that is pushed below the skeleton would split the text anew for every line."""
    df = spark.createDataFrame([("r", "a.js", "function f(a) {\n  g(a);\n}"), ("r", "n.py", None)], "repo string, path string, content string")
    kept = skeletonize(df).filter(F.col("method_count") == 1)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(CASE WHEN (element_at(") == 2  # the text's lines, and the skeleton's
    assert [r.path for r in kept.collect()] == ["a.js"] and skeletonize(df).count() == 2
