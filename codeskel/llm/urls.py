"""URL filters: rules first, then a path-template tree with smoothed labelled purity.

Urls that a rule decides are the labelled examples.  Per host, paths form a tree of
segments:

* digit runs and long hexadecimal runs become wildcards in each segment's shape;
* below a node whose children are many and mostly rare, all children become ``*``;
* sibling branches whose shares of blocked urls do not differ significantly (two-
  proportion z test of neighbours in order of their shares) are pooled;
* a branch's purity is its blocked share, smoothed by its parent's purity as
  :data:`PRIOR` examples (the root's: the share over all urls).

A url is blocked if its template's purity reaches :data:`BLOCK_AT`.  Urls are first
counted by host and shape, combined map-side; the tree is built level by level on
these counts, one small table per level, so a host with a third of all pages is no
hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, lower_ascii

#: Fixed values of the contract: rules as host and path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Levels of the tree; deeper segments share the last one.
MAX_DEPTH = 8
#: A node with at least so many children, of fewer urls on average, has variable children.
MANY_CHILDREN, FEW_URLS = 16, 4.0
Z = 1.96
PRIOR = 5.0
BLOCK_AT = 0.8


def _after_scheme(url: Column) -> Column:
    return F.regexp_extract(F.when(F.instr(url, "://") > 0, url), r"(?s)^.*?://(.*)$", 1)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits (ties: the first in spelling), or null.

    Rules are configuration; they become one expression per row.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def path_shape(path: Column) -> Column:
    """The path's segments, at most :data:`MAX_DEPTH`, with variable runs as wildcards."""
    general = F.regexp_replace(F.regexp_replace(path, r"[0-9a-fA-F]{16,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "{h}"), r"[0-9]+", "{n}")
    return F.split(general, "/", MAX_DEPTH)


def template_purity(counts: DataFrame) -> DataFrame:
    """``host, shape, n, labelled, blocked`` to ``host, shape, template, purity``."""
    share = counts.agg((F.sum("blocked") / F.sum("labelled")).alias("p")).first()["p"] or 0.0
    depth = counts.agg(F.max(F.size("shape"))).first()[0] or 0
    level = cut(counts.withColumn("template", F.lit("")).withColumn("purity", F.lit(float(share))), "urls-0")
    for d in range(-1, depth):
        # the children of level -1, the root, are the hosts
        here = level.withColumn("seg", F.col("host") if d < 0 else F.get("shape", F.lit(d)))
        branch = here.filter("seg is not null").groupBy("host", "template", "purity", "seg").agg(
            *[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
        )
        if d >= 0:
            node = Window.partitionBy("host", "template")
            variable = (F.count(F.lit(1)).over(node) >= MANY_CHILDREN) & (F.avg("n").over(node) < FEW_URLS)
            branch = branch.withColumn("child", F.when(variable, "*").otherwise(F.col("seg")))
        else:
            branch = branch.withColumn("child", F.col("seg"))
        branch = cut(branch, "branches")
        # hosts are judged each by itself; below them, similar siblings are pooled
        node = ["host", "template"]
        child = branch.groupBy(*node, "child").agg(
            F.first("purity").alias("above"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")
        )
        rate = F.when(F.col("labelled") > 0, F.col("blocked") / F.col("labelled")).otherwise(-1.0)
        child = child.withColumn("rate", rate)
        order = Window.partitionBy(*node).orderBy("rate", "child")
        n0, b0 = F.lag("labelled").over(order), F.lag("blocked").over(order)
        pool = (b0 + F.col("blocked")) / (n0 + F.col("labelled"))
        spread = F.sqrt(pool * (1 - pool) * (1 / n0 + 1 / F.col("labelled")))
        differs = n0.isNull() | (n0 == 0) | (F.col("rate") - b0 / n0 > Z * spread)
        child = child.withColumn("new", F.when(F.col("labelled") == 0, 0).otherwise(differs.cast("int")))
        child = child.withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        group = Window.partitionBy(*node, "group", F.col("labelled") == 0)
        labelled, blocked = F.sum("labelled").over(group), F.sum("blocked").over(group)
        judged = child.select(
            *[F.col(c).alias(f"j_{c}") for c in (*node, "child")],
            ((blocked + PRIOR * F.col("above")) / (labelled + PRIOR)).alias("j_purity"),
        )
        step = branch.select(*[F.col(c).alias(f"b_{c}") for c in (*node, "seg")], "child").join(
            judged, (F.col("b_host") == F.col("j_host")) & (F.col("b_template") == F.col("j_template")) & (F.col("child") == F.col("j_child"))
        ).select("b_host", "b_template", "b_seg", "child", "j_purity")
        grown = here.join(
            step, (F.col("host") == F.col("b_host")) & (F.col("template") == F.col("b_template")) & (F.col("seg") == F.col("b_seg")), "left"
        )
        ended = F.col("seg").isNull()
        new = cut(
            grown.select(
                "host", "shape", "n", "labelled", "blocked",
                F.when(ended, F.col("template")).otherwise(
                    F.col("template") if d < 0 else F.concat("template", F.lit("/"), "child")
                ).alias("template"),
                F.when(ended, F.col("purity")).otherwise(F.col("j_purity")).alias("purity"),
            ),
            "urls",
        )
        drop(level)
        drop(branch)
        level = new
    return level.select("host", "shape", "template", "purity")


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``pages (page_id, url)``: ``page_id, host, path, rule, verdict, template, purity``.

    Null urls and urls without ``://`` have an empty host and path; they and urls of
    hosts without labelled urls are judged by the share of all urls.  Repeated rows
    count each; an empty table gives no rows.
    """
    found = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    base = found.select("page_id", "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("r"), path_shape(F.col("path")).alias("shape"))
    base = cut(base.select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"), "shape"), "pages")
    counts = base.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked")
    )
    tree = template_purity(cut(counts, "counts")).select(F.col("host").alias("t_host"), F.col("shape").alias("t_shape"), "template", "purity")
    method = F.when(F.col("purity") >= BLOCK_AT, "block").otherwise("allow")
    return base.join(tree, (F.col("host") == F.col("t_host")) & (F.col("shape") == F.col("t_shape"))).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity"
    )


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every page's url judged."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
