"""Mixing sources to target weights (DataFrame functions only).

Every document gets a random but repeatable key, the MD5 of a seed and its id.
Inside a source the documents are ordered by key; the first ``K`` digits of the
key are the range a document falls into, so ranges are even whatever the
source's size.  The mix takes whole passes ("epochs") over a source and then the
documents up to the cut, where the running sum of sizes reaches the budget:

1. sizes are summed per (source, range), combined map-side;
2. a running sum over a source's ranges finds the range that holds the cut;
3. only that range's rows are summed in key order, which gives the key at the cut;
4. each row compares its key with its source's cut -- a small table, one row per
   source -- so no row of a hot source moves to a task of that source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hexadecimal digits of the key that name a range: 16**3 ranges per source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words of ``text`` between ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def mix_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Targets share the total by weight; a target stops at ``max_epochs`` times its
    source's size and the excess is shared again by weight among the others.
    With sources ordered by size per weight this has a closed form: a source is
    capped if the level reached when it and all later ones share what is left
    exceeds its cap.  One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(max_epochs)
    ranked = sizes.withColumn("w", w).withColumn("cap", cap).withColumn("total", F.sum("source_size").over(every))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = ranked.withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("w").over(after),
    ).withColumn("capped", F.col("cap").cast("double") < F.col("level") * F.col("w")).withColumn("pos", F.row_number().over(order))
    # past the first uncapped source no later one is capped; the level at the first one holds for all of them
    final = F.min(F.when(~F.col("capped"), F.struct("pos", "level"))).over(every)["level"]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), final * F.col("w"))
    )
    return levels.select("source", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per source: ``source, source_size, target, epochs, cut_key, cut_size, cut_words``.

    A document is taken ``epochs`` times whole, once more if its ``(key, size)``
    is below the cut, and ``cut_words`` words of it once more if it is at the cut
    (rows that share an id and a size share the cut evenly).
    """
    base = cut(
        docs.select("source", mix_key(F.col("doc_id"), seed).alias("key"), word_count(F.col("text")).alias("size")),
        "mix-keys",
    ).withColumn("rng", F.substring("key", 1, RANGE_DIGITS))
    ranges = cut(base.groupBy("source", "rng").agg(F.sum("size").alias("words")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    plan = cut(
        targets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "mix-plan"
    )

    def crossing(df: DataFrame, keys: list[str]) -> DataFrame:
        """The row of each source where the running sum of ``words`` passes ``rest``."""
        w = Window.partitionBy("source").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = df.withColumn("upto", F.sum("words").over(w)).withColumn("before", F.col("upto") - F.col("words"))
        return run.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("upto"))).withColumn(
            "rest", F.col("rest") - F.col("before")
        )

    def with_rest(df: DataFrame, rest: DataFrame, on: list[str]) -> DataFrame:
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        return df.alias("l").join(rest.alias("r"), cond).select("l.*", "r.rest")

    at_range = crossing(with_rest(ranges, plan.filter("rest > 0").select("source", "rest"), ["source"]), ["rng"])
    inside = with_rest(base, at_range.select("source", "rng", "rest"), ["source", "rng"])
    keyed = inside.groupBy("source", "rest", "key", "size").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    at_key = crossing(keyed.filter("words > 0"), ["key", "size"]).select(
        F.col("source").alias("c_source"),
        F.col("key").alias("cut_key"),
        F.col("size").alias("cut_size"),
        F.floor(F.col("rest") / F.col("n")).cast("long").alias("cut_words"),
    )
    cuts = plan.join(at_key, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source", "rest")
    return cut(cuts, "mix-cuts")  # as a table of known size it is broadcast to the documents where that is small


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` plus ``mix_size, mix_source_size, mix_target, mix_copies, mix_cut_words``.

    ``mix_copies`` is how often the whole document is taken, ``mix_cut_words`` how
    many of its first words are taken once more (the one document per source at
    the budget's edge; else 0).  All input columns and rows stay.

    Null text has size 0; null source is a source of its own, last in order; null
    ids share a key; an empty table gives no rows; a source without words gets
    target 0.  Equal seeds give equal mixes.
    """
    plan = plan_mix(docs, weights, max_epochs, seed).select(
        F.col("source").alias("_m_source"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.col("epochs").alias("_m_epochs"),
        F.col("cut_key").alias("_m_key"),
        F.col("cut_size").alias("_m_size"),
        F.col("cut_words").alias("_m_words"),
    )
    mine = F.struct(F.col("_key").alias("k"), F.col("mix_size").alias("s"))
    edge = F.struct(F.col("_m_key").alias("k"), F.col("_m_size").alias("s"))
    has = F.col("_m_key").isNotNull()
    keyed = docs.withColumn("mix_size", word_count(F.col("text"))).withColumn("_key", mix_key(F.col("doc_id"), seed))
    joined = keyed.join(plan, keyed["source"].eqNullSafe(F.col("_m_source")))
    return (
        joined.withColumn("mix_copies", F.col("_m_epochs") + F.when(has & (mine < edge), 1).otherwise(0))
        .withColumn("mix_cut_words", F.when(has & (mine == edge), F.col("_m_words")).otherwise(0).cast("long"))
        .drop("_m_source", "_m_epochs", "_m_key", "_m_size", "_m_words", "_key")
    )


def expand(mixed: DataFrame) -> DataFrame:
    """The mixed documents themselves: whole copies, then the leading words at the cut."""
    cols = [c for c in mixed.columns if not c.startswith("mix_")]
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"[{SPACE}]*[^{SPACE}]+"), 0)
    lead = F.array_join(F.slice(pieces, 1, F.col("mix_cut_words").cast("int")), "")
    parts = F.concat(
        F.when(F.col("mix_copies") > 0, F.array_repeat(F.lit(False), F.col("mix_copies").cast("int"))).otherwise(
            F.array().cast("array<boolean>")
        ),
        F.when(F.col("mix_cut_words") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")),
    )
    out = mixed.withColumn("_part", F.explode(parts))
    return out.withColumn("text", F.when(F.col("_part"), lead).otherwise(F.col("text"))).select(*cols)


def op9_mix(spark, sf_dir: str) -> DataFrame:
    """Contract query: the mix of all documents, one row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs.select("doc_id", "source", "text")).drop("text")
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size") + F.col("mix_cut_words")).alias("taken"),
        "source",
    )


OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^{SPACE}]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         source_size * {MAX_EPOCHS} AS cap, sum(source_size) OVER () AS total
  FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
c AS (SELECT *, cap::DOUBLE < level * w AS capped, row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS pos FROM l),
f AS (SELECT arg_min(level, pos) AS level FROM c WHERE NOT capped),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE least(cap::DOUBLE, f.level * w) END AS target
  FROM c, f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs,
         floor(target + 0.5)::BIGINT AS budget
  FROM t),
run AS (
  SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken,
       run.source AS source
FROM run JOIN p ON run.source IS NOT DISTINCT FROM p.source
"""
