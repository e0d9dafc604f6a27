"""Approximate nearest neighbours by cosine: a robust-pruned directed graph per shard.

Vectors are hashed into shards of about :data:`SHARD_ROWS`.  A task builds one
shard's graph in batches of growing size: greedy beam searches over the graph so far
propose neighbours for each new vector; robust pruning walks them from near to far
and drops whoever is closer, by the factor :data:`ALPHA`, to a kept neighbour than
to the vector itself, so kept edges point in diverse directions; reverse edges are
added and pruned the same way.  The written index has a row per vector.

A search sends every query to every shard, where a beam search walks the graph; the
shards' nearest are merged.  A shard's index is held by one task at a time, and its
queries stream past it in blocks.

Equal vectors are one node, which keeps the ids that a result can show: the ``k + 1``
smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, ship

SHARD_ROWS = 8192
#: Edges per node after pruning, and slots before a node is pruned again.
DEGREE, SLOTS = 48, 72
#: Relaxation of the pruning rule (distances, not squares).
ALPHA = 1.2
#: Beam of searches while building and while querying, and nodes expanded at once.
BUILD_BEAM, QUERY_BEAM, WIDTH = 96, 256, 4
BATCH = 512
NEIGHBOURS = 5
QUERY_STEP = 50

INDEX_SCHEMA = "dim int, shard int, pos int, entry int, vector array<double>, ids array<long>, edges array<int>"
FOUND_SCHEMA = "query_id long, vec_id long, score double"


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes nearest to each unit query and their squared distances, nearest first (-1: none).

    All queries advance together; each expands its :data:`WIDTH` nearest unexpanded
    nodes until its beam holds none.
    """
    m = len(q)
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf)
    done = np.ones((m, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = 2 - 2 * (q @ x[start])
    seen = np.zeros((m, len(x) + 1), bool)  # the last column stands for "no node"
    seen[:, start] = seen[:, -1] = True
    rows = np.arange(m)
    while len(rows):
        open_ = np.where(done[rows], np.inf, dist[rows])
        pick = np.argpartition(open_, WIDTH - 1, axis=1)[:, :WIDTH] if beam > WIDTH else np.argsort(open_, axis=1)
        real = np.isfinite(np.take_along_axis(open_, pick, 1))
        live = real.any(axis=1)
        rows, pick, real = rows[live], pick[live], real[live]
        if not len(rows):
            break
        nodes = np.where(real, ids[rows[:, None], pick], -1)
        done[rows[:, None], pick] = True
        new = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(rows), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[rows[:, None], new]] = -1
        keep = int((new >= 0).sum(axis=1).max())
        if not keep:
            continue
        new = -np.partition(-new, keep - 1, axis=1)[:, :keep] if keep < new.shape[1] else new
        seen[rows[:, None], new] = True
        far = 2 - 2 * np.matmul(x[new], q[rows][:, :, None])[:, :, 0]
        far[new < 0] = np.inf
        all_ids = np.concatenate((ids[rows], new), axis=1)
        all_dist = np.concatenate((dist[rows], far), axis=1)
        all_done = np.concatenate((done[rows], new < 0), axis=1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        ids[rows], dist[rows], done[rows] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_dist, all_done))
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """For each point the kept candidates (``cand`` holds -1 for none), padded with -1."""
    dist = 2 - 2 * np.matmul(x[cand], x[points][:, :, None])[:, :, 0]
    dist[(cand < 0) | (cand == points[:, None])] = np.inf
    order = np.argsort(dist, axis=1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    near = x[cand]
    between = 2 - 2 * np.matmul(near, near.transpose(0, 2, 1))
    alive = np.isfinite(dist)
    out = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    for r in range(degree):
        first = alive.argmax(axis=1)
        ok = alive[rows, first]
        if not ok.any():
            break
        out[ok, r] = cand[ok, first[ok]]
        alive &= ALPHA * ALPHA * between[rows, first] > dist
        alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """Edges (padded with -1) and the entry node for unit vectors."""
    n = len(x)
    edges = np.full((n, SLOTS), -1, np.int64)
    mean = x.mean(axis=0)
    entry = int((x @ mean).argmax())
    order = np.random.Generator(np.random.PCG64(seed)).permutation(n)
    order = order[order != entry]
    at, size = 0, 1
    while at < len(order):
        points = order[at : at + size]
        at, size = at + len(points), min(2 * size, BATCH)
        found, _ = beam_search(x, edges, entry, x[points], BUILD_BEAM)
        edges[points, :DEGREE] = robust_prune(x, points, found)
        _add_reverse(x, edges, points)
    full = np.flatnonzero((edges >= 0).sum(axis=1) > DEGREE)
    for lo in range(0, len(full), BATCH):
        part = full[lo : lo + BATCH]
        kept = robust_prune(x, part, edges[part])
        edges[part] = -1
        edges[part, :DEGREE] = kept
    return edges[:, :DEGREE], entry


def _add_reverse(x: np.ndarray, edges: np.ndarray, points: np.ndarray) -> None:
    """Add the edges back to ``points``; nodes without a free slot are pruned."""
    src = np.repeat(points, DEGREE)
    dst = edges[points, :DEGREE].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    by = np.argsort(dst, kind="stable")
    src, dst = src[by], dst[by]
    nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
    have = (edges[nodes] >= 0).sum(axis=1)
    rank = np.arange(len(dst)) - np.repeat(first, count)
    fits = np.repeat(have + count <= SLOTS, count)
    edges[dst[fits], (np.repeat(have, count) + rank)[fits]] = src[fits]
    over = np.flatnonzero(have + count > SLOTS)
    over = over[np.argsort(count[over], kind="stable")]  # similar widths together
    for lo in range(0, len(over), BATCH // 4):
        part = over[lo : lo + BATCH // 4]
        wide = int(count[part].max())
        new = np.full((len(part), wide), -1, np.int64)
        for i, j in enumerate(part.tolist()):
            new[i, : count[j]] = src[first[j] : first[j] + count[j]]
        kept = robust_prune(x, nodes[part], np.concatenate((edges[nodes[part]], new), axis=1))
        edges[nodes[part]] = -1
        edges[nodes[part], :DEGREE] = kept


def _build(table: pa.Table) -> pa.Table:
    """One shard's nodes to its index rows."""
    x = np.array(table.column("vector").to_pylist(), np.float64)
    edges, entry = build_graph(_unit(_scaled(x)))
    n = len(x)
    return pa.table(
        {
            "dim": table.column("dim"),
            "shard": table.column("shard"),
            "pos": pa.array(np.arange(n), pa.int32()),
            "entry": pa.array(np.full(n, entry), pa.int32()),
            "vector": table.column("vector"),
            "ids": table.column("ids"),
            "edges": pa.array([e[e >= 0] for e in edges], pa.list_(pa.int32())),
        }
    )


class _Shard:
    """A shard's index, collected row by row, then searched."""

    def __init__(self):
        self.rows: list[dict] = []
        self.x = None

    def search(self, qids: list[int], q: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        if not self.rows and self.x is None:
            return
        if self.x is None:
            self.x = _scaled(np.array([r["vector"] for r in self.rows], np.float64))
            self.norm = np.sqrt((self.x * self.x).sum(axis=1))
            self.unit = _unit(self.x)
            self.edges = np.full((len(self.rows), DEGREE), -1, np.int64)
            for r in self.rows:
                self.edges[r["pos"], : len(r["edges"])] = r["edges"]
            self.ids = [r["ids"] for r in self.rows]
            self.entry, self.rows = self.rows[0]["entry"], []
        q = _scaled(q)
        found, _ = beam_search(self.unit, self.edges, self.entry, _unit(q), QUERY_BEAM)
        for i, (qid, v) in enumerate(zip(qids, q)):
            near = found[i][found[i] >= 0]
            cos = (self.x[near] * v).sum(axis=1) / (self.norm[near] * np.sqrt((v * v).sum()))
            hits = [(-float(c), d) for c, p in zip(cos, near.tolist()) for d in self.ids[p] if d != qid]
            for c, d in sorted(hits)[:k]:
                yield qid, d, -c


def _searcher(k: int):
    """Arrow batches of index rows (query_id null) and then queries, shard by shard, to what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, _Shard()
        qids: list[int] = []
        vectors: list[list[float]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(shard.search(qids, np.array(vectors, np.float64), k)) if qids else []
            qids.clear()
            vectors.clear()
            if rows:
                a, b, c = zip(*rows)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], names=["query_id", "vec_id", "score"])

        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                for r in b.slice(lo, 1024).to_pylist():
                    if (r["dim"], r["shard"]) != key:
                        yield from flush()
                        key, shard = (r["dim"], r["shard"]), _Shard()
                    if r["query_id"] is None:
                        shard.rows.append(r)
                    else:
                        qids.append(r["query_id"])
                        vectors.append(r["vector"])
                        if len(qids) >= BATCH:
                            yield from flush()
        yield from flush()

    return run


def usable(v: Column) -> Column:
    """Not null, not zero, all components finite numbers."""
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda e: e != 0), F.lit(False))


def _vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column).cast("array<double>")
    out = df.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector"))
    return out.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))


def build_index(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """The written index of all usable vectors, one row per distinct vector.

    Vectors of different lengths are indexed apart.  Rows that are null, zero or hold
    null or non-finite components, and rows without id, take no part.
    """
    ship(df.sparkSession)
    rows = _vectors(df, id_column, vector_column)
    first = Window.partitionBy("vector").orderBy("vec_id")
    nodes = cut(
        rows.distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("dim", F.size("vector")),
        "nodes",
    )
    shards = max(1, -(-nodes.count() // SHARD_ROWS))
    placed = nodes.select("dim", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), "vector", "ids")
    return cut(placed.groupBy("dim", "shard").applyInArrow(_build, INDEX_SCHEMA), "index")


def search(index: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries (vec_id, vector)``: the ``k`` nearest found.

    Every query visits every shard of its length; a query's own id is no candidate;
    ties go to the smaller id.
    """
    ship(index.sparkSession)
    places = index.select("dim", "shard").distinct()
    asked = queries.withColumn("dim", F.size("vector")).join(places, "dim")
    none = lambda kind: F.lit(None).cast(kind)
    both = index.withColumn("query_id", none("long")).unionByName(
        asked.select(
            "dim", "shard", none("int").alias("pos"), none("int").alias("entry"), "vector",
            none("array<long>").alias("ids"), none("array<int>").alias("edges"), F.col("vec_id").alias("query_id"),
        )
    )
    streamed = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", F.col("query_id").asc_nulls_first(), "pos")
    found = streamed.mapInArrow(_searcher(k), FOUND_SCHEMA).dropDuplicates(["query_id", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the five nearest of every vector whose id is divisible by 50, among all."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = _vectors(rows, "vec_id", "embedding").filter(F.col("vec_id") % QUERY_STEP == 0).distinct()
    return search(build_index(rows), queries)
