"""Approximate nearest neighbours: a robust-pruned directed graph in each shard.

Different vectors (copies share a node) are dealt to shards of bounded size by hash. In a
shard, greedy searches over the growing graph propose neighbours for each node, and relaxed
distance pruning keeps a diverse few: a candidate goes if a neighbour kept before is nearer
to it, by the factor ``alpha``, than the node itself. Queries search every shard by beam,
in blocks, and the shards' best are put together. Inner products become distances by one
more coordinate, which fills every vector of a shard up to the longest one's length.

Searches run in lockstep: a block of them advances together in numpy. Nothing is sampled:
every vector is indexed, and the query set is stated (ids divisible by ``every``).

Defined cases: null vectors, vectors of zeros or with null or non-finite components, and
vectors of another length than the most frequent one take no part, nor do rows without id;
of rows that repeat an id each is a candidate, but none for a query of that id; equal
scores go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicpulse.session import saved, ship_package

SHARD_ROWS = 8192
QUERY_BLOCK = 4096
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
ALPHA = 1.2
_LOCKSTEP = 1024


def _distances(x: np.ndarray, of: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``of`` to its own rows ``to`` of ``x``."""
    near = x[to]
    cross = np.matmul(near, of[:, :, None])[:, :, 0]
    return (of**2).sum(axis=1)[:, None] + (near**2).sum(axis=2) - 2 * cross


def beam_search(
    x: np.ndarray, graph: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int, at_once: int = 4
) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query, nearest first: ids (-1: none), squared distances."""
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True  # where missing neighbours (-1) point
    ids = np.full((n, beam), -1)
    ids[:, : len(start)] = start
    dist = np.full((n, beam), np.inf, np.float32)
    dist[:, : len(start)] = _distances(x, queries, np.broadcast_to(start, (n, len(start))))
    seen[:, start] = True
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = ids[rows, order], dist[rows, order]
    done = ids < 0
    while True:
        open_rows = np.flatnonzero(~done.all(axis=1))
        if not len(open_rows):
            return ids, dist
        r = open_rows[:, None]
        # The nearest nodes not yet looked at; a row with fewer looks at some again, to no effect.
        pick = np.argsort(done[open_rows], axis=1, kind="stable")[:, :at_once]
        nodes = np.where(done[r, pick], -1, ids[r, pick])
        done[r, pick] = True
        around = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(open_rows), -1)
        around[seen[r, around]] = -1
        around = np.sort(around, axis=1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
        width = int((around >= 0).sum(axis=1).max())
        if not width:
            continue
        around = np.sort(around, axis=1)[:, -width:]
        seen[r, around] = True
        d = np.where(around >= 0, _distances(x, queries[open_rows], around), np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[open_rows], around], axis=1)
        all_dist = np.concatenate([dist[open_rows], d], axis=1)
        all_done = np.concatenate([done[open_rows], around < 0], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        k = np.arange(len(open_rows))[:, None]
        ids[open_rows], dist[open_rows], done[open_rows] = all_ids[k, order], all_dist[k, order], all_done[k, order]


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each node from its candidates (-1: none)."""
    candidates = np.where(candidates == nodes[:, None], -1, candidates)
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    d = np.where(candidates >= 0, _distances(x, x[nodes], candidates), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    rows = np.arange(len(nodes))
    candidates, d = candidates[rows[:, None], order], d[rows[:, None], order]
    near, alive = x[candidates], candidates >= 0
    norms = (near**2).sum(axis=2)
    out = np.full((len(nodes), degree), -1)
    for k in range(degree):
        first = alive.argmax(axis=1)
        found = alive[rows, first]
        if not found.any():
            break
        out[found, k] = candidates[rows[found], first[found]]
        picked = near[rows, first]
        apart = norms + (picked**2).sum(axis=1)[:, None] - 2 * np.matmul(near, picked[:, :, None])[:, :, 0]
        alive &= ~(found[:, None] & (alpha**2 * apart <= d))
        alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of each row of ``x`` (-1: none): two rounds of search, prune and reverse edges."""
    n = len(x)
    random = np.random.default_rng(n)
    graph = np.full((n, degree), -1)
    if n > 1:
        some = random.integers(0, n - 1, (n, min(degree, n - 1)))
        graph[:, : some.shape[1]] = some + (some >= np.arange(n)[:, None])
    start = entry_points(x)
    for relax in (1.0, alpha):
        shuffled = random.permutation(n)
        for at in range(0, n, _LOCKSTEP):
            nodes = shuffled[at : at + _LOCKSTEP]
            found, _ = beam_search(x, graph, start, x[nodes], beam)
            graph[nodes] = robust_prune(x, nodes, np.concatenate([found, graph[nodes]], axis=1), relax, degree)
            _reverse(x, graph, nodes, relax)
    return graph


def _reverse(x: np.ndarray, graph: np.ndarray, nodes: np.ndarray, alpha: float) -> None:
    """Add an edge back from each neighbour of ``nodes``; what overflows is pruned."""
    to = graph[nodes].ravel()
    back = np.repeat(nodes, graph.shape[1])[to >= 0]
    to = to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    target, first, count = np.unique(to, return_index=True, return_counts=True)
    order = np.argsort(count, kind="stable")
    at = 0
    while at < len(order):
        # Targets with about as many new edges share a matrix; a crowded one gets a matrix of few rows.
        width = int(count[order[min(at + 255, len(order) - 1)]])
        rows = max(1, min(256, (1 << 15) // width))
        some = order[at : at + rows]
        at += rows
        width = int(count[some].max())
        new = np.full((len(some), width), -1)
        r = np.repeat(np.arange(len(some)), count[some])
        c = np.arange(len(r)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
        new[r, c] = back[np.repeat(first[some], count[some]) + c]
        graph[target[some]] = robust_prune(
            x, target[some], np.concatenate([graph[target[some]], new], axis=1), alpha, graph.shape[1]
        )


def entry_points(x: np.ndarray, several: int = 8) -> np.ndarray:
    """The node nearest to the mean, and a few spread over the shard."""
    middle = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    return np.unique(np.append(np.linspace(0, len(x) - 1, min(several, len(x))).astype(int), middle))


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors with a coordinate that makes all as long as the longest."""
    size = (x.astype(float) ** 2).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(size.max() - size, 0))]).astype(np.float32)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(node, vec_id, embedding): of rows with equal vectors the ``k`` smallest ids, and the least as node."""
    same = Window.partitionBy("embedding")
    least = rows.withColumn("n", F.row_number().over(same.orderBy("vec_id"))).filter(F.col("n") <= k)
    return least.withColumn("node", F.min("vec_id").over(same)).select("node", "vec_id", "embedding")


def valid_vectors(table: DataFrame) -> DataFrame:
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    rows = rows.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(finite)
    rows = rows.filter(F.exists("embedding", lambda v: v != 0))
    size = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1)
    return rows.join(F.broadcast(size.select("size")), F.size("embedding") == F.col("size")).drop("size")  # one row


def search(
    table: DataFrame, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of the largest inner product found for each query."""
    spark = table.sparkSession
    ship_package(spark)
    rows = saved(valid_vectors(table), "vectors")
    members = saved(distinct_vectors(rows, k + 1), "vector-nodes")
    asked = saved(rows.filter(F.col("vec_id") % every == 0).groupBy("embedding").agg(F.min("vec_id").alias("asked")), "queries")
    nodes = members.filter("node = vec_id").dropDuplicates(["node"]).select("node", "embedding")
    n_nodes, n_asked = nodes.count(), asked.count()
    shards, query_blocks = max(-(-n_nodes // shard_rows), 1), max(-(-n_asked // query_block), 1)

    def build(group: pa.Table) -> pa.Table:
        group = group.take(np.argsort(group.column("node").to_numpy(), kind="stable"))
        graph = build_graph(lifted(_matrix(group.column("embedding"))))
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(0, graph.size + 1, graph.shape[1], dtype=np.int32)), pa.array(graph.ravel().astype(np.int32))
        )
        return group.append_column("near", lists)

    graph_schema = "node long, embedding array<float>, shard int, near array<int>"
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    graph = saved(dealt.groupBy("shard").applyInArrow(build, graph_schema), "graph")

    def look(shard: pa.Table, block: pa.Table) -> pa.Table:
        names = ["asked", "node", "score"]
        if not shard.num_rows or not block.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        shard = shard.take(np.argsort(shard.column("node").to_numpy(), kind="stable"))
        vectors, node = _matrix(shard.column("embedding")), shard.column("node").to_numpy()
        x, near = lifted(vectors), _matrix(shard.column("near"))
        wanted, ids = _matrix(block.column("embedding")), block.column("asked").to_numpy()
        out = []
        for at in range(0, len(ids), _LOCKSTEP):
            q = wanted[at : at + _LOCKSTEP]
            flat = np.column_stack([q, np.zeros(len(q), np.float32)])
            found, _ = beam_search(x, near, entry_points(x), flat, SEARCH_BEAM)
            score = np.einsum("bkd,bd->bk", vectors[found].astype(float), q.astype(float))
            score[found < 0] = -np.inf
            order = np.lexsort((node[found], -score), axis=1)[:, : k + 1]
            r = np.arange(len(q))[:, None]
            full = found[r, order] >= 0
            asked_ids = np.broadcast_to(ids[at : at + len(q), None], full.shape)
            out.append((asked_ids[full], node[found[r, order]][full], score[r, order][full]))
        return pa.table(dict(zip(names, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    every_block = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    every_shard = asked.withColumn("block", F.pmod(F.xxhash64("asked"), F.lit(query_blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    found = (
        every_block.groupBy("shard", "block")
        .cogroup(every_shard.groupBy("shard", "block"))
        .applyInArrow(look, "asked long, node long, score double")
    )
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "node")
    found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    lists = (
        found.join(members.select("node", "vec_id"), "node")
        .withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
        .groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("list"))
    )
    lists = saved(lists, "neighbour-lists")  # k + 1 entries each
    queries = rows.filter(F.col("vec_id") % every == 0).join(asked, "embedding").select(F.col("vec_id").alias("query_id"), "asked")
    others = F.slice(F.filter("list", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    return (
        queries.join(lists, "asked")
        .select("query_id", F.posexplode(others).alias("at", "e"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")
    )


def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return search(spark.read.parquet(f"{folder}/embeddings.parquet"))


QUERIES = {"op5_neighbours": op5_neighbours}
ORACLE_SQL: dict[str, str] = {}
