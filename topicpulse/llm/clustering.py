"""Centroid clustering over a vector approximation file.

Each component becomes a cell of a few bits: equal widths within three deviations of its
mean, open towards its least and greatest value. For given centroids, lookup tables hold by
component, cell and centroid the least and greatest contribution to the distance, less that
to one common reference point, which cancels in every comparison and makes the intervals
narrow. Summed over a vector's cells they give an interval for each centroid. Where one
centroid's interval lies below all others', the assignment is settled by the cells alone.

A round needs the sums of clusters, which change only by vectors that change cluster. So the
cells are looked up under the round's centroids and those before: where both settle on the
same cluster nothing is read; full vectors go to Python, and are compared exactly, only
where intervals overlap or the vector moved. The cells alone pass through the lookup, the
vector stays in the JVM. A round is one pass without a shuffle of vectors; a task's sums are
``clusters`` rows, and the driver gets clusters times components numbers.

Integer arithmetic throughout, so the result does not depend on the order of rows.

Defined cases: vectors of another length, null ones, ones with null or non-finite components,
and ones with a floor beyond 2^27 (whose distances no long can hold) take no part; rows that
repeat an id are vectors of their own, and of equal ids the smaller vector starts first;
rows without id take part but start no centroid; fewer vectors than clusters give as many
centroids; equal distances go to the smaller number; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicpulse.llm.vectors import SUMS, collected_sums, group_sums, integer_vectors, matrix, moved, sums_batch
from topicpulse.session import saved, ship_package

CLUSTERS = 8
ROUNDS = 10
COMPONENTS = 64
SCALE = 1024
SEED = 3
CELL_BITS = 6


@dataclass(frozen=True)
class Cells:
    """Least and greatest value by component and cell; cells of one component are equally wide inside."""

    start: np.ndarray
    width: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bits: int

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Cell numbers, packed to ``bits`` each; one row of bytes by vector."""
        cell = np.clip((vectors - self.start) // self.width, 0, (1 << self.bits) - 1).astype(np.uint8)
        return np.packbits(np.unpackbits(cell[:, :, None], axis=2)[:, :, 8 - self.bits :].reshape(len(cell), -1), axis=1)

    def decode(self, packed: np.ndarray) -> np.ndarray:
        """Cell numbers by component and vector."""
        bits = np.unpackbits(packed, axis=1, count=len(self.start) * self.bits).reshape(len(packed), -1, self.bits)
        return np.ascontiguousarray((bits @ (1 << np.arange(self.bits - 1, -1, -1))).T)


def fit_cells(rows: DataFrame, bits: int = CELL_BITS) -> Cells:
    """Cells from the mean, deviation and range of each component over all rows."""
    x = rows.select(F.posexplode("v").alias("pos", "x")).groupBy("pos")
    found = x.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev"), F.min("x").alias("least"), F.max("x").alias("most"))
    mean, dev, least, most = np.array([list(r)[1:] for r in found.orderBy("pos").collect()], float).T
    start = np.floor(mean - 3 * dev).astype(np.int64)
    width = np.maximum(np.ceil(6 * dev / (1 << bits)), 1).astype(np.int64)
    low = start[:, None] + np.arange(1 << bits) * width[:, None]
    high = low + width[:, None] - 1
    low[:, 0] = np.minimum(low[:, 0], least)
    high[:, -1] = np.maximum(high[:, -1], most)
    return Cells(start, width, low, high, bits)


@dataclass(frozen=True)
class Lookup:
    """Bounds of relative distances by component, cell and centroid."""

    cells: Cells
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, cells: Cells, centroids: np.ndarray) -> Lookup:
        common = centroids.sum(axis=0) // len(centroids)
        slope = -2 * (centroids - common).T[:, None, :]
        base = (centroids**2 - common**2).T[:, None, :]
        a, b = slope * cells.low[:, :, None] + base, slope * cells.high[:, :, None] + base
        return cls(cells, np.minimum(a, b), np.maximum(a, b))

    def settled(self, cell: np.ndarray) -> np.ndarray:
        """By vector: the cluster that its cells prove, or -1."""
        low = np.zeros((cell.shape[1], self.low.shape[2]), np.int64)
        high = low.copy()
        for component, at in enumerate(cell):
            low += self.low[component][at]
            high += self.high[component][at]
        best = high.argmin(axis=1)
        bar = high[np.arange(len(best)), best][:, None]
        # An equal distance goes to the smaller number.
        open_ = np.where(np.arange(low.shape[1]) < best[:, None], low <= bar, low < bar)
        open_[np.arange(len(best)), best] = False
        return np.where(open_.any(axis=1), -1, best)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector."""
    distance = np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(best)), best]


def _packed(codes: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)


def _settled_on(*lookups: Lookup):
    """Column function: the cluster all lookups settle on, or -1."""

    @F.pandas_udf("int")
    def settled(codes: pd.Series) -> pd.Series:
        if not len(codes):
            return pd.Series([], dtype="int32")
        cell = lookups[0].cells.decode(_packed(codes))
        found = np.stack([lookup.settled(cell) for lookup in lookups])
        return pd.Series(np.where((found == found[0]).all(axis=0), found[0], -1).astype(np.int32))

    return settled("code")


def approximated(rows: DataFrame, cells: Cells) -> DataFrame:
    """vec_id, code and v: the vectors beside their packed cells."""
    width = len(cells.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = cells.encode(matrix(batch.column("v"), width))
                code = pa.array([r.tobytes() for r in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), code, batch.column("v")], names=["vec_id", "code", "v"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, code binary, v array<int>")


def changes(file: DataFrame, cells: Cells, before: np.ndarray | None, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How counts and sums of the clusters change from ``before`` to ``centroids`` (None: from nothing)."""
    width, k = centroids.shape[1], len(centroids)
    read = file
    if before is not None:
        read = file.filter(_settled_on(Lookup.of(cells, centroids), Lookup.of(cells, before)) < 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"), width)
                now, _ = nearest(v, centroids)
                if before is not None:
                    then, _ = nearest(v, before)
                    go = now != then
                    v, now, then = v[go], now[go], then[go]
                    less_n, less = group_sums(v, then, k)
                    n, sums = n - less_n, sums - less
                more_n, more = group_sums(v, now, k)
                n, sums = n + more_n, sums + more
        if n.any() or sums.any():
            yield sums_batch(n, sums)

    return collected_sums(read.select("v").mapInArrow(run, SUMS), k, width)


def assigned(file: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and its exact distance; where the cells settle the cluster, only that distance is computed."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, cluster = matrix(batch.column("v"), width), batch.column("settled").to_numpy().astype(np.int64)
            left = cluster < 0
            distance = ((v - centroids[cluster]) ** 2).sum(axis=1)
            cluster[left], distance[left] = nearest(v[left], centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    looked = file.withColumn("settled", _settled_on(Lookup.of(cells, centroids))).select("vec_id", "v", "settled")
    return looked.mapInArrow(run, "vec_id long, cluster int, distance long")


def starts(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ``seed:id`` hashes lowest."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.filter("vec_id IS NOT NULL").orderBy(order, "v").limit(clusters).select("v").collect()
    return np.array([r["v"] for r in first], np.int64)


def cluster(
    table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS,
    scale: int = SCALE, seed: int = SEED, bits: int = CELL_BITS,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector, and the final centroids."""
    ship_package(table.sparkSession)
    rows = integer_vectors(table, scale, size=components)
    centroids = starts(rows, clusters, seed)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter("vec_id IS NOT NULL"), centroids
    cells = fit_cells(rows, bits)
    file = saved(approximated(rows, cells), "approximation-file")
    before, n, sums = None, 0, 0
    for _ in range(rounds):
        more_n, more = changes(file, cells, before, centroids)
        n, sums = n + more_n, sums + more
        before, centroids = centroids, moved(centroids, n, sums)
        if np.array_equal(before, centroids):
            break  # All rounds to come would repeat this one.
    return assigned(file, cells, centroids), centroids


def op12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found, centroids = cluster(spark.read.parquet(f"{folder}/embeddings.parquet"))
    found = saved(found, "clusters")
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()
    total = {r["cluster"]: r["inertia"] for r in by_cluster}  # one row a cluster
    described = [
        (k, total.get(k, 0), sum(total.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for k, c in enumerate(centroids.tolist())
    ]
    sizes = spark.createDataFrame(described, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(sizes), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _oracle() -> str:
    ctes = [
        """kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)""",
        """v AS MATERIALIZED (
    SELECT r, unnest(range(64)) AS d, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept)""",
        """c0 AS MATERIALIZED (
    SELECT s.k, v.d, v.x FROM (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM kept) s
    JOIN v USING (r) WHERE s.k < 8)""",
    ]
    for i in range(ROUNDS + 1):
        ctes.append(
            f"""a{i} AS MATERIALIZED (
    SELECT r, min(m) % 8 AS k, min(m) // 8 AS distance FROM (
        SELECT v.r, CAST(sum((v.x - c.x) * (v.x - c.x)) * 8 + c.k AS BIGINT) AS m FROM v JOIN c{i} c USING (d) GROUP BY v.r, c.k)
    GROUP BY r)"""
        )
        if i < ROUNDS:
            ctes.append(
                f"""c{i + 1} AS MATERIALIZED (
    SELECT c.k, c.d, coalesce((s.x - ((s.x % s.n) + s.n) % s.n) // s.n, c.x) AS x FROM c{i} c LEFT JOIN (
        SELECT a.k, v.d, CAST(sum(v.x) AS BIGINT) AS x, count(*) AS n FROM v JOIN a{i} a USING (r) GROUP BY a.k, v.d) s
    ON s.k = c.k AND s.d = c.d)"""
            )
    return f"""WITH {", ".join(ctes)}
SELECT kept.vec_id, CAST(a.k AS INTEGER) AS cluster, a.distance,
    CAST(sum(a.distance) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
    CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, h.sha AS centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (r)
JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS sha FROM c{ROUNDS} GROUP BY k) h ON h.k = a.k"""


QUERIES = {"op12_clusters": op12_clusters}
ORACLE_SQL = {"op12_clusters": _oracle()}
