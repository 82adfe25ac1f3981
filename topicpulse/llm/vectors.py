"""Integer vectors shared by the clustering and compression operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A component beyond this has squared distances that no long can hold.
LARGEST = 1 << 27


def integer_vectors(table: DataFrame, scale: int, others: Sequence[Column] = (), size: int | None = None) -> DataFrame:
    """vec_id, ``others`` and v, the floors of ``scale`` times each component.

    Left out: null vectors, vectors with null or non-finite components, of another length
    than ``size`` if given, and those with a scaled component beyond ``LARGEST``.
    """
    x = F.col("embedding").cast("array<double>").alias("x")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), *others, x).filter("x IS NOT NULL")
    if size is not None:
        rows = rows.filter(F.size("x") == size)
    # No comparison holds for NaN, and infinite components are too large as well.
    rows = rows.filter(F.forall("x", lambda c: c.isNotNull() & (F.abs(c) * float(scale) <= LARGEST)))
    # Spark may compute this before the filter, so it must not raise.
    return rows.withColumn("v", F.transform("x", lambda c: F.floor(c * float(scale)).try_cast("int"))).drop("x")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of one length as integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), width)


def group_sums(vectors: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and exact component sums by group number."""
    order = np.argsort(group, kind="stable")
    first = np.searchsorted(group[order], np.arange(groups + 1))
    sums = np.zeros((groups, vectors.shape[1]), np.int64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        sums[full] = np.add.reduceat(vectors[order], first[full], axis=0)
    return np.diff(first), sums


def sums_batch(n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """A task's partial sums as rows (grp, n, sums)."""
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)), pa.array(sums.ravel()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n.astype(np.int64)), lists], names=["grp", "n", "sums"]
    )


SUMS = "grp int, n long, sums array<long>"


def collected_sums(parts: DataFrame, groups: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Partial sums added up by Spark; groups times width numbers reach the driver."""
    rows = parts.select("grp", "n", F.posexplode("sums").alias("pos", "x")).groupBy("grp", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    n, sums = np.zeros(groups, np.int64), np.zeros((groups, width), np.int64)
    for r in rows.collect():
        n[r["grp"]] = r["n"]
        sums[r["grp"], r["pos"]] = r["x"]
    return n, sums


def moved(entries: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of its members' mean; without members it stays."""
    return np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], entries)
