"""Vector codes by product quantisation with memoised grid cells.

A vector is cut into equal parts, and each part is replaced by the number of its codebook's
nearest entry. Space around a codebook is cut into coarse grid cells. For a cell that is met,
the entry nearest to its middle sets the bar: an entry whose distance exceeds that one's
everywhere in the cell's box (the least difference of the two, which each component takes at
its least or greatest value, is above zero) is dominated and can never be chosen there. The
entries that are left are kept in a memo under the cell's hash, and each vector is compared
exactly with its cell's entries only. A task's memo holds ``MEMO_CELLS`` cells of a part at
most and starts anew beyond; cells whose hashes collide are compared with all entries.

A round is one pass without a shuffle of vectors: tasks add up their parts by entry, and the
driver gets parts times entries times components sums. Integer arithmetic throughout.

Defined cases: null vectors, vectors with null or non-finite components, with a floor beyond
2^27, without components, or of another length than the most frequent of the valid ones
(ties: the shorter) take no part, and if that length is no multiple of the number of parts
nothing does; rows that repeat an id are vectors of their own, and of equal ids the smaller
vector starts first; rows without id are coded but start no entry; fewer vectors than entries
give as many entries; equal distances go to the lower entry; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicpulse.llm.vectors import SUMS, collected_sums, group_sums, integer_vectors, matrix, moved, sums_batch
from topicpulse.llm.words import mix
from topicpulse.session import saved, ship_package

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
CELL_WIDTH = 512
MEMO_CELLS = 1 << 16


def undominated(low: np.ndarray, width: int, entries: np.ndarray) -> np.ndarray:
    """By box (least corner ``low``, ``width`` whole numbers wide) and entry: whether it may be the nearest."""
    high = low + width - 1
    middle = (low + high) // 2
    rows = np.arange(len(low))
    bar = np.stack([((middle - e) ** 2).sum(axis=1) for e in entries], axis=1).argmin(axis=1)
    b = entries[bar]
    out = np.empty((len(low), len(entries)), bool)
    for k, e in enumerate(entries):
        slope = 2 * (b - e)
        least = (e**2).sum() - (b**2).sum(axis=1) + np.where(slope > 0, slope * low, slope * high).sum(axis=1)
        out[:, k] = (least < 0) | ((least == 0) & (k < bar))
    out[rows, bar] = True
    return out


class Memo:
    """Undominated entries of the cells met so far, for one codebook."""

    def __init__(self, entries: np.ndarray, width: int = CELL_WIDTH, limit: int = MEMO_CELLS):
        self.entries, self.width, self.limit = entries, width, limit
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.cell = np.zeros((0, self.entries.shape[1]), np.int64)
        self.mask = np.zeros((0, len(self.entries)), bool)

    def candidates(self, parts: np.ndarray) -> np.ndarray:
        """By part: the entries to compare it with."""
        cell = parts // self.width
        key = np.zeros(len(cell), np.uint64)
        for c in cell.T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
        met, first = np.unique(key, return_index=True)
        new = met[~np.isin(met, self.key)]
        if len(new):
            if len(self.key) + len(new) > self.limit:
                self._clear()
                new = met
            found = cell[first[np.searchsorted(met, new)]]
            mask = undominated(found * self.width, self.width, self.entries)
            order = np.argsort(np.concatenate([self.key, new]), kind="stable")
            self.key = np.concatenate([self.key, new])[order]
            self.cell = np.concatenate([self.cell, found])[order]
            self.mask = np.concatenate([self.mask, mask])[order]
        at = np.searchsorted(self.key, key)
        out = self.mask[at]
        out[(self.cell[at] != cell).any(axis=1)] = True
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each part."""
        row, entry = np.nonzero(self.candidates(parts))
        distance = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(distance, first)
        # Entries ascend within a row, so the first at the least distance is the lowest.
        hit = np.flatnonzero(distance == least[row])
        chosen = entry[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]]
        return chosen, least


def code_batch(memos: list[Memo], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry by vector and part, and each vector's distance over all parts."""
    width = vectors.shape[1] // len(memos)
    found = [m.nearest(vectors[:, p * width : (p + 1) * width]) for p, m in enumerate(memos)]
    return np.stack([c for c, _ in found], axis=1), sum(d for _, d in found)


def part_sums(rows: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sums of the parts by (part, entry) of their nearest entries."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(b) for b in books]
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"), parts * width)
                code, _ = code_batch(memos, v)
                more_n, more = group_sums(v.reshape(-1, width), (code + np.arange(parts) * entries).ravel(), parts * entries)
                n, sums = n + more_n, sums + more
        if n.any():
            yield sums_batch(n, sums)

    n, sums = collected_sums(rows.select("v").mapInArrow(run, SUMS), parts * entries, width)
    return n.reshape(parts, entries), sums.reshape(parts, entries, width)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks by part, entry and component of the part."""
    first = rows.filter("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(entries).select("v").collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        n, sums = part_sums(rows, books)
        after = np.stack([moved(b, c, s) for b, c, s in zip(books, n, sums, strict=True)])
        if np.array_equal(books, after):
            break  # All rounds to come would repeat this one.
        books = after
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, the code (two hex digits a part) and the error of every row."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(b) for b in books]
        for batch in batches:
            if batch.num_rows:
                code, error = code_batch(memos, matrix(batch.column("v"), parts * width))
                digits = code.astype(np.uint8).tobytes().hex()
                text = pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), text, pa.array(error)], names=["vec_id", "label", "code", "error"]
                )

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``codes`` with the vector its code stands for, back in the scale of the table."""
    width = books.shape[2]
    entries = [[[float(x) / scale for x in e] for e in b] for b in books]
    place = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    book = lambda b: F.array(*(F.array(*(F.lit(x) for x in e)) for e in b))
    whole = F.concat(*(F.get(book(b), place(p)) for p, b in enumerate(entries))) if width else F.array()
    return codes.withColumn("approximation", whole)


def usable(table: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label and integer vector v of the rows that take part."""
    rows = integer_vectors(table, scale, [F.col("label")]).withColumn("size", F.size("v")).filter("size > 0")
    size = rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).select("size")  # one row
    return rows.join(F.broadcast(size), "size").filter(F.col("size") % parts == 0).select("vec_id", "label", "v")


def op13_codes(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    rows = saved(usable(spark.read.parquet(f"{folder}/embeddings.parquet")), "integer-vectors")
    books = train(rows)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    if not books.shape[1]:
        coded = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = saved(encode(rows, books), "codes")
    # Written, so that the join has no aggregate beside it and a crowded label can be split.
    totals = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    totals = totals.withColumnRenamed("label", "of")
    both = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _oracle() -> str:
    ctes = [
        """kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding))""",
        """v AS MATERIALIZED (
    SELECT r, d // w AS p, d % w AS j, x FROM (
        SELECT r, len(embedding) // 8 AS w, unnest(range(len(embedding))) AS d,
            CAST(floor(4096 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept))""",
        """b0 AS MATERIALIZED (
    SELECT v.p, s.e, v.j, v.x FROM (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) s
    JOIN v USING (r) WHERE s.e < 16)""",
    ]
    for i in range(ROUNDS + 1):
        ctes.append(
            f"""a{i} AS MATERIALIZED (
    SELECT r, p, min(m) % 16 AS e, min(m) // 16 AS distance FROM (
        SELECT v.r, v.p, CAST(sum((v.x - b.x) * (v.x - b.x)) * 16 + b.e AS BIGINT) AS m
        FROM v JOIN b{i} b ON b.p = v.p AND b.j = v.j GROUP BY v.r, v.p, b.e)
    GROUP BY r, p)"""
        )
        if i < ROUNDS:
            ctes.append(
                f"""b{i + 1} AS MATERIALIZED (
    SELECT b.p, b.e, b.j, coalesce((s.x - ((s.x % s.n) + s.n) % s.n) // s.n, b.x) AS x FROM b{i} b LEFT JOIN (
        SELECT a.p, a.e, v.j, CAST(sum(v.x) AS BIGINT) AS x, count(*) AS n
        FROM v JOIN a{i} a ON a.r = v.r AND a.p = v.p GROUP BY a.p, a.e, v.j) s
    ON s.p = b.p AND s.e = b.e AND s.j = b.j)"""
            )
    return f"""WITH {", ".join(ctes)},
coded AS (
    SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(distance) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT kept.vec_id, coded.code, coded.error,
    CAST(sum(coded.error) OVER (PARTITION BY kept.label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (r)"""


QUERIES = {"op13_codes": op13_codes}
ORACLE_SQL = {"op13_codes": _oracle()}
