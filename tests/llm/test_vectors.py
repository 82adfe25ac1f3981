"""Centroid clustering and vector codes against plain loops."""

import hashlib

import numpy as np
import pytest

from topicpulse.llm import clustering, codebooks
from topicpulse.llm.vectors import integer_vectors

ODD = [(900, None), (901, []), (902, [float("nan")] * 16), (903, [None] * 16), (904, [float("inf")] * 16), (905, [1.0]), (906, [1e9] * 16)]


def table(spark, seed, n, width=16, extra=()):
    random = np.random.default_rng(seed)
    vectors = np.round(random.normal(size=(n, width)) / 4, 4)
    vectors[n // 2 : n // 2 + n // 3] = vectors[0]  # a third are copies
    vectors[1, 3] = 40.0  # far out of its component's range
    rows = [(i, v.tolist(), None if i % 7 == 0 else i % 3) for i, v in enumerate(vectors)]
    rows += [(i, v, 1) for i, v in [*ODD, *extra]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("code", "v", "cluster", "settled", "size", "grp"):
        frame = frame.selectExpr("*", f"7 AS {name}")
    return frame, vectors


def lloyd(x, start, rounds):
    c = start.copy()
    for _ in range(rounds):
        a = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(len(c)):
            if (a == k).any():
                c[k] = x[a == k].sum(axis=0) // (a == k).sum()
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1), c


@pytest.mark.parametrize("bits", [1, 4, 6, 8])
def test_clusters_against_plain_rounds(spark, bits):
    frame, vectors = table(spark, 1, 300)
    found, centroids = clustering.cluster(frame, components=16, bits=bits)
    x = np.floor(1024 * vectors).astype(np.int64)
    first = sorted(range(300), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:8]
    a, d, c = lloyd(x, x[first], 10)
    got = {r.vec_id: (r.cluster, r.distance) for r in found.collect()}
    assert np.array_equal(centroids, c) and got == {i: (a[i], d[i]) for i in range(300)}


def test_cells_hold_their_values_and_settle_truly(spark):
    frame, _ = table(spark, 2, 200)
    rows = integer_vectors(frame, 1024, size=16)
    cells = clustering.fit_cells(rows, 5)
    x = np.array([r.v for r in rows.collect()], np.int64)
    cell = cells.decode(cells.encode(x))
    for j in range(16):
        assert (cells.low[j][cell[j]] <= x[:, j]).all() and (x[:, j] <= cells.high[j][cell[j]]).all()
    centroids = x[[3, 3, 17, 60]]  # two are equal: the smaller number wins
    settled = clustering.Lookup.of(cells, centroids).settled(cell)
    true, _ = clustering.nearest(x, centroids)
    assert (settled[settled >= 0] == true[settled >= 0]).all() and (settled >= 0).any()


def test_clusters_of_odd_tables(spark):
    frame, _ = table(spark, 3, 4, extra=[(None, [0.5] * 16), (2, [0.25] * 16), (2, [0.25] * 16)])
    found, centroids = clustering.cluster(frame, components=16)
    assert sorted(str(r.vec_id) for r in found.collect()) == sorted(["0", "1", "2", "2", "2", "3", "None"]) and len(centroids) == 6
    none, centroids = clustering.cluster(frame.limit(0), components=16)
    assert none.count() == 0 and len(centroids) == 0


def test_codes_against_plain_rounds(spark):
    frame, vectors = table(spark, 4, 400)
    rows = codebooks.usable(frame)
    books = codebooks.train(rows)
    x = np.floor(4096 * vectors).astype(np.int64)
    want = [lloyd(x[:, 2 * p : 2 * p + 2], x[:16, 2 * p : 2 * p + 2], 6) for p in range(8)]
    assert np.array_equal(books, np.stack([c for _, _, c in want]))
    got = {r.vec_id: (r.code, r.error) for r in codebooks.encode(rows, books).collect()}
    assert got == {i: ("".join(f"{w[0][i]:02x}" for w in want), sum(w[1][i] for w in want)) for i in range(400)}
    back = {r.vec_id: r.approximation for r in codebooks.decode(codebooks.encode(rows, books), books).collect()}
    assert back[7] == np.concatenate([w[2][w[0][7]] / 4096 for w in want]).tolist()


@pytest.mark.parametrize(("width", "limit"), [(1, 1 << 16), (64, 3), (10_000, 50)])
def test_memo_keeps_the_nearest_entries(width, limit):
    random = np.random.default_rng(5)
    entries = random.integers(-300, 300, (16, 4))
    entries[9] = entries[4]
    memo = codebooks.Memo(entries, width, limit)
    for _ in range(4):
        parts = random.integers(-400, 400, (200, 4))
        parts[:50] = parts[50:100]
        parts[100:104] = entries[[4, 9, 0, 15]]
        entry, distance = memo.nearest(parts)
        every = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert np.array_equal(entry, every.argmin(axis=1)) and np.array_equal(distance, every.min(axis=1))
    assert len(memo.key) <= max(limit, 200)


def test_codes_of_odd_tables(spark):
    frame, _ = table(spark, 6, 6, extra=[(None, [0.5] * 16), (2, [0.25] * 16)])
    rows = codebooks.usable(frame)
    books = codebooks.train(rows)
    assert books.shape == (8, 7, 2)
    assert sorted(str(r.vec_id) for r in codebooks.encode(rows, books).collect()) == sorted(["0", "1", "2", "2", "3", "4", "5", "None"])
    assert codebooks.train(codebooks.usable(frame.limit(0))).shape[1] == 0
    odd_length = spark.createDataFrame([(1, [1.0] * 9, 1)], "vec_id long, embedding array<double>, label int")
    assert codebooks.usable(odd_length).count() == 0


def test_codes_query_on_an_empty_table(spark, tmp_path):
    frame, _ = table(spark, 7, 5)
    frame.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert codebooks.op13_codes(spark, str(tmp_path)).count() == 0 and clustering.op12_clusters(spark, str(tmp_path)).count() == 0
