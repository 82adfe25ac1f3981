"""Quality rules: gradient-boosted trees over statistics of a text.

Trees are grown on binned statistics of a bounded sample of labelled rows, with monotonic
constraints on chosen statistics, and flattened into numpy node arrays. Scoring is one pass
over the whole table: a block of texts becomes a matrix of statistics, and all its rows walk
all trees together.

Defined cases: a null or empty text has no words, fails the base rules and is not kept;
repeated rows give repeated results; ``doc_id`` may be null; an empty table gives no rows;
other columns are ignored. Without labels of both kinds every text that passes the base
rules is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicpulse.llm.words import _CONTINUED, Words, blocks, by_text, hash_spans, text_buffers
from topicpulse.session import ship_package

SAMPLE_ROWS = 10_000  # labelled rows of each class that the trees see at most
KEEP_FROM = 0.5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Statistic and the direction in which quality may move with it (0: either).
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "upper_share": -1,
    "digit_share": -1,
    "mark_share": -1,
    "non_ascii_share": 0,
    "mean_line_words": 0,
    "long_word_share": 0,
    "top_word_share": -1,
    "stop_share": 0,
}
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?@^~=_+{}[]\\/;:\"", np.uint8))


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts and the matrix of ``FEATURES``, a row for each text."""
    w = Words(column)
    n = len(w.counts)
    chars = w.code_points()
    base = {"n_words": w.counts.astype(np.int64), "word_chars": by_text(chars, w.text, n)}

    bytes_text = np.repeat(np.arange(n), np.diff(w.offsets))

    def share_of(table: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(table[w.raw])
        return np.bincount(bytes_text[at], minlength=n).astype(np.int64)

    base["n_symbols"] = share_of(_SYMBOL)
    base["n_dup_lines"], n_lines = _dup_lines(w)
    base["n_repeat_words"] = _repeat_words(w)

    words = np.maximum(base["n_words"], 1)
    order = np.lexsort((w.hash, w.text))
    new = np.ones(len(order), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.text[order][1:] != w.text[order][:-1])
    run_start = np.flatnonzero(new)
    run_len = np.diff(np.append(run_start, len(order)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, w.text[order][run_start], run_len)
    all_chars = np.maximum(base["word_chars"], 1)
    matrix = np.column_stack(
        [
            np.log1p(base["n_words"]),
            base["word_chars"] / words,
            base["n_symbols"] / all_chars,
            base["n_dup_lines"] / np.maximum(n_lines, 1),
            base["n_repeat_words"] / words,
            np.bincount(w.text[order][run_start], minlength=n) / words,
            share_of(_UPPER) / all_chars,
            share_of(_DIGIT) / all_chars,
            share_of(_MARK) / all_chars,
            share_of(_CONTINUED) / all_chars,
            words / np.maximum(n_lines, 1),
            by_text(chars > 12, w.text, n) / words,
            top / words,
            by_text(chars <= 3, w.text, n) / words,
        ]
    )
    return base, matrix


def _dup_lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """By text: lines with a word that equal an earlier line, and lines with a word."""
    n = len(w.counts)
    cut = np.flatnonzero(w.raw == 10)
    text_of = np.searchsorted(w.offsets, cut, "right") - 1
    start = np.concatenate([w.offsets[:-1], cut + 1])
    end = np.concatenate([w.offsets[1:], cut])
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.sort(end, kind="stable")
    text = np.sort(np.concatenate([np.arange(n), text_of]), kind="stable")
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, text = start[full], end[full], text[full]
    key = hash_spans(w.raw, start, end)
    order = np.lexsort((key, text))
    same = np.zeros(len(order), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    return by_text(same, text[order], n), by_text(np.ones(len(text)), text, n)


def _repeat_words(w: Words, width: int = 5) -> np.ndarray:
    """By text: words inside a window of ``width`` words that the text holds at least twice."""
    n = len(w.counts)
    at = np.flatnonzero(w.left() >= width)
    if not len(at):
        return np.zeros(n, np.int64)
    key, text = w.grams(width)[at], w.text[at]
    order = np.lexsort((key, text))
    same = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(len(w) + 1, np.int64)
    np.add.at(change, at[order[twice]], 1)
    np.add.at(change, at[order[twice]] + width, -1)
    return by_text(np.cumsum(change[:-1]) > 0, w.text, n)


@dataclass(frozen=True)
class Trees:
    """Flat node arrays of all trees; a leaf points at itself and carries a value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, matrix: np.ndarray) -> np.ndarray:
        """Probability by row, all rows walking a tree together."""
        total = np.full(len(matrix), self.bias)
        rows = np.arange(len(matrix))
        for root in self.roots:
            node = np.full(len(matrix), root)
            for _ in range(self.depth):
                down = matrix[rows, self.feature[node]] <= self.cut[node]
                node = np.where(down, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(
    matrix: np.ndarray,
    label: np.ndarray,
    direction: Sequence[int],
    trees: int = 80,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    ridge: float = 1.0,
) -> Trees:
    """Boost ``trees`` trees on the logistic loss.

    A constrained split must order its two child values, and the middle of the two bounds
    all values below on either side, so the whole model is monotonic.
    """
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in matrix.T]
    binned = np.column_stack([np.searchsorted(q, c) for q, c in zip(cuts, matrix.T, strict=True)])
    rate_of = np.clip(label.mean(), 1e-4, 1 - 1e-4)
    bias = float(np.log(rate_of / (1 - rate_of)))
    nodes: list[list[float]] = []
    roots, margin = [], np.full(len(label), bias)

    def leaf(value: float) -> int:
        nodes.append([0, 0.0, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        here = float(np.clip(-sum_g / (sum_h + ridge), low, high))
        best = (1e-6, -1, -1, 0.0, 0.0)
        if level < depth and len(rows) >= 20:
            for f, q in enumerate(cuts):
                if not len(q):
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], len(q) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(q) + 1))[:-1]
                gr, hr = sum_g - gl, sum_h - hl
                vl = np.clip(-gl / (hl + ridge), low, high)
                vr = np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - (gr * vr + (hr + ridge) * vr**2 / 2)
                gain += sum_g * here + (sum_h + ridge) * here**2 / 2
                bad = (hl < 1) | (hr < 1)
                if direction[f]:
                    bad |= (vr - vl) * direction[f] < 0
                gain = np.where(bad, -np.inf, gain)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), f, at, float(vl[at]), float(vr[at]))
        _, f, at, vl, vr = best
        if f < 0:
            me = leaf(here * rate)
            margin[rows] += here * rate
            return me
        me = leaf(0.0)
        down = binned[rows, f] <= at
        middle = (vl + vr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
        (ll, lh), (rl, rh) = bounds[direction[f]]
        left = split(rows[down], g, h, ll, lh, level + 1)
        right = split(rows[~down], g, h, rl, rh, level + 1)
        nodes[me] = [f, cuts[f][at], left, right, 0.0]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(split(np.arange(len(label)), p - label, p * (1 - p), -np.inf, np.inf, 0))
    table = np.array(nodes)
    return Trees(
        table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64),
        table[:, 4], np.array(roots), depth, bias,
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents of each class, the first by hash of their id."""
    ids = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label"))
    some = [ids.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for v in (0, 1)]
    # 2 * rows ids at most: the bound that lets them be sent to every executor.
    return docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees | None:
    """Grow the trees on a bounded sample of labelled rows; None without both classes."""
    ship_package(docs.sparkSession)
    names = list(FEATURES)

    def measured(batches):
        for batch in blocks(batches, "text"):
            _, matrix = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.int32()), *(pa.array(c) for c in matrix.T)], names=["label", *names]
            )

    schema = "label int, " + ", ".join(f"{n} double" for n in names)
    got = labelled_sample(docs, labels, "quality", rows).mapInArrow(measured, schema).toPandas()
    got = got.sort_values(list(got.columns))
    if got["label"].nunique() < 2:
        return None
    return grow(got[names].to_numpy(), got["label"].to_numpy(float), list(FEATURES.values()))


def quality_rules(docs: DataFrame, trees: Trees | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """By document: the base counts, whether they fail it, its score and the verdict."""
    ship_package(docs.sparkSession)

    def scored(batches):
        for batch in blocks(batches, "text"):
            base, matrix = statistics(batch.column("text"))
            failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
            score = trees.score(matrix) if trees else np.ones(len(failed))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    *(pa.array(base[n]) for n in BASE),
                    pa.array(failed),
                    pa.array(~failed & (score >= keep_from)),
                    pa.array(score),
                ],
                names=["doc_id", *BASE, "base_failed", "kept", "score"],
            )

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, kept boolean, score double"
    return docs.select("doc_id", "text").mapInArrow(scored, schema)


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return quality_rules(docs, fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE_SQL: dict[str, str] = {}
