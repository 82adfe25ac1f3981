"""Toxicity by classifier chains.

The categories are predicted one after another by linear models over hashed words. Each
model also reads the probabilities of the categories before it. For training, those come
from models that did not see the row (out-of-fold), so that a later model learns how far an
earlier one can be trusted; at scoring, the earlier models of the chain give them.

Models are fitted on the driver from a bounded sample of labelled rows (``SAMPLE_ROWS`` of
each class, the first by hash of their id). Scoring is one pass over the whole table.

Defined cases: a null or empty text, or one of punctuation alone, has nothing to judge: all its
probabilities are 0 and it is not rejected, whatever the models' intercepts; repeated rows get repeated scores; a label other than 0 or 1,
or an id labelled both ways, counts as its largest valid label; without labels of both
kinds nothing is rejected; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicpulse.llm.pii import _LOWER_BYTE, _PUNCTUATION
from topicpulse.llm.quality import labelled_sample
from topicpulse.llm.words import Words, blocks, hash_spans
from topicpulse.session import ship_package

SAMPLE_ROWS = 6000
BUCKETS = 1 << 18
FEATURES = 4096  # words a model may use, by how far they set its classes apart
FOLDS = 5
STEM_BYTES = 5  # a longer word also counts by its first bytes, which its inflections share
REJECT_FROM = 0.5

# Seed words of the categories: a labelled toxic row belongs to each category it has a word of.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "insult": ("idiot", "idiots", "moron", "morons", "clown", "clowns", "loser", "losers", "fool", "imbecile", "dumb", "stupid"),
    "contempt": ("pathetic", "worthless", "useless", "disgrace", "failure", "coward", "ridiculous"),
    "dehumanising": ("scum", "trash", "garbage", "vermin", "filth", "disgusting", "parasite", "animal"),
}


def word_buckets(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the different words and stems of each text, lower case, without punctuation around."""
    w = Words(column)
    start, end = w.start.copy(), w.end.copy()
    for edge, step in ((start, 1), (end, -1)):
        live = np.arange(len(edge))
        while len(live):
            at = edge[live] if step > 0 else edge[live] - 1
            live = live[(start[live] < end[live]) & _PUNCTUATION[w.raw[np.minimum(at, len(w.raw) - 1)]]]
            edge[live] += step
    full = end > start
    start, end, text, raw = start[full], end[full], w.text[full], _LOWER_BYTE[w.raw]
    key = hash_spans(raw, start, end)
    long = end - start > STEM_BYTES
    stem = ~hash_spans(raw, start[long], start[long] + STEM_BYTES)
    bucket = (np.concatenate([key, stem]) % np.uint64(buckets)).astype(np.int64)
    pairs = np.unique(np.concatenate([text, text[long]]) * buckets + bucket)
    return pairs // buckets, pairs % buckets


@dataclass(frozen=True)
class Linear:
    """Logistic model: weight by word bucket, weights of the earlier categories, intercept."""

    weight: np.ndarray
    chain: np.ndarray
    bias: float

    def score(self, row: np.ndarray, bucket: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        total = np.bincount(row, self.weight[bucket], len(earlier)) + earlier @ self.chain + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_linear(
    row: np.ndarray, bucket: np.ndarray, earlier: np.ndarray, label: np.ndarray,
    features: int = FEATURES, ridge: float = 1.0, steps: int = 12,
) -> Linear:
    """Ridge logistic regression by damped Newton steps, over the most telling words."""
    n, positive = len(label), label.sum()
    if positive in (0, n):
        return Linear(np.zeros(BUCKETS), np.zeros(earlier.shape[1]), -30.0 if positive == 0 else 30.0)
    seen = np.bincount(bucket, minlength=BUCKETS)
    hits = np.bincount(bucket, label[row], BUCKETS)
    expected = seen * positive / n
    chi = np.where(seen >= 3, (hits - expected) ** 2 / np.maximum(expected * (1 - positive / n), 1e-9), 0)
    chosen = np.argsort(-chi, kind="stable")[:features]
    chosen = chosen[chi[chosen] > 3]
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    use = place[bucket] >= 0
    r, f = row[use], place[bucket[use]]
    k = len(chosen)
    c = earlier.shape[1]
    # Both classes weigh the same.
    cost = np.where(label > 0, n / (2 * positive), n / (2 * (n - positive)))
    penalty = np.concatenate([np.full(k + c, ridge), [1e-6]])

    def margin(x: np.ndarray) -> np.ndarray:
        return np.bincount(r, x[:k][f], n) + earlier @ x[k : k + c] + x[-1]

    def back(v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(f, v[r], k), earlier.T @ v, [v.sum()]])

    def loss(x: np.ndarray, m: np.ndarray) -> float:
        return float(cost @ (np.logaddexp(0, m) - label * m) + penalty @ x**2 / 2)

    x = np.zeros(k + c + 1)
    m = margin(x)
    now = loss(x, m)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-m))
        gradient, h = back(cost * (p - label)) + penalty * x, cost * p * (1 - p)
        # Newton's step by conjugate gradients.
        step, rest = np.zeros_like(x), -gradient
        way, size = rest.copy(), rest @ rest
        for _ in range(12):
            if size < 1e-8 * n:
                break
            bent = back(h * margin(way)) + penalty * way
            ahead = size / max(way @ bent, 1e-300)
            step, rest = step + ahead * way, rest - ahead * bent
            before, size = size, rest @ rest
            way = rest + size / before * way
        length = 1.0
        while length > 1e-4:
            trial = x + length * step
            at = margin(trial)
            after = loss(trial, at)
            if after < now:
                break
            length /= 2
        else:
            break
        done = now - after < 1e-5 * now
        x, m, now = trial, at, after
        if done:
            break
    weight, chain, bias = x[:k], x[k : k + c], float(x[-1])
    whole = np.zeros(BUCKETS)
    whole[chosen] = weight
    return Linear(whole, chain, bias)


def fit_chain(row: np.ndarray, bucket: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """The models of the chain, one for each column of ``labels``.

    ``row`` numbers the training rows; a row's fold follows from its number.
    """
    n = len(labels)
    earlier, models = np.zeros((n, 0)), []
    fold = np.arange(n) % folds
    for label in labels.T.astype(float):
        models.append(fit_linear(row, bucket, earlier, label))
        unseen = np.zeros(n)
        for k in range(folds):
            train, held = fold != k, fold == k
            new = np.cumsum(train) - 1
            use = train[row]
            model = fit_linear(new[row[use]], bucket[use], earlier[train], label[train])
            new = np.cumsum(held) - 1
            use = held[row]
            unseen[held] = model.score(new[row[use]], bucket[use], earlier[held])
        earlier = np.column_stack([earlier, unseen])
    return models


def score_chain(models: Sequence[Linear], column: pa.Array) -> np.ndarray:
    """Probabilities by text and category, each category reading those before it."""
    row, bucket = word_buckets(column)
    out = np.zeros((len(column), 0))
    for model in models:
        out = np.column_stack([out, model.score(row, bucket, out)])
    out[np.bincount(row, minlength=len(column)) == 0] = 0.0
    return out


def _whole(word: str) -> np.ndarray:
    raw = np.frombuffer(word.encode(), np.uint8)
    return (hash_spans(raw, np.array([0]), np.array([len(raw)])) % np.uint64(BUCKETS)).astype(np.int64)


def fit(
    docs: DataFrame, labels: DataFrame, categories: Mapping[str, Sequence[str]] = CATEGORIES, rows: int = SAMPLE_ROWS
) -> list[Linear] | None:
    """Fit the chain (the categories in order, last of all ``toxic``); None without both classes."""
    ship_package(docs.sparkSession)

    def features(batches):
        for batch in blocks(batches, "text"):
            row, bucket = word_buckets(batch.column("text"))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), lists],
                names=["doc_id", "label", "buckets"],
            )

    schema = "doc_id long, label int, buckets array<int>"
    # The bound on its rows bounds what reaches the driver: the bucket numbers of that many texts.
    got = labelled_sample(docs, labels, "toxic", rows).mapInArrow(features, schema).toArrow()
    got = got.take(np.argsort(got.column("doc_id").to_numpy(), kind="stable"))
    toxic = got.column("label").to_numpy()
    if len(np.unique(toxic)) < 2:
        return None
    lists = got.column("buckets").combine_chunks()
    bucket = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(toxic)), np.asarray(lists.value_lengths()))
    columns = []
    for seeds in categories.values():
        seed = [_whole(w) for w in seeds]
        has = np.bincount(row[np.isin(bucket, np.concatenate(seed))], minlength=len(toxic)) > 0
        columns.append(has & (toxic > 0))
    return fit_chain(row, bucket, np.column_stack([*columns, toxic > 0]))


def score(
    docs: DataFrame, models: Sequence[Linear] | None, categories: Sequence[str] = tuple(CATEGORIES),
    reject_from: float = REJECT_FROM,
) -> DataFrame:
    """doc_id, the probability of each category, that of ``toxic``, and whether it is rejected."""
    ship_package(docs.sparkSession)
    names = [f"p_{c}" for c in [*categories, "toxic"]]

    def run(batches):
        for batch in blocks(batches, "text"):
            p = score_chain(models, batch.column("text")) if models else np.zeros((batch.num_rows, len(names)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c) for c in p.T), pa.array(p[:, -1] >= reject_from)],
                names=["doc_id", *names, "rejected"],
            )

    schema = "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", rejected boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def without_toxic(docs: DataFrame, models: Sequence[Linear] | None, reject_from: float = REJECT_FROM) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, as they are."""
    ship_package(docs.sparkSession)
    if not models:
        return docs

    def run(batches):
        for batch in blocks(batches, "text"):
            keep = score_chain(models, batch.column("text"))[:, -1] < reject_from
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
