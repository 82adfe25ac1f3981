"""Substring dedup: matching statistics of documents against compressed FM-indexes.

A window of 50 words is a copy if its words also start in a document with a smaller id.
Every window is known by its anchor, the least hash of its 16-word runs; equal windows have
equal anchors, so shards are keyed by anchors and a passage (the windows that share an
anchor, side by side) only needs its own shard. Anchors of a single document have no copy
and go no further. Equal passages collapse to one with its smallest document, its owner.
Anchors with very many different passages (a common line in changing company) are split:
each window of theirs is keyed by its own words instead.

Each shard builds an FM-index of its passages (wavelet matrix, backward search) and streams
every passage past it, once as its owner and once as the other documents that hold it, for
the windows that start at a smaller owner. Those windows' words go.

Defined cases: a null or empty text has no words; documents without id are neither changed
nor a source; rows that repeat an id are judged by their own text, and are no source for
each other; an empty table gives no rows. ``without_copies`` leaves a text untouched unless
words go, and then joins those left by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicpulse.llm.fm_index import FMIndex
from topicpulse.llm.words import Words, blocks, grams, mix
from topicpulse.session import saved, ship_package

WINDOW = 50
ANCHOR = 16
CROWDED = 1024  # different passages of an anchor from which their windows are keyed one by one
SHARD_WORDS = 1 << 19


def window_anchors(w: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By window, in order: its first word, the place of its anchor (the leftmost least run), the anchor."""
    starts = np.flatnonzero(w.left() >= window)
    runs = grams(w.hash, anchor)
    reach = window - anchor + 1
    best, width = np.arange(len(runs)), 1

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(runs[a] <= runs[b], a, b)

    while 2 * width <= reach:
        best = lesser(best, best[np.minimum(np.arange(len(best)) + width, len(best) - 1)])
        width *= 2
    place = lesser(best[starts], best[starts + reach - width]) if len(starts) else starts
    return starts, place, runs[place] if len(starts) else np.zeros(0, np.uint64)


def passages(w: Words, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, first and last window (word numbers in the block), anchor."""
    starts, place, anchor = window_anchors(w, window)
    if not len(starts):
        return (starts,) * 3 + (anchor,)
    # 62 windows at most, as a passage's windows are bits of a long.
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return w.text[starts[first]], starts[first], starts[last], anchor[first]


class _Sums:
    """Hashes of any stretch of a block's words, from running sums."""

    def __init__(self, w: Words):
        factor = np.uint64(0xD1342543DE82EF95)
        n = len(w) + 1
        self.powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, factor)]))
        inverse = np.uint64(pow(int(factor), -1, 1 << 64))
        self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(w.hash * self.powers[: len(w)])])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.inverse[first] + (end - first).astype(np.uint64))


_PLACE = "doc_id long, text_hash long, anchor long, same long, low int, high int"


def places(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every passage of every document: its anchor, a hash of its words, its first and last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            w = Words(batch.column("text"))
            text, low, high, anchor = passages(w, window)
            if not len(text):
                continue
            same = _Sums(w).of(low, high + window)
            at = pa.array(text)
            first = w.first[text]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(anchor.astype(np.int64)),
                    pa.array(same.astype(np.int64)), pa.array((low - first).astype(np.int32)),
                    pa.array((high - first).astype(np.int32)),
                ],
                names=["doc_id", "text_hash", "anchor", "same", "low", "high"],
            )

    return docs.mapInArrow(run, _PLACE)


def _lists(frame: DataFrame, name: str, *fields: str) -> DataFrame:
    """One list for each document; as long as its own text allows."""
    return frame.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*fields)).alias(name))


def _flat(column: pa.Array, fields: list[str]) -> tuple[np.ndarray, ...]:
    """Row number and fields of all entries of a list-of-struct column."""
    inner = column.flatten()
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())
    return row, *(inner.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _single_windows(owned: DataFrame, window: int) -> DataFrame:
    """The windows of crowded passages, each keyed by its own words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            w = Words(batch.column("text"))
            row, anchor, same, low, high, last = _flat(batch.column("owned"), ["anchor", "same", "low", "high", "last"])
            n = high - low + 1
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, anchor, same, last = (np.repeat(x, n) for x in (row, anchor, same, last))
            first = w.first[row] + np.repeat(low, n) + place
            key = _Sums(w).of(first, first + window).astype(np.int64)
            raw = w.raw.tobytes()
            cut = zip(w.start[first].tolist(), w.end[first + window - 1].tolist(), strict=True)
            columns = [pa.array(key), pa.array(anchor), pa.array(same), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns, batch.column("doc_id").take(pa.array(row)), pa.array(last),
                    pa.array([raw[i:j] for i, j in cut], pa.binary()).cast(pa.string()),
                ],
                names=["window", "anchor", "same", "place", "owner", "last", "words"],
            )

    schema = "window long, anchor long, same long, place int, owner long, last long, words string"
    return owned.select("doc_id", "text", "owned").mapInArrow(run, schema)


def _with_words(owned: DataFrame, window: int) -> DataFrame:
    """The words of each passage, cut from its owner's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            w = Words(batch.column("text"))
            row, key, same, low, high, last = _flat(batch.column("owned"), ["anchor", "same", "low", "high", "last"])
            first, end = w.first[row] + low, w.first[row] + high + window
            a, b = w.start[first], w.end[end - 1]
            raw = w.raw.tobytes()
            texts = [raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            columns = [pa.array(key), pa.array(same), batch.column("doc_id").take(pa.array(row)), pa.array(last)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.binary()).cast(pa.string())],
                names=["anchor", "same", "owner", "last", "words"],
            )

    schema = "anchor long, same long, owner long, last long, words string"
    return owned.select("doc_id", "text", "owned").mapInArrow(run, schema)


def _searched(passages_: DataFrame, window: int, shards: int) -> DataFrame:
    """By passage: windows found at a smaller document, as its owner reads it and as the others do."""

    def run(group: pa.Table) -> pa.Table:
        w = Words(group.column("words"))
        owner, last = group.column("owner").to_numpy(), group.column("last").to_numpy()
        lengths = w.counts.astype(np.int64)
        index = FMIndex(w.hash, lengths, owner)
        others = last > owner
        # Both readings in one pass: the steps that only a few passages need are taken once.
        symbols = np.concatenate([index.spelled, index.spelled[np.repeat(others, lengths)]])
        readers = np.concatenate([owner, last[others]])
        found = index.covered(symbols, np.concatenate([lengths, lengths[others]]), readers, window)
        as_owner, as_other = found[: len(lengths)], np.zeros(len(lengths), np.int64)
        as_other[others] = found[len(lengths) :]
        return pa.table(
            {"anchor": group.column("anchor"), "same": group.column("same"), "as_owner": as_owner, "as_other": as_other}
        )

    dealt = passages_.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(run, "anchor long, same long, as_owner long, as_other long")


def copies(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(candidates, covered): texts that share an anchor with another document, and their windows to go.

    Candidates: doc_id, text_hash, text. Covered: doc_id, text_hash, covered (list of first
    window and bits from it on).
    """
    ship_package(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string")).filter(
        "doc_id IS NOT NULL"
    )
    found = saved(places(keyed, window), "places")
    by_anchor = found.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    wanted = saved(found.join(by_anchor.filter("least < most").select("anchor"), "anchor", "left_semi"), "shared-places")
    known = wanted.groupBy("anchor", "same").agg(
        F.min(F.struct("doc_id", "text_hash", "low", "high")).alias("o"), F.max("doc_id").alias("last")
    )
    known = saved(known.select("anchor", "same", "last", "o.*"), "passages")
    crowded = known.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CROWDED).select("anchor")
    apart = known.join(crowded, "anchor", "left_semi")
    together = known.join(crowded, "anchor", "left_anti")
    candidates = saved(keyed.join(wanted.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_semi"), "candidates")

    def owned(some: DataFrame) -> DataFrame:
        lists = _lists(some, "owned", "anchor", "same", "low", "high", "last")
        # Rows that repeat an id and a text are one owner.
        return candidates.dropDuplicates(["doc_id", "text_hash"]).join(lists, ["doc_id", "text_hash"])

    singles = saved(_single_windows(owned(apart), window), "windows")
    distinct = singles.groupBy("window").agg(F.min("owner").alias("owner"), F.max("last").alias("last"), F.first("words").alias("words"))
    distinct = distinct.filter("owner < last").select(F.col("window").alias("anchor"), F.col("window").alias("same"), "owner", "last", "words")
    shards = max(-(-(known.count() + singles.count()) * (window + 15) // shard_words), 1)
    streamed = _with_words(owned(together), window).unionByName(distinct)
    bits = _searched(streamed, window, shards).filter("as_owner <> 0 OR as_other <> 0")
    bits = saved(bits, "passage-bits")
    least = distinct.select(F.col("anchor").alias("window"), F.col("owner").alias("least"))
    hits = bits.select(F.col("anchor").alias("window")).join(least, "window")
    bit = F.expr("shiftleft(1L, place)")
    whole = singles.join(hits, "window").groupBy("anchor", "same").agg(
        F.bit_or(F.when(F.col("least") < F.col("owner"), bit).otherwise(F.lit(0).cast("long"))).alias("as_owner"),
        F.bit_or(F.when(F.col("least") < F.col("last"), bit).otherwise(F.lit(0).cast("long"))).alias("as_other"),
    )
    bits = bits.join(known.select("anchor", "same"), ["anchor", "same"], "left_semi").unionByName(whole)
    bits = bits.join(known.select("anchor", "same", F.col("doc_id").alias("owner")), ["anchor", "same"])
    covered = wanted.join(bits, ["anchor", "same"]).select(
        "doc_id", "text_hash", "low", F.when(F.col("doc_id") == F.col("owner"), F.col("as_owner")).otherwise(F.col("as_other")).alias("bits")
    )
    return candidates, _lists(covered.filter("bits <> 0"), "covered", "low", "bits")


def words_to_go(w: Words, covered: pa.Array, window: int = WINDOW) -> np.ndarray:
    """By word of a block: whether a covered window holds it."""
    row, low, bits = _flat(covered, ["low", "bits"])
    change = np.zeros(len(w) + 1, np.int64)
    for k in range(int(bits.max(initial=0)).bit_length()):
        hit = (bits >> k) & 1 > 0
        first = w.first[row[hit]] + low[hit] + k
        np.add.at(change, first, 1)
        np.add.at(change, first + window, -1)
    return np.cumsum(change[:-1]) > 0


def _kept(w: Words, gone: np.ndarray) -> list[bytes]:
    """The words left of each text, joined by one space."""
    keep = np.flatnonzero(~gone)
    cut = np.searchsorted(keep, w.first)
    # A word that another of its text follows takes the byte after it along, as the space.
    more = np.ones(len(keep), bool)
    more[cut[1:][cut[1:] > cut[:-1]] - 1] = False
    edge = np.zeros(len(w.raw) + 2, np.int8)
    edge[w.start[keep]] += 1
    edge[w.end[keep] + more] -= 1
    stay = np.cumsum(edge[:-2], dtype=np.int8).view(bool)
    raw = w.raw.copy()
    raw[w.end[keep[more]]] = 0x20
    left = raw[stay].tobytes()
    # Bytes left before each text.
    size = np.concatenate([[0], np.cumsum(w.end[keep] - w.start[keep] + more)])[cut].tolist()
    return [left[a:b] for a, b in zip(size[:-1], size[1:], strict=True)]


def dedup_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``."""
    candidates, covered = copies(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            w = Words(batch.column("text"))
            gone = words_to_go(w, batch.column("covered"), window) if "covered" in batch.schema.names else np.zeros(len(w), bool)
            digests = [hashlib.sha256(k).hexdigest() for k in _kept(w, gone)]
            removed = np.bincount(w.text[gone], minlength=batch.num_rows)
            columns = [pa.array(w.counts.astype(np.int64)), pa.array(removed), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), *columns],
                names=["doc_id", "text_hash", "n_words", "n_removed", "kept_sha256"],
            )

    schema = "doc_id long, text_hash long, n_words long, n_removed long, kept_sha256 string"
    changed = candidates.join(covered, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "covered")
    changed = changed.mapInArrow(run, schema).groupBy("doc_id", "text_hash").agg(
        F.max("n_removed").alias("removed"), F.max("kept_sha256").alias("left")
    )
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return keyed.mapInArrow(run, schema).join(changed, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_words", F.coalesce("removed", "n_removed").alias("n_removed"), F.coalesce("left", "kept_sha256").alias("kept_sha256")
    )


def without_copies(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the copied words taken out of its texts, other columns as they are."""
    _, covered = copies(docs, window)
    covered = covered.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("covered").alias("__covered"))
    on = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    joined = docs.join(covered, on, "left").drop("__id", "__hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            w = Words(batch.column("text"))
            lists = batch.column("__covered")
            left = _kept(w, words_to_go(w, lists, window))
            old = batch.column("text").to_pylist()
            new = [t if none else k.decode() for t, k, none in zip(old, left, lists.is_null().to_pylist(), strict=True)]
            names = [n for n in batch.schema.names if n != "__covered"]
            columns = [pa.array(new, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)


def op1_substring(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_digests(spark.read.parquet(f"{folder}/documents.parquet"))


_ORACLE = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), n AS (SELECT doc_id, ws, len(ws) AS n FROM w),
wins AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, n - 48)) AS s FROM n WHERE n >= 50)
), least AS (SELECT h, min(doc_id) AS d FROM wins GROUP BY h),
hit AS (SELECT doc_id, s FROM wins JOIN least USING (h) WHERE d < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM hit),
lists AS (SELECT doc_id, count(*) AS k, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN k IS NULL THEN ws ELSE
    list_transform(list_filter(range(1, n + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM n LEFT JOIN lists ON n.doc_id = lists.doc_id
"""

QUERIES = {"op1_substring": op1_substring}
ORACLE_SQL = {"op1_substring": _ORACLE}
