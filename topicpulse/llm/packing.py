"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens. A quantum (a few tokens) of a source is due at the moment
its target share entitles it to: quantum ``j`` of a source with share ``p`` at ``(j + 1/2) / p``.
Serving quanta in the order of these moments is the round-robin whose deficits never exceed
one quantum: whatever a source is short of in one window is carried into the next one, and,
as the moments follow from a token's place in its queue alone, from one partition to the
next. A source that runs dry drops out and the others share its place.

The place of a document in its queue is the sum over earlier partitions (one small row for
each partition and source) plus what its own partition holds before it, so token arrays are
written once, read once, and never shuffled.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicpulse.llm.words import blocks
from topicpulse.session import saved, ship_package

WINDOW = 2048
QUANTUM = 32
END_TOKEN = 1
VOCABULARY = "byte_bpe_50k"
_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}
_CHUNK = 1024  # windows worked out together


def encoder(vocabulary: str = VOCABULARY) -> Callable[[str], np.ndarray]:
    """Text to ids as ``tokenizers`` gives them for ``<vocabulary>.json``.

    The same vocabulary as ranks serves most texts at four times the speed; what holds the
    special token's text, or is refused, goes to ``tokenizers`` itself (tested to be equal).
    """
    if vocabulary not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(k): int(v) for k, v in (line.split() for line in lines if line.strip())}
        fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if not any(s in text for s in special):
                try:
                    return fast.encode_to_numpy(text, disallowed_special=())
                except BaseException as e:  # a panic of the Rust code is no Exception
                    if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                        raise
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

        _ENCODERS[vocabulary] = encode
    return _ENCODERS[vocabulary]


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END_TOKEN) -> DataFrame:
    """Token arrays with the place of each document among its partition's tokens of its source."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, so_far = encoder(vocabulary), TaskContext.get().partitionId(), {}
        for batch in blocks(batches, "text"):
            sources = batch.column("source").to_pylist()
            last = np.array([end], "<u4").tobytes()
            ids = [encode(t or "").astype("<u4", copy=False).tobytes() + last for t in batch.column("text").to_pylist()]
            sizes = [len(x) // 4 for x in ids]
            before = []
            for source, n in zip(sources, sizes, strict=True):
                before.append(so_far.get(source, 0))
                so_far[source] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(sources, pa.string()),
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(before, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "source", "part", "before", "n_tokens", "ids"],
            )

    schema = "doc_id long, source string, part int, before long, n_tokens long, ids binary"
    return docs.select("doc_id", "text", F.col("source").cast("string").alias("source")).mapInArrow(run, schema)


class Schedule:
    """When each source's quanta are served; all in closed form from shares and queue lengths."""

    def __init__(self, totals: list[int], shares: list[float], window: int = WINDOW, quantum: int = QUANTUM):
        if window % quantum:
            raise ValueError("the quantum must divide the window")
        self.tokens = np.array(totals, np.int64)
        self.quanta = -(-self.tokens // quantum)
        self.shares = np.array(shares, float) / sum(shares)
        self.window, self.quantum, self.slots = window, quantum, window // quantum
        self._known: dict[int, np.ndarray] = {}

    def moment(self, source: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (j + 0.5) / self.shares[source]

    def _due(self, moment: np.ndarray, tie: bool) -> np.ndarray:
        """By moment and source: quanta due before it (with ``tie``: or at it)."""
        s = np.arange(len(self.shares))[None, :]
        j = np.clip(np.floor(moment[:, None] * self.shares - 0.5), 0, self.quanta).astype(np.int64)
        for _ in range(2):  # the division's rounding decides, so that all tasks agree
            over = self.moment(s, j - 1) > moment[:, None] if tie else self.moment(s, j - 1) >= moment[:, None]
            j = np.where((j > 0) & over, j - 1, j)
            under = self.moment(s, j) <= moment[:, None] if tie else self.moment(s, j) < moment[:, None]
            j = np.where((j < self.quanta) & under, j + 1, j)
        return np.minimum(j, self.quanta)

    def rank(self, source: int, j: np.ndarray) -> np.ndarray:
        """Place of a source's quanta in the order of service (ties: the first source first)."""
        at = self.moment(np.full(len(j), source), j)
        before = self._due(at, False)
        before[:, :source] = self._due(at, True)[:, :source]
        before[:, source] = j
        return before.sum(axis=1)

    def filled(self, windows: np.ndarray) -> np.ndarray:
        """By window and source: quanta served before the window begins."""
        target = np.minimum(windows * self.slots, self.quanta.sum())
        low = np.zeros(len(windows))
        high = np.full(len(windows), float(((self.quanta + 1) / self.shares).max()))
        for _ in range(1100):
            middle = (low + high) / 2
            few = self._due(middle, True).sum(axis=1) <= target
            if ((middle == low) | (middle == high)).all():
                break
            low, high = np.where(few, middle, low), np.where(few, high, middle)
        out = self._due(low, True)
        rest = target - out.sum(axis=1)
        tied = self._due(high, True) - out  # those due at the very moment: the first sources first
        return out + np.clip(rest[:, None] - (np.cumsum(tied, axis=1) - tied), 0, tied)

    def _chunk(self, k: int) -> np.ndarray:
        """Tokens of each source served before windows ``k * _CHUNK`` to ``(k + 1) * _CHUNK``."""
        if k not in self._known:
            if len(self._known) > 64:
                self._known.clear()
            windows = np.arange(k * _CHUNK, (k + 1) * _CHUNK + 1)
            self._known[k] = np.minimum(self.filled(windows) * self.quantum, self.tokens)
        return self._known[k]

    def all_pieces(self, source: int, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of documents at ascending places of one queue.

        Arrays: number of the document, start in it, length, window, offset there.
        """
        ends = np.array([start[0] // self.quantum, (start[-1] + length[-1] - 1) // self.quantum])
        first, last = self.rank(source, ends) // self.slots // _CHUNK
        parts = [self._chunk(int(k)) for k in range(first, last + 1)]
        served = np.concatenate([*(x[:-1] for x in parts), parts[-1][-1:]])
        edge = served[:, source]
        ahead = np.diff(served[:, :source], axis=0).sum(axis=1)
        low = np.searchsorted(edge, start, "right") - 1
        high = np.searchsorted(edge, start + length - 1, "right") - 1
        n = high - low + 1
        doc = np.repeat(np.arange(len(start)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        at = np.maximum(start[doc], edge[k])
        size = np.minimum((start + length)[doc], edge[k + 1]) - at
        full = size > 0
        doc, k, at, size = doc[full], k[full], at[full], size[full]
        return doc, at - start[doc], size, first * _CHUNK + k, ahead[k] + at - edge[k]


def pack(
    docs: DataFrame,
    shares: dict[str | None, float] | None = None,
    window: int = WINDOW,
    quantum: int = QUANTUM,
    vocabulary: str = VOCABULARY,
    end: int = END_TOKEN,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents in windows that follow the target shares of the sources.

    ``shares`` gives a weight by source (a source that it leaves out gets the smallest one);
    by default the sources' own token shares, so that all queues last to the end and only
    their last quanta leave padding. Sources are the components of a mixture: their number,
    not that of documents, is what the driver sees. Defined cases: a null text is empty and
    still has its end token; a null source is a source of its own; null or repeated ids and
    repeated rows are packed row by row; an empty table gives no pieces.

    Rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source and, with
    ``with_ids``, ids (unsigned little-endian 32-bit).
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark = docs.sparkSession
    tokens = saved(tokenised(docs, vocabulary, end), "tokens")
    by_part = tokens.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    by_part = saved(by_part, "token-counts")
    totals = by_part.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_first()).toPandas()
    names = [None if pd.isna(s) else s for s in totals["source"]]
    counts = [int(n) for n in totals["n"]]
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "`offset` long, source string" + (", ids binary" if with_ids else "")
    )
    if not names:
        return spark.createDataFrame([], schema)
    if shares is None:
        weights = [float(n) for n in counts]
    else:
        weights = [float(shares.get(s, min(shares.values()))) for s in names]
        if min(weights) <= 0:
            raise ValueError("shares must be above zero")
    schedule = Schedule(counts, weights, window, quantum)
    number = {s: i for i, s in enumerate(names)}
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = by_part.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = tokens.alias("t").join(
        places.alias("p"), F.expr("t.source <=> p.source AND t.part = p.part")
    ).select("doc_id", "t.source", (F.col("base") + F.col("before")).alias("place"), "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2000):
                yield cut(whole.slice(first, 2000))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sources = np.array([number[s] for s in batch.column("source").to_pylist()])
        place = batch.column("place").to_numpy()
        length = batch.column("n_tokens").to_numpy()
        doc_id = batch.column("doc_id")
        ids = batch.column("ids").to_pylist()
        order = np.lexsort((place, sources))
        far = place[order][1:] - (place + length)[order][:-1] > 64 * window
        runs = np.split(order, 1 + np.flatnonzero(far | (np.diff(sources[order]) > 0)))
        found = []
        for rows in runs:
            doc, *piece = schedule.all_pieces(int(sources[rows[0]]), place[rows], length[rows])
            found.append((rows[doc], *piece))
        row, start, size, sequence, offset = (np.concatenate(x) for x in zip(*found, strict=True))
        cuts = zip(row.tolist(), (4 * start).tolist(), (4 * (start + size)).tolist(), strict=True)
        pieces = [ids[r][a:b] for r, a, b in cuts]
        columns = [
            doc_id.take(pa.array(row)), pa.array(start), pa.array(size), pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
            pa.array(length[row]), pa.array(sequence), pa.array(offset), batch.column("source").take(pa.array(row)),
        ]
        fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        if with_ids:
            columns, fields = [*columns, pa.array(pieces, pa.binary())], [*fields, "ids"]
        return pa.RecordBatch.from_arrays(columns, names=fields)

    return placed.mapInArrow(run, schema)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(spark.read.parquet(f"{folder}/documents.parquet"), with_ids=False)


QUERIES = {"op2_packing": op2_packing}
ORACLE_SQL: dict[str, str] = {}
