"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Texts are normalised as the vocabulary asks: a whitespace marker before the text and for
every space, nothing else changed. The best path is the one with the largest sum of piece
log scores; a character that no piece of its own covers falls back to its bytes. Ties go
to the longer last piece.

The public vocabulary holds ranks. They become log scores by Zipf's law: the piece of rank
``r`` has ``-ln((r + 1) H)``, where ``H`` is the harmonic number of all pieces.

No piece goes on past a marker that follows something else, nor over a character that is in
no longer piece, so a text falls into units that are solved alone: each different unit of a
block once, all of one length class together in numpy.

Defined cases: a null or empty text has no pieces; repeated rows and ids are encoded row by
row; an empty table gives no rows; other columns are ignored. The marker character itself
in a text reads as a space, as in SentencePiece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from topicpulse.llm.words import blocks, hash_spans, mix, text_buffers
from topicpulse.session import ship_package

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
_MARKER = "▁"
_SPACE = 0x20


@dataclass(frozen=True)
class DoubleArray:
    """Trie in two arrays: the child of ``s`` by byte ``b`` is ``base[s] + b`` if ``check`` says ``s``."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys.items():
            node = 0
            for byte in key:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][byte]
            values[node] = value
        size = 2 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        place, first_free = {0: 0}, 1
        # Nodes with many children first: they are the hard ones to fit.
        order = sorted(range(len(children)), key=lambda n: -len(children[n]))
        bases: dict[int, int] = {}
        for node in order:
            byte_list = sorted(children[node])
            if not byte_list:
                break
            low = byte_list[0]
            at = first_free
            while True:
                at = taken.index(0, at)
                b = at - low
                if b >= 0 and b + byte_list[-1] < size and not any(taken[b + c] for c in byte_list):
                    break
                at += 1
            for c in byte_list:
                taken[b + c] = 1
                place[children[node][c]] = b + c
            bases[node] = b
            first_free = taken.index(0, first_free)
        for node, kids in enumerate(children):
            me = place[node]
            value[me] = values[node]
            if kids:
                base[me] = bases[node]
                for c in kids:
                    check[bases[node] + c] = me
        return cls(base, check, value)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and which of them exist."""
        at = self.base[state] + byte
        return at, self.check[at] == state


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their trie; markers are held as spaces."""

    trie: DoubleArray
    score: np.ndarray  # by id
    piece_bytes: np.ndarray  # bytes of all pieces, one after another
    piece_end: np.ndarray  # end of each id's bytes there
    byte_id: np.ndarray  # id of each byte's fallback piece
    unknown: float
    lonely: np.ndarray  # bytes that are a unit of their own
    whole: bool  # pieces cross spaces, so that a text is one unit


def log_scores(ranks: np.ndarray) -> np.ndarray:
    harmonic = (1 / np.arange(1, len(ranks) + 1)).sum()
    return -np.log((ranks + 1) * harmonic)


@cache
def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    size = model.get_piece_size()
    texts, keys, byte_id = [b""] * size, {}, np.zeros(256, np.int32)
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_id[int(piece[3:5], 16)] = i
            texts[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            texts[i] = piece.replace(_MARKER, " ").encode()
            keys[texts[i]] = i
    normal = np.array(list(keys.values()))
    ranks = np.argsort(np.argsort([-model.get_score(int(i)) for i in normal], kind="stable"), kind="stable")
    score = np.full(size, -np.inf, np.float32)
    score[normal] = log_scores(ranks)
    crossing = any(b" " in k.lstrip(b" ") for k in keys)
    longer = set(b"".join(k for k in keys if len(k) > 1))
    lonely = np.array([b < 0x20 and b not in longer for b in range(256)])
    return Vocabulary(
        DoubleArray.build(keys), score, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]),
        byte_id, float(score[normal].min() - UNKNOWN_PENALTY), lonely, crossing,
    )


_CHAR_BYTES = np.ones(256, np.int64)
_CHAR_BYTES[0xC0:0xE0], _CHAR_BYTES[0xE0:0xF0], _CHAR_BYTES[0xF0:] = 2, 3, 4
_CONTINUED = (np.arange(256) & 0xC0) == 0x80


def viterbi(v: Vocabulary, matrix: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best paths of padded byte strings: (row, id) of the pieces, row by row in text order."""
    rows, width = matrix.shape
    best = np.full((rows, width + 1), -np.inf, np.float32)
    best[:, 0] = 0
    back = np.zeros((rows, width + 1), np.int32)
    piece = np.full((rows, width + 1), -1, np.int32)
    everyone = np.arange(rows)
    for i in range(width):
        start = everyone[(length > i) & (best[:, i] > -np.inf)]
        if not len(start):
            continue
        single = i + _CHAR_BYTES[matrix[start, i]]
        covered = np.zeros(rows, bool)
        live, state, d = start, np.zeros(len(start), np.int64), i
        one = np.zeros(rows, np.int64)
        one[start] = single
        while len(live):
            state, there = v.trie.step(state, matrix[live, d].astype(np.int64))
            live, state = live[there], state[there]
            d += 1
            found = v.trie.value[state]
            hit = found >= 0
            at = live[hit]
            if len(at):
                covered[at[one[at] == d]] = True
                total = best[at, i] + v.score[found[hit]]
                better = total > best[at, d]
                at, total = at[better], total[better]
                best[at, d], back[at, d], piece[at, d] = total, i, found[hit][better]
            more = length[live] > d
            live, state = live[more], state[more]
        bare = start[~covered[start]]
        if len(bare):
            end = np.minimum(one[bare], length[bare])
            total = best[bare, i] + np.float32(v.unknown)
            better = total > best[bare, end]
            bare, end = bare[better], end[better]
            best[bare, end], back[bare, end], piece[bare, end] = total[better], i, -1
    owners, ids, places = [], [], []
    at, live = length.copy(), everyone[length > 0]
    while len(live):
        end = at[live]
        first, which = back[live, end], piece[live, end]
        known = which >= 0
        owners.append(live[known])
        ids.append(which[known])
        places.append(first[known])
        bare, size = live[~known], (end - first)[~known]
        for k in range(int(size.max(initial=0))):
            some = size > k
            owners.append(bare[some])
            ids.append(v.byte_id[matrix[bare[some], first[~known][some] + k]])
            places.append(first[~known][some] + k)
        at[live] = first
        live = live[first > 0]
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    owner, which, place = np.concatenate(owners), np.concatenate(ids), np.concatenate(places)
    order = np.lexsort((place, owner))
    return owner[order], which[order]


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indexes ``first[i] .. first[i] + n[i] - 1`` of all i, one after another."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def encode(v: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the n + 1 offsets of the texts there."""
    if pc.any(pc.match_substring(column, _MARKER)).as_py():
        column = pc.replace_substring(column, _MARKER, " ")
    raw, offsets = text_buffers(column)
    texts = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(texts + 1, np.int64)
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    if not v.whole:
        space, alone = raw == _SPACE, v.lonely[raw]
        cut[1:-1] |= (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    # The marker before the text belongs to its first unit.
    leads = np.isin(start, offsets[:-1][np.diff(offsets) > 0])
    key = hash_spans(raw, start, end)
    key[leads] = mix(key[leads] + np.uint64(1))
    _, sample, unit = np.unique(key, return_index=True, return_inverse=True)
    size = end[sample] - start[sample] + leads[sample]
    owners, ids = [], []
    order = np.argsort(size, kind="stable")
    for low, high in _classes(size[order]):
        some = order[low:high]
        width = int(size[some].max())
        matrix = np.zeros((len(some), width), np.uint8)
        lead = leads[sample[some]].astype(np.int64)
        matrix[lead > 0, 0] = _SPACE
        n = size[some] - lead
        row = np.repeat(np.arange(len(some)), n)
        matrix[row, _spread(lead, n)] = raw[_spread(start[sample[some]], n)]
        owner, which = viterbi(v, matrix, size[some])
        owners.append(some[owner])
        ids.append(which)
    owner, which = np.concatenate(owners), np.concatenate(ids)
    order = np.argsort(owner, kind="stable")
    which, n = which[order], np.bincount(owner, minlength=len(sample))
    first = np.cumsum(n) - n
    out = which[_spread(first[unit], n[unit])]
    ends = np.concatenate([[0], np.cumsum(n[unit])])
    return out, ends[np.searchsorted(start, offsets)]


def _classes(size: np.ndarray, cells: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of ascending sizes that fill a bounded matrix with little padding."""
    low = 0
    while low < len(size):
        most = max(int(size[low]) * 5 // 4 + 2, 8)
        high = int(np.searchsorted(size, most, "right"))
        high = min(high, low + max(cells // most, 1))
        yield low, high
        low = high


def decode(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and their n + 1 offsets; the first marker goes."""
    start = np.concatenate([[0], v.piece_end[:-1]])
    n = (v.piece_end - start)[ids]
    out = v.piece_bytes[_spread(start[ids], n)]
    ends = np.concatenate([[0], np.cumsum(n)])[offsets]
    leads = ends[:-1][np.diff(ends) > 0]
    leads = leads[out[leads] == _SPACE]
    keep = np.ones(len(out), bool)
    keep[leads] = False
    return out[keep], ends - np.searchsorted(leads, ends)


def encoded(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array of int) and the text decoded from them."""
    return _mapped(docs, name, "doc_id long, ids array<int>, decoded string", _full)


def _full(v: Vocabulary, batch: pa.RecordBatch) -> list[pa.Array]:
    ids, offsets = encode(v, batch.column("text"))
    raw, ends = decode(v, ids, offsets)
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
    texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [lists, pa.array(texts, pa.string())]


def digests(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pieces, n_fallback, ids_crc32, decoded_crc32, round_trip of every text."""
    schema = "doc_id long, n_pieces long, n_fallback long, ids_crc32 long, decoded_crc32 long, round_trip boolean"
    return _mapped(docs, name, schema, _digest)


def _digest(v: Vocabulary, batch: pa.RecordBatch) -> list[pa.Array]:
    raw, starts = text_buffers(batch.column("text"))
    ids, offsets = encode(v, batch.column("text"))
    out, ends = decode(v, ids, offsets)
    is_byte = np.zeros(len(v.score), np.int64)
    is_byte[v.byte_id] = 1
    fallback = np.concatenate([[0], np.cumsum(is_byte[ids])])
    ids = ids.astype("<u4")
    crcs, decoded, same = [], [], []
    for t in range(len(offsets) - 1):
        crcs.append(zlib.crc32(ids[offsets[t] : offsets[t + 1]]))
        text = out[ends[t] : ends[t + 1]]
        decoded.append(zlib.crc32(text))
        same.append(text.tobytes() == raw[starts[t] : starts[t + 1]].tobytes())
    return [
        pa.array(np.diff(offsets)), pa.array(np.diff(fallback[offsets])),
        pa.array(crcs, pa.int64()), pa.array(decoded, pa.int64()), pa.array(same, pa.bool_()),
    ]


def _mapped(docs: DataFrame, name: str, schema: str, columns) -> DataFrame:
    ship_package(docs.sparkSession)
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name)
        for batch in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns(v, batch)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return digests(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
