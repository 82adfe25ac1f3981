"""Languages of texts and of their spans.

Words are runs of letters, cut where the script changes; in scripts written without spaces
each letter is a word. A word's script narrows the languages it can have to those that wrote
a hundredth or more of their training letters in it (all languages if none did). For those, a
word's score is its log probability: the language's share of that word among its training
words, mixed with a model of letter triples for words it has not seen. Scores are taken
against the best one and bounded, so that no single word decides alone. Viterbi search then
labels each text's words: staying in a language is free, switching costs ``SWITCH``. Runs of a
label are the spans, and the language whose spans hold most letters is the text's.

The search runs over whole blocks of texts at once: a block's words form one chain, in which
a switch at the first word of a text is free. The chain is cut into segments that advance
together; each segment is a max-plus matrix from the state before it to the state at its
end, which joins the segments exactly. So a text of any length is searched whole.

The model is fitted on at most ``SAMPLE_ROWS`` training documents of each language, the first
by hash of their id. The counts are aggregated by Spark into hashed tables of fixed size.

Defined cases: a null text or one without letters is ``und`` with score 0, as is every text if
nothing can be learnt; rows without id are never learnt from and never held out; equal letter
counts go to the smaller language name; rows that repeat an id are predicted one by one; an
empty table gives no rows. The score is the share of the text's letters in spans of its
language. Neither ``lang``, ``source`` nor ``doc_id`` is read for a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicpulse.llm.words import BLOCK_BYTES, blocks, hash_spans, mix, text_buffers
from topicpulse.session import ship_package

SAMPLE_ROWS = 3000
WORD_BITS, TRIPLE_BITS, PAIR_BITS, LETTER_BITS = 18, 17, 15, 12
UNSEEN = 0.05  # weight of the letter model against the word's own share
BOUND = 6.0
FOREIGN = 20.0  # cost of a word in a language that does not write its script
SWITCH = 10.0
SCRIPT_SHARE = 0.01
SEGMENT = 256
UNKNOWN = "und"

# Scripts by range of code points (first, last).
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F),
    ("lao", 0x0E80, 0x0EFF),
    ("tibetan", 0x0F00, 0x0FFF),
    ("myanmar", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0x3130, 0x318F), ("hangul", 0xAC00, 0xD7AF),
    ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF),
    ("hiragana", 0x3040, 0x309F),
    ("katakana", 0x30A0, 0x30FF),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x3FFFF),
]
UNSPACED = ("thai", "lao", "tibetan", "myanmar", "khmer", "hiragana", "katakana", "han")
NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
_PLANES = 0x40000  # no letter lies above


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: kind (1 letter, 2 mark), lower case, script, whether each letter is a word."""
    kind, lower = np.zeros(_PLANES + 1, np.uint8), np.arange(_PLANES + 1, dtype=np.int32)
    for c in range(_PLANES):
        category = unicodedata.category(chr(c))[0]
        if category == "L":
            kind[c] = 1
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
        elif category == "M":
            kind[c] = 2
    script, alone = np.zeros(_PLANES + 1, np.uint8), np.zeros(_PLANES + 1, bool)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = NAMES.index(name)
        alone[first : last + 1] = name in UNSPACED
    return kind, lower, script, alone & (kind == 1)


class LetterWords:
    """The words of a block: code point span, text number, script, letters and hash of each."""

    def __init__(self, column: pa.Array):
        raw, at = text_buffers(column)
        texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
        self.texts = len(texts)
        size = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.minimum(points, _PLANES).astype(np.int64)
        kinds, lower, scripts, alone = _tables()
        kind, script = kinds[points], scripts[points]
        self.points = lower[points]
        is_letter, edge = kind == 1, np.zeros(len(points) + 1, bool)
        edge[self.offsets] = True
        cut, inside = edge[:-1].copy(), kind > 0
        if len(points):
            # A mark belongs to the letter before it; without one it is no part of a word.
            place = np.arange(len(points))
            run = inside & (cut | np.append(True, ~inside[:-1]))
            holder = np.maximum.accumulate(np.where(is_letter, place, -1))
            inside = is_letter | (inside & (holder >= np.maximum.accumulate(np.where(run, place, 0))))
            script, alone = script[holder], alone[points[holder]] & inside
            cut[1:] |= ~inside[:-1] | ((script[1:] != script[:-1]) & is_letter[1:]) | ((alone[1:] | alone[:-1]) & is_letter[1:])
        start = np.flatnonzero(inside & cut)
        end = np.append(start[1:], len(points))
        stop = np.flatnonzero(np.append(~inside, True) | edge)
        end = np.minimum(end, stop[np.searchsorted(stop, start, "right")]) if len(start) else end[:0]
        letters = np.concatenate([[0], np.cumsum(is_letter)])
        count = letters[end] - letters[start]
        start, end, self.letters = start[count > 0], end[count > 0], count[count > 0]
        self.start, self.end, self.script = start, end, script[start]
        self.text = np.searchsorted(self.offsets, start, "right") - 1
        self.first = np.searchsorted(start, self.offsets)
        self.hash = hash_spans(self.points, start, end)

    def __len__(self) -> int:
        return len(self.start)


def _grams(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, pair, letter): buckets for each letter of the words and their ends, with what goes before."""
    size = end - start + 3
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(start)), size)
    inside = np.arange(int(size.sum())) - first[word]
    c = np.where(inside < 2, 1, 2).astype(np.uint64)
    real = (inside >= 2) & (inside < size[word] - 1)
    c[real] = points[(start[word] + inside - 2)[real]].astype(np.uint64)
    at = np.flatnonzero(inside >= 2)
    pair = mix(c[at - 2] * np.uint64(0x9E3779B97F4A7C15) + c[at - 1])
    triple = mix(pair ^ (c[at] * np.uint64(0xC2B2AE3D27D4EB4F)))
    letter = mix(c[at])
    down = lambda h, bits: (h >> np.uint64(64 - bits)).astype(np.int64)
    return word[at], down(triple, TRIPLE_BITS), down(pair, PAIR_BITS), down(letter, LETTER_BITS)


_SIZES = {"word": 1 << WORD_BITS, "triple": 1 << TRIPLE_BITS, "pair": 1 << PAIR_BITS, "letter": 1 << LETTER_BITS, "script": len(NAMES)}


def _word_bucket(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - WORD_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Hashed counts by language, and which languages write each script."""

    languages: list[str]
    counts: dict[str, np.ndarray]
    writes: np.ndarray

    def scores(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, script: np.ndarray) -> np.ndarray:
        """By word and language: the bounded score against the word's best language."""
        n = self.counts
        word, triple, pair, letter = _grams(points, start, end)
        plain = (n["letter"][letter] + 0.5) / (n["letter"].sum(axis=0) + 0.5 * (1 << LETTER_BITS))
        p = np.log((n["triple"][triple] + plain) / (n["pair"][pair] + 1.0)).astype(float)
        spelt = np.add.reduceat(p, np.searchsorted(word, np.arange(len(start))), axis=0)
        with np.errstate(divide="ignore"):
            known = np.log(n["word"][_word_bucket(key)] / np.maximum(n["word"].sum(axis=0), 1))
        score = np.logaddexp(known, np.log(UNSEEN) + spelt)
        may = self.writes[script]
        score = np.where(may, score, -np.inf)
        score = np.maximum(score - score.max(axis=1)[:, None], -BOUND)
        return np.where(may, score, -FOREIGN)


def viterbi(emission: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Best label by position of a chain: ``emission`` by position and label, ``cost`` of a switch before each position."""
    n, k = emission.shape
    if k < 2 or not n:
        return np.zeros(n, np.int64)
    segments = -(-n // SEGMENT)
    e = np.zeros((segments * SEGMENT, k))
    e[:n] = emission
    pay = np.zeros(segments * SEGMENT)
    pay[:n] = cost
    e, pay = e.reshape(segments, SEGMENT, k), pay.reshape(segments, SEGMENT)
    through = np.where(np.eye(k, dtype=bool), 0.0, -1e18)[None].repeat(segments, axis=0)
    for t in range(SEGMENT):
        switch = through.max(axis=2) - pay[:, t, None]
        through = np.maximum(through, switch[:, :, None]) + e[:, t, None, :]
    enter = np.zeros((segments, k))
    for s in range(segments - 1):
        ahead = (enter[s][:, None] + through[s]).max(axis=0)
        enter[s + 1] = ahead - ahead.max()
    back = np.empty((segments, SEGMENT, k), np.int32)
    now, own = enter, np.arange(k)
    for t in range(SEGMENT):
        best = now.argmax(axis=1)[:, None]
        switch = np.take_along_axis(now, best, axis=1) - pay[:, t, None]
        stay = now >= switch
        back[:, t] = np.where(stay, own, best)
        now = np.where(stay, now, switch) + e[:, t]
    came = np.broadcast_to(own, (segments, k))
    for t in range(SEGMENT - 1, -1, -1):
        came = np.take_along_axis(back[:, t], came, axis=1)
    last = np.empty(segments, np.int64)
    last[-1] = now[-1].argmax()
    for s in range(segments - 1, 0, -1):
        last[s - 1] = came[s, last[s]]
    label = np.empty((segments, SEGMENT), np.int64)
    rows = np.arange(segments)
    for t in range(SEGMENT - 1, -1, -1):
        label[:, t] = last
        last = back[rows, t, last]
    return label.reshape(-1)[:n]


def word_labels(model: Model, w: LetterWords, switch: float = SWITCH) -> np.ndarray:
    """Language number of each word of a block."""
    if not len(w):
        return np.zeros(0, np.int64)
    _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    score = model.scores(w.points, w.start[first], w.end[first], w.hash[first], w.script[first])
    cost = np.full(len(w), switch)
    cost[w.first[:-1][w.first[:-1] < len(w)]] = 0.0
    return viterbi(score[inverse], cost)


def learns(doc_id: Column) -> tuple[Column, Column]:
    """Whether a document may be learnt from, and whether it is held out."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 4
    return F.coalesce(rest != 2, F.lit(False)), F.coalesce(rest == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of the sampled training documents; None if there are none with words."""
    ship_package(docs.sparkSession)
    known = docs.filter(learns(F.col("doc_id"))[0] & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # The model has a table for each language, so languages are few enough to be sent around.
    sizes = known.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("size"))
    ids = known.select("doc_id", F.col("lang").cast("string").alias("lang")).join(F.broadcast(sizes), "lang")
    # Only hashes that can be among the first reach the sort: about four times ``rows`` a language.
    share = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / 2.0**53
    ids = ids.filter(share <= 4.0 * rows / F.col("size")).select("doc_id", "lang").distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id") < 0, F.xxhash64("doc_id"), "doc_id")
    ids = ids.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= rows)
    # ``rows`` ids a language at most: the bound that lets them be sent to every executor.
    sample = known.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", "lang")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            w = LetterWords(batch.column("text"))
            names, of_text = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            lang = of_text[w.text]
            word, triple, pair, letter = _grams(w.points, w.start, w.end)
            found = {"word": (lang, _word_bucket(w.hash), None), "script": (lang, w.script.astype(np.int64), w.letters)}
            found |= {k: (lang[word], b, None) for k, b in (("triple", triple), ("pair", pair), ("letter", letter))}
            for kind, (group, bucket, weight) in found.items():
                total = np.bincount(group * _SIZES[kind] + bucket, weight, len(names) * _SIZES[kind])
                at = np.flatnonzero(total)
                columns = [pa.array(names[at // _SIZES[kind]].tolist(), pa.string()), pa.array([kind] * len(at), pa.string())]
                columns += [pa.array((at % _SIZES[kind]).astype(np.int32)), pa.array(total[at].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "kind", "bucket", "n"])

    counted = sample.select("text", "lang").mapInArrow(run, "lang string, kind string, bucket int, n long")
    # Tables of fixed size for each language reach the driver.
    got = counted.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if not len(got):
        return None
    languages = sorted(got["lang"].unique())
    place = {name: i for i, name in enumerate(languages)}
    counts = {}
    for kind, size in _SIZES.items():
        counts[kind] = np.zeros((size, len(languages)), np.float32)
        part = got[got["kind"] == kind]
        counts[kind][part["bucket"].to_numpy(), part["lang"].map(place).to_numpy()] = part["n"].to_numpy()
    script = counts.pop("script")
    writes = script / script.sum(axis=0) >= SCRIPT_SHARE
    writes[~writes.any(axis=1)] = True
    return Model(languages, counts, writes)


_SPANS = "array<struct<start:long,end:long,lang:string>>"


def label(docs: DataFrame, model: Model | None, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans (code points, end exclusive) of every document."""
    ship_package(docs.sparkSession)
    width = len(model.languages) if model else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*(model.languages if model else []), UNKNOWN], dtype=object)
        for batch in blocks(batches, "text", max(BLOCK_BYTES // max(width // 8, 1), 1 << 16)):
            w = LetterWords(batch.column("text"))
            n = w.texts
            if model is None:
                best, share = np.full(n, len(names) - 1), np.zeros(n)
                begin = np.zeros(0, np.int64)
                found = begin
            else:
                found = word_labels(model, w, switch)
                held = np.bincount(w.text * width + found, w.letters, n * width).reshape(n, width)
                whole = held.sum(axis=1)
                best = np.where(whole > 0, held.argmax(axis=1), len(names) - 1)
                share = held.max(axis=1) / np.maximum(whole, 1)
                new = np.ones(len(w), bool)
                new[1:] = (found[1:] != found[:-1]) | (w.text[1:] != w.text[:-1])
                begin = np.flatnonzero(new)
            base = w.offsets[w.text[begin]] if len(begin) else begin
            last = np.append(begin[1:], len(found))[: len(begin)] - 1
            spans = pa.StructArray.from_arrays(
                [
                    pa.array(w.start[begin] - base, pa.int64()),
                    pa.array(w.end[last] - base, pa.int64()),
                    pa.array(names[found[begin]].tolist(), pa.string()),
                ],
                names=["start", "end", "lang"],
            )
            cut = np.searchsorted(w.text[begin], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(names[best].tolist(), pa.string()),
                    pa.array(share),
                    pa.ListArray.from_arrays(pa.array(cut), spans),
                ],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, lang_pred string, score double, spans {_SPANS}")


def op11_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = label(docs, fit(docs))
    held_out = learns(F.col("doc_id"))[1].alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES = {"op11_language": op11_language}
ORACLE_SQL: dict[str, str] = {}
