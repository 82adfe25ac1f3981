"""Information-theoretic sanitisation of personal data.

Base spans (e-mail, ip, card, phone) come from patterns. The terms of every text with such
an entity are counted against it over the whole corpus, and how often a term occurs at all
is counted over all texts: a term that mostly occurs with one entity reveals it even where
the entity itself is struck out. Terms over the disclosure thresholds become spans of their
own wherever they occur, in texts without base spans too, to be generalised or, if they all
but name the entity, removed.

Disclosure of entity ``e`` by term ``t`` is ``P(e | t)``, the share of the texts with ``t``
that have ``e`` as well; the normalised pointwise mutual information of the two must reach
its own bar. All counts are of different texts: exact copies count once. One text with both
is enough, and texts that share a line count one by one.

Defined cases: a null or empty text has no spans; repeated or null ids are treated row by
row; an empty table gives no rows; other columns pass through ``sanitise`` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicpulse.llm.words import _CONTINUED, Words, blocks, hash_spans
from topicpulse.session import saved, ship_package

KINDS = ["email", "ip", "card", "phone", "term"]
TERM_CHARS = 3
MIN_NPMI = 0.5
GENERALISE_FROM, REMOVE_FROM = 0.5, 0.9

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its start fails from every later digit too.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, kinds in their order, then by start."""
    spans = []
    done = 0
    for m in _AT.finditer(text):
        # The local part is the whole run before the sign, back to the match before.
        start = m.start()
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < m.start():
            spans.append(("email", start, m.end()))
            done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def _key(term: str) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER_BYTE = np.arange(256, dtype=np.uint8)
_LOWER_BYTE[65:91] += 32
_SKETCH_BITS = 28
_SPAN = "array<struct<kind:string,start:long,end:long>>"
_FOUND = f"row long, doc_id long, sha256 string, spans {_SPAN}, hits array<struct<term:long,start:long,end:long>>"


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, end (code points of the block) and key of each term, and where each text starts."""
    w = Words(column)
    start, end = w.start.copy(), w.end.copy()
    live = np.arange(len(start))
    while len(live):
        live = live[(start[live] < end[live]) & _PUNCTUATION[w.raw[np.minimum(start[live], len(w.raw) - 1)]]]
        start[live] += 1
    live = np.arange(len(end))
    while len(live):
        live = live[(start[live] < end[live]) & _PUNCTUATION[w.raw[end[live] - 1]]]
        end[live] -= 1
    at = np.concatenate([[0], np.cumsum(~_CONTINUED[w.raw])])
    full = at[end] - at[start] >= TERM_CHARS
    key = hash_spans(_LOWER_BYTE[w.raw], start[full], end[full])
    return w.text[full], at[start[full]], at[end[full]], key, at[w.offsets]


def apart(start: np.ndarray, end: np.ndarray, base: np.ndarray, spans: list[list[tuple[str, int, int]]]) -> np.ndarray:
    """By term: whether no span of its text touches it."""
    taken: list[list[int]] = []
    for first, own in zip(base.tolist(), spans, strict=False):
        for a, b in sorted((first + a, first + b) for _, a, b in own):
            if taken and a <= taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], b)
            else:
                taken.append([a, b])
    if not taken:
        return np.ones(len(start), bool)
    left, right = np.array(taken).T
    k = np.searchsorted(left, end) - 1
    return (k < 0) | (right[np.maximum(k, 0)] <= start)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """A list of the values of each owner; owners ascend."""
    offsets = np.searchsorted(owner, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def private_texts(docs: DataFrame) -> DataFrame:
    """By different text with base spans: its entities, and its terms outside these spans."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            places, spans, entities = [], [], []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                if found := base_spans(text):
                    places.append(i)
                    spans.append(found)
                    entities.append(sorted({_key(f"{kind}:{text[a:b].lower()}") for kind, a, b in found}))
            if not places:
                continue
            own = batch.take(pa.array(places))
            text, start, end, key, base = terms_of(own.column("text"))
            free = apart(start, end, base, spans)
            text, key = text[free], key[free].astype(np.int64)
            order = np.lexsort((key, text))
            text, key = text[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            yield pa.RecordBatch.from_arrays(
                [own.column("sha256"), pa.array(entities, pa.list_(pa.int64())), _lists(key[new], text[new], len(places))],
                names=["sha256", "entities", "terms"],
            )

    texts = docs.select("text", F.sha2("text", 256).alias("sha256")).filter("text IS NOT NULL")
    found = texts.mapInArrow(run, "sha256 string, entities array<long>, terms array<long>")
    return found.groupBy("sha256").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """In how many different texts each term occurs, counted over all texts."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            text, _, _, key, _ = terms_of(batch.column("text"))
            order = np.lexsort((text, key))
            key, text = key[order], text[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            key = key[new]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
            counts = np.diff(np.append(first, len(key)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[first].astype(np.int64)), pa.array(counts.astype(np.int64))], names=["term", "n"]
            )

    texts = docs.select("text").filter("text IS NOT NULL").distinct()
    return texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def revealing_terms(docs: DataFrame) -> DataFrame:
    """(entity, term, disclosure) over the thresholds."""
    private = saved(private_texts(docs), "pii-private")
    entities = private.select("sha256", F.explode("entities").alias("entity"))
    entities = entities.join(entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")), "entity")
    terms = private.select("sha256", F.explode("terms").alias("term"))
    # The texts of one entity are among those of all: most terms go before they meet an entity.
    able = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_private")).join(term_frequencies(docs), "term")
    able = saved(able.filter(F.col("n_private") >= GENERALISE_FROM * F.col("n_term")).select("term", "n_term"), "pii-able")
    total = docs.agg(F.countDistinct(F.xxhash64("text")).cast("double").alias("n_all"))

    def passes(both):
        both = both.cast("double")
        information = F.log(both * F.col("n_all") / (F.col("n_term") * F.col("n_entity")))
        npmi = F.when(both >= F.col("n_all"), F.lit(1.0)).otherwise(information / -F.log(both / F.col("n_all")))
        return (both / F.col("n_term") >= GENERALISE_FROM) & (npmi >= MIN_NPMI)

    # Both measures grow with the texts that have both, which are no more than those of either.
    return (
        terms.join(able, "term")
        .join(entities, "sha256")
        .join(F.broadcast(saved(total, "pii-total")))  # one row
        .filter(passes(F.least("n_term", "n_entity")))
        .groupBy("entity", "term", "n_entity", "n_term", "n_all")
        .agg(F.count(F.lit(1)).alias("n_both"))
        .filter(passes(F.col("n_both")))
        .select("entity", "term", (F.col("n_both") / F.col("n_term")).alias("disclosure"))
    )


def sketch(terms: DataFrame) -> np.ndarray:
    """Bits by the leading bits of the terms' keys, 32 MB at most: a term without its bit is none of them."""
    width = min(max((16 * terms.count()).bit_length(), 6), _SKETCH_BITS)
    place = F.shiftrightunsigned("term", 64 - width)
    bits = terms.select(place.alias("at")).selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, CAST(at & 63 AS INT)) AS bit")
    bits = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << width - 6, np.int64)
    out[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
    return out.view(np.uint64)


def found_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """By row: its base spans, and where it may have one of ``terms`` outside them."""
    ship_package(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    bits = docs.sparkSession.sparkContext.broadcast(sketch(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        known = bits.value
        drop = np.uint64(64 - (len(known).bit_length() - 1 + 6))
        for batch in blocks(batches, "text"):
            spans = [base_spans(text.as_py() or "") for text in batch.column("text")]
            text, start, end, key, base = terms_of(batch.column("text"))
            place = key >> drop
            hit = np.flatnonzero((known[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
            hit = hit[apart(start[hit], end[hit], base, spans)]
            first = base[text[hit]]
            hits = pa.StructArray.from_arrays(
                [pa.array(key[hit].astype(np.int64)), pa.array(start[hit] - first), pa.array(end[hit] - first)],
                names=["term", "start", "end"],
            )
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            marked = [[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in spans]
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column("doc_id").cast(pa.int64()), batch.column("sha256"), pa.array(marked, span),
                 _lists(hits, text[hit], batch.num_rows)],
                names=["row", "doc_id", "sha256", "spans", "hits"],
            )

    return docs.select("doc_id", "text", F.sha2("text", 256).alias("sha256")).mapInArrow(run, _FOUND)


def disclosures(docs: DataFrame) -> DataFrame:
    """By row of ``docs``: row, doc_id, sha256 of the text, spans (base), terms (start, end, disclosure of revealing ones)."""
    revealing = saved(revealing_terms(docs).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "pii-terms")
    found = saved(found_spans(docs, revealing), "pii-spans")
    terms = (
        found.select("row", F.explode("hits").alias("h"))
        .select("row", "h.term", "h.start", "h.end")
        .join(revealing, "term")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    )
    return found.drop("hits").join(terms, "row", "left")


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def span_digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the base spans' SHA-256 and all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {k: [] for k in KINDS[:4]}
            base, everything = [], []
            for spans, terms in zip(batch.column("spans").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                own = [(s["kind"], s["start"], s["end"]) for s in spans]
                for k, n in counts.items():
                    n.append(sum(s[0] == k for s in own))
                base.append(hashlib.sha256(_joined(own).encode()).hexdigest())
                everything.append(_joined(own + [("term", t["start"], t["end"]) for t in terms or []]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(n, pa.int64()) for n in counts.values()), pa.array(base), pa.array(everything)],
                names=["doc_id", *(f"n_{k}" for k in counts), "base_sha256", "spans"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return found.select("doc_id", "spans", "terms").mapInArrow(run, schema)


def replaced(text: str, spans: list[tuple[str, int, int]], terms: list[tuple[int, int, float]]) -> str:
    """The text with base spans as placeholders and revealing terms generalised by shape or removed.

    Spans of different kinds that overlap become one placeholder, that of the first.
    """
    marks = [(a, b, f"[{k.upper()}]") for k, a, b in spans]
    for a, b, disclosure in terms:
        word = text[a:b]
        shape = "[CODE]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[WORD]"
        marks.append((a, b, "" if disclosure >= REMOVE_FROM else shape))
    out, at = [], 0
    for a, b, mark in sorted(marks, key=lambda m: (m[0], -m[1])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with its texts sanitised; a null text stays null."""
    found = disclosures(docs)
    names = docs.columns
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            texts = []
            for text, known in zip(batch.column("text").to_pylist(), batch.column("__terms").to_pylist(), strict=True):
                if text is not None:
                    own = base_spans(text)
                    terms = [(t["start"], t["end"], t["disclosure"]) for t in known or []]
                    if own or terms:
                        text = replaced(text, own, terms)
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # Spans depend on the text alone, so rows with repeated or null ids find theirs by it.
    known = found.filter("terms IS NOT NULL").groupBy(F.col("sha256").alias("__sha256")).agg(F.first("terms").alias("__terms"))
    joined = docs.withColumn("__sha256", F.sha2("text", 256)).join(known, "__sha256", "left").drop("__sha256")
    return joined.mapInArrow(run, docs.schema)


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return span_digests(disclosures(spark.read.parquet(f"{folder}/documents.parquet")))


QUERIES = {"op7_pii": op7_pii}
ORACLE_SQL: dict[str, str] = {}
