"""Near-duplicates by ProbMinHash over weighted word shingles, banding and verification.

The signature of a text comes from Poisson processes: each shingle's points arrive with a
rate equal to its count, every point falls on one of the signature's components, and a
component keeps the shingle of its first point. A shingle stops as soon as its next point
comes too late for every component, so most yield one point. Two signatures agree in a
component with the probability Jaccard similarity of the texts.

Texts of equal words collapse to their smallest id. Texts that share a band are candidates.
In each band's bucket all are verified against one of them, its centre; components of what
was confirmed follow, and buckets that still hold several components have the members
outside the largest one verified against the members of other components, save pairs that
shingles which no other open text has put out of reach. So no candidate link between different components is lost, and a group of g copies costs about g tests.

Before any text moves, a pair must pass an exact bound on what its sizes allow, and the
agreement of its signatures, kept as a byte a component, must not lie ``SIGMAS`` standard
deviations below that of the least similar pair wanted. Verification computes the similarity
itself from whole texts, streamed past their centre in sorted partitions; crowded centres are
split by salt.

Defined cases: a text with one to four words is one shingle; a null text or one without
words is in a class of its own; rows without id have no class and take no part; rows that
repeat an id are one document, similar where any of its texts is; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicpulse.llm.words import Words, blocks, grams, mix
from topicpulse.operators.components import connected_components
from topicpulse.session import saved, ship_package

SHINGLE = 5
SIMILAR_FROM = 0.8
BANDS, BAND_ROWS = 40, 6
SIGMAS = 5.0
MEMBERS_A_TASK = 2000
BROADCAST_ROWS = 1 << 22  # rows of a few numbers that are sent to every executor at most
_TOGETHER = 1 << 19  # words whose signatures are found together
_SALT = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle of a block, ordered by text; repeated ones repeat."""
    at = np.flatnonzero(w.left() >= size)
    text, key = w.text[at], grams(w.hash, size)[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        whole = fingerprints(w)[0][short]
        text, key = np.concatenate([text, short]), np.concatenate([key, whole])
        order = np.argsort(text, kind="stable")
        text, key = text[order], key[order]
    return text, key


def fingerprints(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each text's word sequence."""
    place = (np.arange(len(w)) - w.first[w.text]).astype(np.uint64)
    out = []
    for salt in _SALT[:2]:
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(w.hash ^ mix(place * salt + salt)))])
        out.append(mix(sums[w.first[1:]] - sums[w.first[:-1]] + w.counts.astype(np.uint64) * salt))
    return out[0], out[1]


def counted(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (text, key) pairs, in that order, and how often each comes."""
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], key[first], np.diff(np.append(first, len(key)))


def signatures(text: np.ndarray, key: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """ProbMinHash signatures of texts given their different shingles with weights."""
    first = np.full(texts * size, np.inf)
    owner = np.zeros(texts * size, np.uint64)
    arrival, live = np.zeros(len(key)), np.arange(len(key))
    turn = 0
    while len(live):
        turn += 1
        drawn = mix(key[live] + np.uint64(turn * int(_SALT[0]) % (1 << 64)))
        uniform = ((drawn >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        arrival[live] -= np.log(uniform) / weight[live]
        at = text[live] * size + (mix(drawn ^ _SALT[1]) % np.uint64(size)).astype(np.int64)
        np.minimum.at(first, at, arrival[live])
        won = first[at] == arrival[live]
        owner[at[won]] = key[live[won]]
        latest = first.reshape(texts, size).max(axis=1)
        live = live[arrival[live] < latest[text[live]]]
    return owner.reshape(texts, size)


def similarities(pair: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray, pairs: int) -> np.ndarray:
    """Probability Jaccard similarity of each pair of weighted sets.

    The entries of all pairs together: pair number, key, weight in either set.
    """
    if not len(pair):
        return np.zeros(pairs)
    order = np.lexsort((key, pair))
    pair, key = pair[order], key[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])))
    pair, a, b = pair[first], np.add.reduceat(a[order], first), np.add.reduceat(b[order], first)
    ratio = np.divide(b, a, out=np.full(len(a), np.inf), where=a > 0)
    order = np.lexsort((ratio, pair))
    pair, ratio, a, b = pair[order], ratio[order], a[order], b[order]
    # The last entry of the same ratio, and sums up to it within the pair; weights are whole numbers.
    ends = np.flatnonzero(np.append((ratio[1:] != ratio[:-1]) | (pair[1:] != pair[:-1]), True))
    last = ends[np.searchsorted(ends, np.arange(len(pair)))]
    sum_a, sum_b = np.concatenate([[0.0], np.cumsum(a)]), np.concatenate([[0.0], np.cumsum(b)])
    begin = np.searchsorted(pair, np.arange(pairs + 1))
    both = np.flatnonzero((a > 0) & (b > 0))
    p, last = pair[both], last[both] + 1
    weight = (sum_a[last] - sum_a[begin[p]]) / a[both] + (sum_b[begin[p + 1]] - sum_b[last]) / b[both]
    return np.bincount(p, 1 / weight, pairs)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets (keys, weights)."""
    key = np.concatenate([a[0], b[0]])
    wa = np.concatenate([a[1], np.zeros(len(b[0]))]).astype(float)
    wb = np.concatenate([np.zeros(len(a[0])), b[1]]).astype(float)
    return float(similarities(np.zeros(len(key), np.int64), key, wa, wb, 1)[0])


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One key for each band of each signature."""
    out = []
    for band in range(bands):
        h = mix(np.full(len(signature), band + 1, np.uint64) * _SALT[2])
        for k in range(band * rows, (band + 1) * rows):
            h = mix(h * _SALT[0] + signature[:, k])
        out.append(h)
    return np.stack(out, axis=1)


_SKETCH = "doc_id long, same_a long, same_b long, n_words long, total long, different long, bands array<long>, sign binary"


def sketches(docs: DataFrame) -> DataFrame:
    """By document: two hashes of its words, their number, the keys of its bands, its signature in bytes."""
    ship_package(docs.sparkSession)

    def finish(held: list[tuple], texts: int) -> pa.RecordBatch:
        ids, same_a, same_b, n_words = (np.concatenate([h[k] for h in held]) for k in range(1, 5))
        base = np.cumsum([0] + [len(h[1]) for h in held])
        text = np.concatenate([h[5][0] + b for h, b in zip(held, base, strict=False)])
        key, weight = (np.concatenate([h[5][k] for h in held]) for k in (1, 2))
        found = signatures(text, key, weight, texts, BANDS * BAND_ROWS)
        keys = band_keys(found).astype(np.int64)
        sign = pa.array([r.tobytes() for r in (mix(found) >> np.uint64(56)).astype(np.uint8)], pa.binary())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
        total = np.bincount(text, weight, texts).astype(np.int64)
        different = np.bincount(text, minlength=texts)
        columns = [pa.array(c) for c in (ids, same_a, same_b, n_words, total, different)]
        names = ["doc_id", "same_a", "same_b", "n_words", "total", "different", "bands", "sign"]
        return pa.RecordBatch.from_arrays([*columns, lists, sign], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, texts = [], 0, 0
        for batch in blocks(batches, "text"):
            w = Words(batch.column("text"))
            a, b = (h.astype(np.int64) for h in fingerprints(w))
            ids = batch.column("doc_id").to_numpy()
            held.append((len(w), ids, a, b, w.counts.astype(np.int64), counted(*shingles(w))))
            words, texts = words + len(w), texts + batch.num_rows
            if words >= _TOGETHER or texts >= 20_000:
                yield finish(held, texts)
                held, words, texts = [], 0, 0
        if held:
            yield finish(held, texts)

    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SKETCH)


def least_agreement(similar_from: float) -> int:
    """Components in which signatures of a pair at ``similar_from`` agree, less ``SIGMAS`` deviations."""
    n = BANDS * BAND_ROWS
    return int(max(n * similar_from - SIGMAS * np.sqrt(n * similar_from * (1 - similar_from)), 0))


def shingle_owners(open_texts: DataFrame, docs: DataFrame) -> DataFrame:
    """holders: for each shingle that at most three of ``open_texts`` have, who has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            text, key, _ = counted(*shingles(Words(batch.column("text"))))
            columns = [batch.column("doc_id").take(pa.array(text)), pa.array(key.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "shingle"])

    reps = open_texts.select(F.col("rep").alias("doc_id"))
    rows = docs.select("doc_id", "text").join(sent(reps), "doc_id", "left_semi").mapInArrow(run, "rep long, shingle long")
    least, most, n = F.min("rep"), F.max("rep"), F.count(F.lit(1))
    third = F.bit_xor("rep").bitwiseXOR(least).bitwiseXOR(most)
    # Rows may repeat an id; then a shingle may count as one of more texts, which only weakens the bound.
    holders = F.when(least == most, F.array(least)).when(n == 2, F.array(least, most)).when(n == 3, F.array(least, third, most))
    owners = rows.groupBy("shingle").agg(F.array_distinct(holders).alias("holders")).filter("holders IS NOT NULL")
    return saved(owners.select("holders"), "shingle-owners")


def within_reach(similar_from: float, alone: str | None = None) -> F.Column:
    """Whether what two texts can share allows the similarity; exact bounds.

    Of d and e different shingles with r repeats in both together, the similarity is at most
    (c + r) / (d + e - c + r) with c the most shingles they can share. With shares u and v of
    the whole weights that only one of them can have it is at most (1 - u)(1 - v) / (1 - uv).
    ``alone`` names the column that counts such shingles.
    """
    d, e = F.col("different"), F.col("different_y")
    own, own_y = (F.col(alone), F.col(f"{alone}_y")) if alone else (F.lit(0), F.lit(0))
    c, r = F.least(d - own, e - own_y), F.col("total") + F.col("total_y") - d - e
    plain = c + r >= similar_from * (d + e - c + r) - 1e-6
    u, v = own / F.col("total"), own_y / F.col("total_y")
    return plain & ((1 - u) * (1 - v) >= similar_from * (1 - u * v) - 1e-9) if alone else plain


def sent(table: DataFrame) -> DataFrame:
    """A written table of few columns, marked to be broadcast if it has at most ``BROADCAST_ROWS`` rows.

    So the texts and signatures it picks need not be shuffled; a larger one is joined by shuffle.
    """
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def agreeing(rows: DataFrame, similar_from: float) -> DataFrame:
    """The (centre, member) of ``rows`` whose signatures, ``sign`` and ``sign_y``, allow the similarity."""
    least = least_agreement(similar_from)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8) for c in ("sign", "sign_y"))
                agree = (a == b).reshape(batch.num_rows, -1).sum(axis=1)
                yield batch.select(["centre", "member"]).filter(pa.array(agree >= least))

    return rows.select("centre", "member", "sign", "sign_y").mapInArrow(run, "centre long, member long")


def plausible(pairs: DataFrame, kept: DataFrame, similar_from: float) -> DataFrame:
    """The (centre, member) whose sizes and signatures allow the similarity."""
    small = sent(pairs)
    own = kept.select(F.col("rep").alias("member"), "total", "different", "sign").join(small, "member")
    other = kept.select(F.col("rep").alias("centre"), *(F.col(c).alias(f"{c}_y") for c in ("total", "different", "sign"))).join(small, "centre")
    return agreeing(own.join(other, ["centre", "member"]).filter(within_reach(similar_from)), similar_from)


def compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` (centre, member) with the similarity of their whole texts."""
    ship_package(docs.sparkSession)
    crowd = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_A_TASK).cast("int").alias("parts"))
    as_member = pairs.join(crowd, "centre").select(
        F.col("member").alias("doc_id"), "centre", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"),
        F.lit(1).alias("is_member"),
    )
    as_centre = crowd.select(
        F.col("centre").alias("doc_id"), "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("is_member"),
    )
    wanted = saved(as_member.unionByName(as_centre), "texts-to-compare")
    rows = docs.select("doc_id", "text").join(sent(wanted), "doc_id")
    rows = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "is_member", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, []
        for batch in blocks(batches, "text"):
            w = Words(batch.column("text"))
            text, key, weight = counted(*shingles(w))
            weight = weight.astype(float)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            centres, members, ids = (batch.column(c).to_pylist() for c in ("centre", "is_member", "doc_id"))
            found, parts, waiting = [], [], 0

            def measure() -> None:
                """The similarities of the pairs laid out in ``parts``."""
                nonlocal parts, waiting
                if parts:
                    pair = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
                    got = similarities(pair, *(np.concatenate([p[k] for p in parts]) for k in (1, 2, 3)), len(parts))
                    found.extend((*p[0], s) for p, s in zip(parts, got, strict=True))
                parts, waiting = [], 0

            for r in range(batch.num_rows):
                own = key[cut[r] : cut[r + 1]], weight[cut[r] : cut[r + 1]]
                if not members[r]:
                    # A repeated id may have several texts.
                    held = [*held, own] if centres[r] == centre else [own]
                    centre = centres[r]
                elif centres[r] == centre:
                    for its in held:
                        none, less = np.zeros(len(its[0])), np.zeros(len(own[0]))
                        laid = [np.concatenate(c) for c in ((its[0], own[0]), (its[1], less), (none, own[1]))]
                        parts.append(((centre, ids[r]), *laid))
                        waiting += len(laid[0])
                    if waiting > _TOGETHER:
                        measure()
            measure()
            columns = [pa.array([o[k] for o in found], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["centre", "member", "similarity"])

    return rows.select("doc_id", "text", "centre", "part", "is_member").mapInArrow(run, "centre long, member long, similarity double")


def near_duplicates(docs: DataFrame, similar_from: float = SIMILAR_FROM) -> DataFrame:
    """doc_id, class_id (smallest id of its class) and class_size of every row of ``docs``.

    A class is a component of the graph whose links are candidate pairs of ``similar_from``
    or more; texts of equal words always share one. n_links counts the verified links of the
    row's text to other texts, linked_to and similarity are the strongest one (ties: the smaller id).
    """
    sketch = saved(sketches(docs), "sketches")
    same = sketch.filter("n_words > 0").groupBy("same_a", "same_b")
    kept = same.agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("total", "different", "bands", "sign")))
    kept = saved(kept, "texts")
    rows = kept.select("rep", F.explode("bands").alias("bucket"))
    # Written, so that the join knows its size.
    sizes = saved(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket-sizes")
    crowded = saved(rows.join(sent(sizes), "bucket"), "shared-buckets")
    # The member that meets the others most often is the centre: a text next to its many copies.
    meets = crowded.groupBy("rep").agg(F.sum("n").alias("meets"))
    centre = F.max(F.struct("meets", (-F.col("rep")).alias("minus")))["minus"]
    centres = crowded.join(meets, "rep").groupBy("bucket").agg((-centre).alias("centre"))
    crowded = saved(crowded.select("bucket", "rep").join(centres, "bucket"), "centred-buckets")
    stars = saved(crowded.filter("rep <> centre").select("centre", F.col("rep").alias("member")).distinct(), "stars")
    measured = compared(saved(plausible(stars, kept, similar_from), "plausible-stars"), docs)
    links = saved(measured.filter(F.col("similarity") >= similar_from), "star-links")
    roots = connected_components(links, "centre", "member")
    label = F.coalesce("root", "rep").alias("label")
    labelled = crowded.join(roots, F.col("rep") == F.col("id"), "left").select("bucket", "rep", label)
    sizes = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels"))
    split = labelled.join(largest.filter("labels > 1").drop("labels"), "bucket")
    split = split.withColumn("is_main", F.col("label") == F.col("main")).drop("main")
    split = saved(split, "split-buckets")
    opened = saved(split.select("rep", "label").distinct(), "open-labels")
    owners = shingle_owners(opened, docs)
    held = owners.select(F.explode("holders").alias("rep"), (F.size("holders") == 1).cast("long").alias("private"))
    held = held.groupBy("rep").agg(F.sum("private").alias("private"), F.count(F.lit(1)).alias("rare"))
    weights = kept.select("rep", "total", "different", "bands", "sign").join(sent(opened), "rep")
    weights = weights.join(held, "rep", "left").fillna(0, ["private", "rare"])
    # No similarity exceeds the share of a text's weight that others can have.
    weights = saved(weights.filter(F.col("private") <= (1 - similar_from) * F.col("total")), "open-texts")
    second = weights.select(*(F.col(c).alias(f"{c}_y") for c in weights.columns if c != "bands"))
    # The two or three texts that alone have a shingle are pairs of their own; in all other pairs such shingles count as private.
    few = owners.filter(F.size("holders") > 1).select(F.explode("holders").alias("rep"), "holders").distinct()
    few = few.select("rep", F.explode("holders").alias("rep_y")).filter("rep < rep_y").distinct()
    few = few.join(weights.drop("bands"), "rep").join(second, "rep_y").filter(F.expr("label <> label_y") & within_reach(similar_from, "private"))
    split = split.drop("label").join(weights, "rep")
    other = split.select(*(F.col(c).alias(c if c == "bucket" else f"{c}_y") for c in split.columns))
    apart = F.expr("label <> label_y AND (rep < rep_y OR is_main_y)")
    # Every bucket that two open texts share is split, so the first one alone gives their pair.
    first_shared = F.array_intersect("bands", "bands_y")[0] == F.col("bucket")
    met = split.filter("NOT is_main").join(other, "bucket").filter(apart & within_reach(similar_from, "rare") & first_shared)
    both = ["rep", "rep_y", "sign", "sign_y"]
    met = met.select(*both).unionByName(few.select(*both))
    # Signatures are tested where a pair is met, so that only what they allow is written.
    ends = F.least("rep", "rep_y").alias("centre"), F.greatest("rep", "rep_y").alias("member")
    met = agreeing(met.select(*ends, "sign", "sign_y"), similar_from).distinct()
    tested = stars.select(F.least("centre", "member").alias("centre"), F.greatest("centre", "member").alias("member"))
    met = saved(met.join(tested, ["centre", "member"], "left_anti"), "plausible-pairs")
    more = compared(met, docs)
    more = saved(more.filter(F.col("similarity") >= similar_from), "open-links")
    # The stars found so far stand for all earlier links.
    known = roots.select(F.col("root").alias("centre"), F.col("id").alias("member"))
    of_text = connected_components(known.unionByName(more.select("centre", "member")), "centre", "member")
    of_text = kept.select("rep", "same_a", "same_b").join(of_text, F.col("rep") == F.col("id"), "left")
    every = links.unionByName(more)
    every = every.unionByName(every.select(F.col("member").alias("centre"), F.col("centre").alias("member"), "similarity"))
    every = every.groupBy(F.col("centre").alias("rep"), "member").agg(F.max("similarity").alias("similarity")).groupBy("rep").agg(
        F.count(F.lit(1)).alias("n_links"), F.max(F.struct("similarity", (-F.col("member")).alias("minus"))).alias("best")
    )
    described = [F.coalesce("n_links", F.lit(0)).alias("n_links"), (-F.col("best.minus")).alias("linked_to"), F.col("best.similarity").alias("similarity")]
    of_text = of_text.join(every, "rep", "left").select("same_a", "same_b", F.coalesce("root", "rep").alias("class_id"), *described)
    found = sketch.join(of_text, ["same_a", "same_b"], "left").select(
        "doc_id",
        F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), "linked_to", "similarity",
    )
    found = saved(found, "classes")
    # Written, so that the join has no aggregate beside it and a crowded class can be split.
    count = saved(found.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")), "class-sizes")
    columns = ["doc_id", "class_id", "class_size", "n_links", "linked_to", "similarity"]
    unknown = docs.filter("doc_id IS NULL").select(F.col("doc_id").cast("long"))
    return found.join(count, "class_id").select(*columns).unionByName(unknown, allowMissingColumns=True)


def without_near_duplicates(docs: DataFrame, similar_from: float = SIMILAR_FROM) -> DataFrame:
    """The rows of ``docs`` whose id is their class's smallest, as they are, and rows without id."""
    found = near_duplicates(docs, similar_from).filter("doc_id <> class_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("__id"), "left_anti")


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {"op6_minhash": op6_minhash}
ORACLE_SQL: dict[str, str] = {}
