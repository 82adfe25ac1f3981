"""Nulls, empty and repeated rows, empty tables and clashing columns, and brute-force answers."""

import re
import zlib

import numpy as np
import pytest

from topicpulse.llm import dedup_minhash, dedup_substring, extraction, fm_index, neighbours, packing, pii, quality, toxicity, warc
from topicpulse.session import new_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(120))
ROWS = [
    (1, LONG, "a"), (2, "x " + LONG + " y", "a"), (3, None, None), (4, "", "b"), (None, LONG, "a"),
    (5, "same words here now ok", "b"), (5, "same words here now ok", "b"), (6, "same words here now ok", "c"),
    (7, "one\ttwo\n\n one", "c"), (8, "é " * 30000, "d"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns named like those the operators make."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("bands", "covered", "text_hash", "spans", "label", "ids"):
        rows = rows.withColumn(name, F.lit(7))
    return rows


def test_substring_dedup(docs):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in dedup_substring.dedup_digests(docs).collect())
    assert ("2", 122, 120) in got and ("1", 120, 0) in got and ("None", 120, 0) in got
    assert len(got) == len(ROWS) and dedup_substring.dedup_digests(docs.limit(0)).count() == 0
    kept = {r.doc_id: r.text for r in dedup_substring.without_copies(docs).collect()}
    assert kept[2] == "x y" and kept[3] is None and kept[7] == ROWS[8][1]


def test_fm_index_against_all_windows():
    random = np.random.default_rng(1)
    for _ in range(30):
        base = random.integers(0, 4, 120)
        cuts = random.integers(0, 90, 12)
        parts = [base[a : a + random.integers(3, 25)] for a in cuts]
        owners = random.integers(0, 6, 12)
        lengths = np.array([len(p) for p in parts])
        words = np.concatenate(parts).astype(np.uint64)
        got = fm_index.FMIndex(words, lengths, owners).covered_windows(words, lengths, owners, 6)
        least = {}
        for p, o in zip(parts, owners, strict=True):
            for k in range(len(p) - 5):
                least[tuple(p[k : k + 6])] = min(o, least.get(tuple(p[k : k + 6]), 99))
        want = [sum(1 << k for k in range(len(p) - 5) if least[tuple(p[k : k + 6])] < o) for p, o in zip(parts, owners, strict=True)]
        assert got.tolist() == want


def test_packing(docs):
    rows = packing.pack(docs, {"a": 3.0, "b": 1.0}, window=64, quantum=8).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    by_window = {}
    for r in rows:
        by_window.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_window.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(docs.limit(0)).count() == 0


def test_fast_ids_are_those_of_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["", " a\n\n b", "x<|endoftext|>y", "naïve 日本 🙂", "a" * 5000, " " * 3000, "don't 123"]:
        assert packing.encoder()(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_warc(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "u", ""), (None, "n", "z"),
             (5, "v", "é" * 40_000), (5, "v", "é" * 40_000)]
    folder = new_folder(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), folder, segment_bytes=1000)
    rows = warc.capture_digests(warc.read_archives(spark, folder)).collect()
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in rows)
    assert got == [
        ("1", 8, "revisit", 2), ("2", 8, "response", None), ("3", 0, "revisit", 4), ("4", 0, "response", None),
        ("5", 80_000, "response", None), ("5", 80_000, "response", None), ("None", 1, "response", None),
    ]
    assert all(r.problem is None for r in rows)
    assert warc.unchunked(warc.chunked(b"abc" * 9999, 10)) == b"abc" * 9999


def test_neighbours_against_brute_force(spark):
    random = np.random.default_rng(2)
    vectors = random.normal(size=(600, 8)).astype(np.float32)
    vectors[100:140] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(700, None), (720, [0.0] * 8), (740, [float("nan")] * 8), (760, [None] * 8), (780, [1.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(table, shard_rows=200).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    exact = vectors.astype(float)
    hits = 0
    for q in range(0, 600, 20):
        scores = exact @ exact[q]
        want = [i for i in np.lexsort((np.arange(600), -scores.round(9))) if i != q][:20]
        hits += len(set(want) & set(got[q].values()))
    assert sorted(got) == list(range(0, 600, 20)) and hits >= 0.9 * 20 * len(got)
    assert neighbours.search(table.limit(0)).count() == 0


def test_near_duplicates(docs):
    got = {r.doc_id: r.class_id for r in dedup_minhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, None: None, 5: 5, 6: 5, 7: 7, 8: 8}
    assert sorted(str(r.doc_id) for r in dedup_minhash.without_near_duplicates(docs).collect()) == sorted("1 3 4 5 5 7 8 None".split())
    assert dedup_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_the_similarity():
    keys = np.arange(1, 401, dtype=np.uint64)
    a, b = (keys[:300], np.ones(300)), (keys[60:360], np.ones(300))
    text = np.repeat([0, 1], 300)
    s = dedup_minhash.signatures(text, np.concatenate([a[0], b[0]]), np.ones(600), 2, 2000)
    assert abs((s[0] == s[1]).mean() - dedup_minhash.similarity(a, b)) < 0.05
    assert dedup_minhash.similarity(a, b) == pytest.approx(240 / 360)


def test_personal_data(spark):
    text = "Mail bob@x.org now, 10.0.0.300 or 10.0.0.1; 4111 1111 1111 1111; +49 (30) 1234567 end"
    assert [k for k, _, _ in pii.base_spans(text)] == ["email", "ip", "card", "phone"]
    rows = [(i, f"{w} Zorbax wrote to bob@x.org about {w}", "s") for i, w in enumerate("alpha beta gamma delta".split())]
    rows += [(9, None, "s"), (10, "", "s"), (10, "", "s"), (None, text, "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    digests = {r.doc_id: r for r in pii.span_digests(pii.disclosures(docs)).collect()}
    assert digests[0].spans == "email:22:31,term:6:12,term:13:18,term:32:37"
    assert (digests[9].spans, digests[None].n_phone) == ("", 1)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "bob" not in clean[0] and "Zorbax" not in clean[0] and clean[9] is None


def test_toxicity_held_out(spark):
    random = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(60)]
    texts = [" ".join([*random.choice(plain, 30), *(["idiot", "scum"] if i % 3 == 0 else [])]) for i in range(600)]
    docs = spark.createDataFrame([*[(i, t, "s") for i, t in enumerate(texts)], (9000, None, "s"), (9001, "", "s")], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.rejected for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert np.mean([got[i] == (i % 3 == 0) for i in range(400, 600)]) > 0.98
    assert not got[9000] and not got[9001]
    assert toxicity.fit(docs, labels.limit(0)) is None


def test_extraction():
    page = (
        "<html><body><nav>menu</nav><div class='ad-7'>buy</div><article class=post><header><h1>T &amp; U</h1></header>"
        "<p>One<br>two <b>th</b>ree<p>Four<script>var x='</p>'</script></article><footer>f</footer>"
    )
    assert extraction.cut(extraction.page_blocks(page), []) == "T & U One two three Four"
    for odd in ("", "<", "<p", "a<b", "<!-- x", "<script>", "<p class='x", "</p></p>", "plain"):
        extraction.cut(extraction.page_blocks(odd), ["body"])


def test_extraction_of_odd_rows(spark):
    rows = [(1, None, None), (2, "http://h/x", "<body><p>a</body>"), (None, "::", ""), (2, "http://h/x", "<body><p>a</body>")]
    got = [(r.page_id, r.text) for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (2, "a"), (2, "a"), (None, "")], key=str)


def test_quality(docs, spark):
    got = {r.doc_id: r for r in quality.quality_rules(docs, None).collect()}
    assert got[3].base_failed and not got[3].kept and got[1].kept and got[8].n_repeat_words == 30000
    random = np.random.default_rng(4)
    x = random.random((800, 3))
    trees = quality.grow(x, (x[:, 0] + 0.1 * random.random(800) > 0.5).astype(float), [1, -1, 0])
    line = np.column_stack([np.linspace(0, 1, 50), np.full(50, 0.5), np.full(50, 0.5)])
    assert (np.diff(trees.score(line)) >= -1e-12).all() and trees.score(line)[-1] > 0.9
