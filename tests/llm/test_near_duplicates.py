"""Near-duplicate classes against all pairs."""

import re
from collections import Counter

import numpy as np

from topicpulse.llm import dedup_minhash as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    words = WORD.findall(text or "")
    if 0 < len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def likeness(a, b):
    if len(a) + len(b) > 400:  # the quick form, which a test below compares with this one
        place = {k: i for i, k in enumerate(a.keys() | b.keys())}
        lay = lambda c: (np.array([place[k] for k in c], np.uint64), np.array(list(c.values()), float))
        return D.similarity(lay(a), lay(b))
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys())
    return total


def out_of_reach(a, b, similar_from):
    common, repeats = len(a.keys() & b.keys()), sum(a.values()) + sum(b.values()) - len(a) - len(b)
    return common + repeats < similar_from * (len(a) + len(b) - common + repeats) - 1e-6


def classes(bags, similar_from=0.8):
    """Smallest member of each component over all pairs that share a shingle."""
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, b in bags.items():
        for k in b:
            by.setdefault(k, []).append(i)
    pairs = {(i, j) for ids in by.values() for i in ids for j in ids if i < j}
    links = set()
    for i, j in pairs:
        a, b = bags[i], bags[j]
        if a == b or (not out_of_reach(a, b, similar_from) and likeness(a, b) >= similar_from - 1e-9):
            links.add((i, j))
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in bags}, links


def check(got, bags):
    want, links = classes(bags)
    assert {r.doc_id: r.class_id for r in got} == want
    for r in got:
        assert (r.n_links > 0) == (r.linked_to is not None)
        if r.linked_to is not None:
            assert abs(likeness(bags[r.doc_id], bags[r.linked_to]) - r.similarity) < 1e-9 and r.similarity >= 0.8


def test_all_pairs_of_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(D.near_duplicates(docs).collect(), {r.doc_id: bag(r.text) for r in docs.collect()})


def test_all_pairs_of_one_crowded_template(spark):
    """Texts between 0.5 and 1 alike around one another, in chains and beside them."""
    random = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        words, changes = list(base), random.integers(0, 9)
        for at in random.integers(0, 120, changes):
            words[at] = f"x{random.integers(0, 50)}"
        texts.append(" ".join(words + (["again and again and again and"] * random.integers(0, 3))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(D.near_duplicates(docs).collect(), {i: bag(t) for i, t in enumerate(texts)})


def test_similarities_of_many_pairs_at_once():
    random = np.random.default_rng(2)
    sets = [(random.choice(40, 12, replace=False).astype(np.uint64), random.integers(1, 5, 12).astype(float)) for _ in range(20)]
    parts = []
    for p in range(10):
        a, b = sets[2 * p], sets[2 * p + 1]
        parts.append((np.full(24, p), np.concatenate([a[0], b[0]]), np.concatenate([a[1], np.zeros(12)]), np.concatenate([np.zeros(12), b[1]])))
    got = D.similarities(*(np.concatenate(c) for c in zip(*parts, strict=True)), 11)
    for p in range(10):
        a, b = (Counter(dict(zip(k.tolist(), w.tolist(), strict=True))) for k, w in sets[2 * p : 2 * p + 2])
        assert abs(got[p] - likeness(a, b)) < 1e-12
    assert got[10] == 0 and D.similarity((np.zeros(0), np.zeros(0)), (np.zeros(0), np.zeros(0))) == 0


def test_repeated_ids_of_different_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(1, one), (1, two), (2, two + " end"), (3, one + " end"), (4, "else")], "doc_id long, text string")
    got = {(r.doc_id, r.class_id) for r in D.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}
