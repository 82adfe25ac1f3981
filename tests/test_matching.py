"""Matching against brute force, with repeated and skewed titles."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topicpulse.operators import matching as M


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(new[-1], row[j]))
        row = new
    return row[-1]


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def titles(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd e职场沟通") for _ in range(rng.randint(0, 14))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            if t and rng.random() < 0.5:
                t.pop(rng.randrange(len(t)))
            else:
                t.insert(rng.randint(0, len(t)), rng.choice("abxyz作"))
        out.append("".join(t))
    # A third of the rows share one title.
    return out + ["hot title"] * (n // 2)


def frame(spark, values, key):
    return spark.createDataFrame(list(enumerate(values)), f"{key} bigint, title string")


@pytest.mark.parametrize("threshold", [0.8, 0.7])
def test_similar_titles_loses_nothing(spark, threshold):
    left, right = titles(1, 60), titles(2, 80)
    got = {(r.a, r.b) for r in M.similar_titles(frame(spark, left, "id"), frame(spark, right, "id"), threshold).collect()}
    want = {(a, b) for a in set(left) for b in set(right) if (a or b) and ratio(a, b) >= threshold - 1e-9}
    assert got == want


def test_fuzzy_best_match(spark):
    new, library = titles(3, 60), titles(4, 80)
    got = {r.query_id: (r.existing_id, round(r.ratio, 9)) for r in M.fuzzy_best_match(frame(spark, new, "query_id"), frame(spark, library, "id")).collect()}
    want = {}
    for q, a in enumerate(new):
        best = max(((ratio(a, b), -i) for i, b in enumerate(library)))
        if best[0] >= 0.8 - 1e-9:
            want[q] = (-best[1], round(best[0], 9))
    assert got == want


@pytest.mark.parametrize("heads", [None, 1, 3])
def test_tfidf_candidates(spark, heads):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    make = lambda n: [" ".join(rng.choice(["the", "of", *words]) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    library, new = make(60) + ["the of"] * 40, make(15) + ["the", "of the"]
    got = {}
    for r in M.tfidf_candidates(frame(spark, new, "query_id"), frame(spark, library, "id"), top=5, heads=heads).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.candidate_id))
    bags = [Counter(re.findall(r"\w\w+", t)) for t in library]
    asked = [Counter(re.findall(r"\w\w+", t)) for t in new]
    n = len(library) + len(new)
    df = Counter(t for bag in bags + asked for t in bag)
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}

    def vector(bag):
        v = {t: c * idf[t] for t, c in bag.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    held = [vector(b) for b in bags]
    for q, bag in enumerate(asked):
        v = vector(bag)
        scored = [(round(sum(x * d.get(t, 0) for t, x in v.items()), 9), i) for i, d in enumerate(held)]
        want = [i for s, i in sorted(scored, reverse=True) if s > 0][:5]
        assert [i for _, i in sorted(got[q])] == want


def test_clusters_follow_chains_and_are_stable(spark):
    chain = ["aaaaaaaaaa" + "b" * i for i in range(0, 12)]
    rows = frame(spark, chain + ["zzzz", "zzzz", "other thing"], "id")
    got = {r.id: r.leader for r in M.duplicate_clusters(rows).collect()}
    assert {got[i] for i in range(12)} == {0}
    assert (got[12], got[13], got[14]) == (12, 12, 14)


def groups_of(texts: list[str]) -> dict[int, int]:
    """Lowest index of each text's group, by all pairs."""
    leader = list(range(len(texts)))

    def root(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            if (a or texts[j] or a == texts[j]) and ratio(a, texts[j]) >= 0.8 - 1e-9:
                x, y = root(i), root(j)
                leader[max(x, y)] = min(x, y)
    return {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("seed", [7, 8])
def test_clusters_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    numbered = [f"weekly report number {rng.randrange(10**4)}" for _ in range(25)] + [f"meeting notes {n} of the week" for n in range(12)]
    texts = titles(seed, 50) + numbered + ["weekly notes number 3 of the week"]
    rng.shuffle(texts)
    got = {r.id: r.leader for r in M.duplicate_clusters(frame(spark, texts, "id")).collect()}
    assert got == groups_of(texts)


def test_one_template_gives_few_links(spark):
    n = 1500
    texts = [f"how to plan the week {i:05d}" for i in range(n)] + ["something else"]
    known = frame(spark, texts, "id")
    signed = M._signed(known, 0.8).cache()
    links = M.star_links(signed, 0.8).cache()
    assert links.count() <= 2 * n
    stars = M.connected_components(known, links).withColumnRenamed("leader", "star").cache()
    assert {r.id: r.star for r in stars.collect()} == {**{i: 0 for i in range(n)}, n: n}
    assert M.links_across(signed, stars, 0.8).count() == 0


def test_stars_meet_across_a_mixed_signature(spark):
    """Two crowds and a lone title under one signature; only the bridge is similar to both."""
    left, right = [f"aaaaaaaaaa{c}" for c in "bcd"], [f"aaaaaaaaaaxyzw{c}" for c in "pqr"]
    texts = [*left, *right, "aaaaaaaaaaxy"]
    stars = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3), (6, 6)], "id bigint, star bigint")
    signed = M._signed(frame(spark, texts, "id"), 0.8)
    got = {(r.a, r.b) for r in M.links_across(signed, stars, 0.8).collect()}
    star = {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}
    want = {(star[i], star[j]) for i, a in enumerate(texts) for j, b in enumerate(texts) if star[i] < star[j] and ratio(a, b) >= 0.8 - 1e-9}
    assert got == want


def test_components_on_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)]
    nodes = spark.createDataFrame([(i,) for i in [*range(61), *range(100, 160), 500]], "id bigint")
    got = {r.id: r.leader for r in M.connected_components(nodes, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 160)) and got[500] == 500


def test_merge_is_counted_once_per_duplicate(spark):
    schema = "id bigint, description string, tags string, frequency bigint, last_seen timestamp_ntz"
    library = spark.createDataFrame([(1, "ab", '["x"]', 2, None), (2, None, None, 1, None)], schema)
    more = spark.createDataFrame(
        [(1, "abc", '["y","x"]', 1), (1, "xyz", "broken", 2), (1, "a", None, 3)], "existing_id bigint, description string, tags string, ord bigint"
    )
    got = {r.id: r for r in M.merge_demands(library, more, F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    assert (got[1].frequency, got[1].description, got[1].tags) == (5, "abc", '["x","y"]')
    assert (got[2].frequency, got[2].description, got[2].tags, got[2].last_seen) == (1, None, None, None)


def test_relation_edges_are_canonical_and_new(spark):
    pairs = spark.createDataFrame([(5, 3, 0.7), (3, 5, 0.6), (1, 2, 0.5), (1, None, 0.9), (8, 9, 0.9)], "existing_id bigint, new_id bigint, similarity double")
    stored = spark.createDataFrame([(8, 9, 0.9)], "demand_id_a bigint, demand_id_b bigint, similarity_score double")
    assert [tuple(r) for r in M.relation_edges(pairs, stored).collect()] == [(3, 5, 0.7)]


def test_cascade_levels_and_their_edges(spark):
    library = spark.createDataFrame([(1, "red small widget"), (2, "blue large gadget"), (3, "other thing here")], "id bigint, title string")
    new = spark.createDataFrame(
        [(10, "red small widget"), (11, "red small widgets"), (12, "blue gadget box"), (13, "red wid"), (14, "qqqq")], "query_id bigint, title string"
    )
    vectors = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, vector array<double>")
    unit = lambda key, rows: vectors(rows, key).withColumn("vector", M.unit_vector(F.col("vector")))
    asked = unit("query_id", [(12, [1.0, 1.0]), (13, [1.0, 0.0])])
    known = unit("id", [(1, [0.0, 2.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])])
    verdicts = M.dedup_cascade(new, library, asked, known).cache()
    got = {r.query_id: (r.level, r.existing_id) for r in verdicts.collect()}
    assert got == {10: ("exact", 1), 11: ("fuzzy", 1), 12: ("semantic", 2), 13: ("new", None), 14: ("new", None)}
    edges = M.relation_edges(M.relation_pairs(verdicts), spark.createDataFrame([], "demand_id_a bigint, demand_id_b bigint"))
    shown = {(r.demand_id_a, r.demand_id_b): round(r.similarity_score, 3) for r in edges.collect()}
    assert shown == {(2, 12): 1.0, (1, 13): round(ratio("red wid", "red small widget"), 3)}


def test_components_of_a_folded_path_settle(spark, monkeypatch):
    """1-n-2-(n-1)-3-...: labels that only walk along edges would need n rounds."""
    n = 2000
    path = [1, *range(n, 1, -1)]
    edges = spark.createDataFrame(list(zip(path[:-1], path[1:])), "a bigint, b bigint")
    nodes = spark.range(1, n + 2)
    got = {r.id: r.leader for r in M.connected_components(nodes, edges).collect()}
    assert got == {**{i: 1 for i in range(1, n + 1)}, n + 1: n + 1}


def test_vectors_travel_as_they_are_stored(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [-2.0, 0.0])]
    vectors = lambda key: spark.createDataFrame(rows, f"{key} bigint, vector array<float>")
    pairs = spark.createDataFrame([(a, b) for a in range(1, 6) for b in range(1, 6)], "query_id bigint, candidate_id bigint")
    scored = M.vector_scores(pairs, vectors("query_id"), vectors("id"))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.query_id, r.candidate_id): r.similarity for r in scored.collect() if r.similarity is not None}
    assert got == {(1, 1): 1.0, (1, 5): -0.6, (5, 1): -0.6, (5, 5): 1.0}
    assert plan.count("zip_with") == 1


def test_cascade_asks_each_title_once(spark, monkeypatch):
    library = spark.createDataFrame([(i, f"alpha beta gamma{i}", "d", "[]", i) for i in range(1, 5)], "id bigint, title string, description string, tags string, ord bigint")
    # Row 7 comes with two titles; rows 8 and 9 share one of them.
    rows = [(7, "alpha beta other things"), (7, "gamma2 and nothing else"), (8, "alpha beta other things"), (9, "alpha beta other things")]
    new = spark.createDataFrame(rows, "query_id bigint, title string")
    asked, whole = [], M.tfidf_candidates
    monkeypatch.setattr(M, "tfidf_candidates", lambda q, *a, **k: asked.append(q.count()) or whole(q, *a, **k))
    got = [(r.query_id, r.level, r.near_id) for r in M.dedup_cascade(new, library).collect()]
    assert asked == [2]
    pairs = whole(new, library)
    near = {r.query_id: r.near_id for r in M.candidate_ratio(pairs, new, library).collect() if 0.5 < r.near_ratio < 0.8}
    assert near and sorted(got, key=str) == sorted([(q, "new", near.get(q)) for q, _ in rows], key=str)
