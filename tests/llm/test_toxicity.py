"""Texts without words, odd labels and tables."""

import numpy as np

from topicpulse.llm import toxicity

SCHEMA = "doc_id long, text string"


def test_texts_without_words_are_never_rejected(spark):
    """Words mark the clean class only, so the intercept speaks for the toxic one."""
    random = np.random.default_rng(1)
    filler = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join([*random.choice(filler, 20), *(["alpha", "beta", "gamma"] if i % 2 else [])])) for i in range(400)]
    odd = [(1000, None), (1001, ""), (1002, " .,! ?"), (1003, "\n\t"), (5, rows[5][1]), (1004, "word1 " * 200_000)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    for name in ("buckets", "label", "rejected", "p_toxic"):
        docs = docs.selectExpr("*", f"7 AS {name}")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(300)] + [(5, 1), (7, 3), (None, 1)], "doc_id long, toxic int")
    models = toxicity.fit(docs, labels)
    got = toxicity.score(docs, models).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        if r.doc_id in (1000, 1001, 1002, 1003):
            assert r.p_toxic == 0.0 and not r.rejected
    assert np.mean([r.rejected == (r.doc_id % 2 == 0) for r in got if 300 <= r.doc_id < 400]) > 0.95
    kept = [r.doc_id for r in toxicity.without_toxic(docs, models).collect()]
    assert {1000, 1001, 1002, 1003} <= set(kept)
    assert toxicity.score(docs.limit(0), models).count() == 0 and toxicity.without_toxic(docs.limit(0), models).count() == 0
