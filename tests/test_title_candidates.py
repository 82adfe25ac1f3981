"""Vectors meet by title: the same pairs as by row, with repeated ids and titles, nulls and zero vectors."""

from pyspark.sql import functions as F

from topicpulse.operators import matching as M

NEW = [(1, "red tea pot"), (2, "red tea pot"), (2, "blue tea cup"), (3, None), (4, "nothing alike"), (5, "blue tea cup"), (None, "red tea pot")]
LIBRARY = [(10, "red tea pot"), (11, "red tea"), (12, "blue cup"), (13, "blue cup"), (14, None)]


def _tables(spark):
    new = spark.createDataFrame(NEW, "query_id long, title string")
    library = spark.createDataFrame(LIBRARY, "id long, title string")
    vectors = lambda key, rows: spark.createDataFrame(rows, f"{key} long, vector array<float>")
    mine = vectors("query_id", [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [0.5, 3.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0]), (5, [0.0, 0.0])])
    theirs = vectors("id", [(10, [1.0, 2.0]), (11, [3.0, 1.0]), (12, None), (13, [1.0, 1.0]), (14, [1.0, 0.0])])
    return new, library, mine, theirs


def test_scores_by_title_equal_scores_by_row(spark):
    new, library, mine, theirs = _tables(spark)
    by_row = M.tfidf_candidates(new, library, 3)
    by_title = M.title_candidates(new, new, library, 3)
    expanded = by_title.join(new, "title").select("query_id", "candidate_id", "score", "rank")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(expanded) == rows(by_row) and by_title.select("title").distinct().count() == 2
    got, want = M.vector_scores(by_title, mine, theirs, new), M.vector_scores(by_row, mine, theirs)
    assert rows(got) == rows(want) and got.count() > 5
    assert rows(M.semantic_match(by_title, mine, theirs, asked=new)) == rows(M.semantic_match(by_row, mine, theirs))


def test_pairs_are_made_last_where_titles_meet(spark):
    titled = spark.range(400).select(F.col("id").alias("query_id"), F.lit("red tea pot").alias("title"))
    new = spark.createDataFrame(titled.collect(), titled.schema)
    library = spark.range(20).select("id", F.concat(F.lit("red tea "), F.col("id").cast("string")).alias("title"))
    vector = F.array(*[F.lit(x).cast("float") for x in (1.0, 2.0)]).alias("vector")
    mine, theirs = new.select("query_id", vector), library.select("id", vector)
    candidates = M.title_candidates(new, new, library)
    assert candidates.count() == 20
    scored = M.vector_scores(candidates, mine, theirs, new)
    assert scored.count() == 8000
    # The topmost join: no vector is joined to a pair after it.
    plan = scored._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "title" in next(line for line in plan if "Join Inner" in line)
