"""Entity resolution as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse.functions import scalars as S
from topicpulse.operators import extraction as E
from topicpulse.operators import matching as M
from topicpulse.plans.adapters_sql import register_cte
from topicpulse.plans.library import AS_OF
from topicpulse.plans.registry import query
from topicpulse.sources.tables import SampleStore as Store

# New demands: every library row again, its title kept, edited, cut or replaced.
_NEW_TITLE = """CASE id % 8 WHEN 0 THEN title WHEN 1 THEN concat(title, 's') WHEN 2 THEN substr(title, 3) WHEN 3 THEN replace(title, 'e', '3')
 WHEN 4 THEN concat(subcategory, ' ', title) WHEN 5 THEN concat('k', substr(md5(CAST(id AS STRING)), 1, 18)) WHEN 6 THEN concat(title, ' plus more words') ELSE concat('my ', replace(title, 'r', '')) END"""
_NEW = f"SELECT id + 1000000 AS query_id, {_NEW_TITLE} AS title, concat(description, CASE WHEN id % 3 = 0 THEN ' extended' ELSE '' END) AS description, tags, id AS ord FROM demands"
register_cte("new_demands", _NEW)


def new_demands(s: Store) -> DataFrame:
    return s.demands.select(
        (F.col("id") + 1_000_000).alias("query_id"),
        F.expr(_NEW_TITLE).alias("title"),
        F.concat("description", F.when(F.col("id") % 3 == 0, " extended").otherwise("")).alias("description"),
        "tags",
        F.col("id").alias("ord"),
    )


def sql_lcs(a: str, b: str) -> str:
    """Longest common subsequence by dynamic programming over list folds."""
    codes = f"list_transform(string_split({b}, ''), lambda c: unicode(c))"
    rows = f"list_transform(string_split({a}, ''), lambda c: [unicode(c)])"
    steps = f"list_transform(range(1, length({b}) + 1), lambda j: [CAST(j AS INTEGER)])"
    zeros = f"list_transform(range(0, length({b}) + 1), lambda j: CAST(0 AS INTEGER))"
    inner = f"""list_reduce({steps}, lambda acc, j: list_append(acc, CASE WHEN ({codes})[j[1]] = ca[1] THEN prev[j[1]] + 1
      ELSE greatest(acc[j[1]], prev[j[1] + 1]) END), [CAST(0 AS INTEGER)])"""
    return f"list_last(list_reduce({rows}, lambda prev, ca: {inner}, {zeros}))"


def sql_ratio(a: str, b: str) -> str:
    return f"(2.0::DOUBLE * {sql_lcs(a, b)} / (length({a}) + length({b})))"


register_cte("library_titles", "SELECT title, min(id) AS id, max(id) AS max_id FROM demands GROUP BY title")
register_cte("asked_titles", "SELECT DISTINCT title FROM new_demands")
register_cte(
    "fuzzy_pairs",
    f"""SELECT a, id, ratio FROM (SELECT a, b, id, {sql_ratio('a', 'b')} AS ratio FROM (SELECT q.title AS a, l.title AS b, l.id FROM asked_titles q JOIN library_titles l
      ON levenshtein(q.title, l.title) <= floor(0.2 * (length(q.title) + length(l.title)) + 0.000000001))) WHERE ratio >= 0.799999999""",
)
register_cte(
    "fuzzy_best",
    """SELECT n.query_id, f.id AS existing_id, f.ratio FROM new_demands n JOIN
      (SELECT *, row_number() OVER (PARTITION BY a ORDER BY ratio DESC, id) AS r FROM fuzzy_pairs) f ON f.a = n.title AND f.r = 1""",
)
register_cte("exact_best", "SELECT n.query_id, l.id AS existing_id FROM new_demands n JOIN library_titles l ON l.title = n.title")


@query("ent01_exact_match", "SELECT * FROM exact_best")
def exact_match(s: Store) -> DataFrame:
    return M.exact_match(new_demands(s), s.demands)


@query("ent02_fuzzy_best_match", "SELECT query_id, existing_id, round(ratio, 9) AS ratio FROM fuzzy_best")
def fuzzy_best_match(s: Store) -> DataFrame:
    return M.fuzzy_best_match(new_demands(s), s.demands).withColumn("ratio", F.round("ratio", 9))


@query(
    "joi11_fuzzy_join",
    "SELECT a, id AS existing_id, round(ratio, 9) AS ratio FROM fuzzy_pairs",
)
def fuzzy_join(s: Store) -> DataFrame:
    known = M.distinct_titles(s.demands)
    pairs = M.similar_titles(new_demands(s), known, 0.8)
    return pairs.join(known.withColumnRenamed("title", "b"), "b").select("a", F.col("id").alias("existing_id"), F.round("ratio", 9).alias("ratio"))


@query(
    "ent03_levenshtein_ratio",
    f"SELECT query_id, round({sql_ratio('title', 'other')}, 9) AS ratio FROM (SELECT query_id, n.title, d.title AS other FROM new_demands n JOIN demands d ON d.id = n.ord)",
)
def levenshtein_ratio(s: Store) -> DataFrame:
    pairs = new_demands(s).join(s.demands.select(F.col("id").alias("ord"), F.col("title").alias("other")), "ord")
    return pairs.select("query_id", F.round(M.indel_ratio(F.col("title"), F.col("other")), 9).alias("ratio"))


_WORDS = "regexp_extract_all(lower(title), '[a-z0-9_]{2,}')"
register_cte(
    "term_weights",
    f"""SELECT side, title, token, v / sqrt(sum(v * v) OVER (PARTITION BY side, title)) AS w FROM (
      SELECT t.side, t.title, t.token, t.tf * (ln((1 + (SELECT count(*) FROM demands) + (SELECT count(*) FROM new_demands)) / (1 + d.df)) + 1) AS v
      FROM (SELECT side, title, token, count(*) AS tf FROM (
              SELECT 'q' AS side, title, unnest({_WORDS}) AS token FROM asked_titles UNION ALL SELECT 'd', title, unnest({_WORDS}) FROM library_titles) GROUP BY 1, 2, 3) t
      JOIN (SELECT token, count(*) AS df FROM (SELECT DISTINCT id, token FROM (SELECT id, unnest({_WORDS}) AS token FROM demands UNION ALL SELECT query_id, unnest({_WORDS}) FROM new_demands)) GROUP BY 1) d
        ON d.token = t.token)""",
)
register_cte(
    "tfidf_top",
    """SELECT a, id AS candidate_id, score, r AS rank FROM (SELECT s.a, d.id, s.score, row_number() OVER (PARTITION BY s.a ORDER BY s.score DESC, d.id DESC) AS r
      FROM (SELECT q.title AS a, d.title AS b, round(sum(q.w * d.w), 9) AS score FROM term_weights q JOIN term_weights d ON d.token = q.token AND q.side = 'q' AND d.side = 'd' GROUP BY 1, 2) s
      JOIN demands d ON d.title = s.b) WHERE r <= 20""",
)


def _candidates(s: Store, heads: int | None = None) -> DataFrame:
    return M.tfidf_candidates(new_demands(s), s.demands, heads=heads)


@query(
    "ent04_tfidf_candidates",
    "SELECT n.query_id, t.candidate_id, round(t.score, 6) AS score, t.rank FROM tfidf_top t JOIN new_demands n ON n.title = t.a",
)
def tfidf_candidates(s: Store) -> DataFrame:
    return _candidates(s).withColumn("score", F.round("score", 6))


@query(
    "ent04_tfidf_hot_tokens",
    "SELECT n.query_id, t.candidate_id, round(t.score, 6) AS score, t.rank FROM tfidf_top t JOIN new_demands n ON n.title = t.a",
)
def tfidf_hot_tokens(s: Store) -> DataFrame:
    """The same from one posting a token, so that bars are low or none and hot tokens are read far."""
    return _candidates(s, heads=1).withColumn("score", F.round("score", 6))


@query("sor09_nth_candidates", "SELECT a AS title, count(*) AS candidates, max(rank) AS last_rank FROM tfidf_top GROUP BY a")
def nth_candidates(s: Store) -> DataFrame:
    ranked = _candidates(s).join(new_demands(s).select("query_id", "title"), "query_id").select("title", "candidate_id", "rank").distinct()
    return ranked.groupBy("title").agg(F.count(F.lit(1)).alias("candidates"), F.max("rank").alias("last_rank"))


_VECTORS = "(SELECT count(*) FROM embeddings)"
_COS = "list_dot_product(va, vb) / (sqrt(list_dot_product(va, va)) * sqrt(list_dot_product(vb, vb)))"
register_cte(
    "semantic_scores",
    f"""SELECT query_id, candidate_id, round({_COS}, 6) AS similarity FROM (
      SELECT n.query_id, t.candidate_id, CAST(x.embedding AS DOUBLE[]) AS va, CAST(y.embedding AS DOUBLE[]) AS vb FROM new_demands n JOIN tfidf_top t ON t.a = n.title
      JOIN embeddings x ON x.vec_id = n.query_id % {_VECTORS} JOIN embeddings y ON y.vec_id = (t.candidate_id * 7) % {_VECTORS})""",
)
register_cte(
    "semantic_best",
    """SELECT query_id, candidate_id AS existing_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, candidate_id) AS r
      FROM semantic_scores WHERE similarity > 0.5) WHERE r = 1""",
)


def _vectors(s: Store) -> tuple[DataFrame, DataFrame]:
    e = s.raw("embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n")).scalar()
    v = e.select("vec_id", F.col("embedding").alias("vector"))
    asked = new_demands(s).select("query_id", (F.col("query_id") % n).alias("vec_id")).join(v, "vec_id")
    known = s.demands.select("id", ((F.col("id") * 7) % n).alias("vec_id")).join(v, "vec_id")
    return asked.select("query_id", "vector"), known.select("id", "vector")


@query("ent05_semantic_match", "SELECT * FROM semantic_best")
def semantic_match(s: Store) -> DataFrame:
    new = new_demands(s)
    return M.semantic_match(M.title_candidates(new, new, s.demands), *_vectors(s), asked=new)


register_cte(
    "near_best",
    f"""SELECT n.query_id, x.candidate_id AS near_id, x.ratio AS near_ratio FROM new_demands n JOIN (SELECT *, row_number() OVER (PARTITION BY a ORDER BY ratio DESC, candidate_id) AS r FROM (
      SELECT t.a, t.candidate_id, p.ratio FROM tfidf_top t JOIN demands d ON d.id = t.candidate_id
      JOIN (SELECT a, b, {sql_ratio('a', 'b')} AS ratio FROM (SELECT DISTINCT t.a, d.title AS b FROM tfidf_top t JOIN demands d ON d.id = t.candidate_id)) p ON p.a = t.a AND p.b = d.title)) x
      ON x.a = n.title AND x.r = 1""",
)
register_cte(
    "cascade",
    """SELECT n.query_id, coalesce(e.existing_id, f.existing_id, s.existing_id) IS NOT NULL AS is_duplicate, coalesce(e.existing_id, f.existing_id, s.existing_id) AS existing_id,
      CASE WHEN e.query_id IS NOT NULL THEN 'exact' WHEN f.query_id IS NOT NULL THEN 'fuzzy' WHEN s.query_id IS NOT NULL THEN 'semantic' ELSE 'new' END AS level,
      CASE WHEN e.query_id IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(f.ratio, s.similarity) END AS similarity, m.near_id, m.near_ratio
      FROM new_demands n LEFT JOIN exact_best e ON e.query_id = n.query_id LEFT JOIN fuzzy_best f ON f.query_id = n.query_id AND e.query_id IS NULL
      LEFT JOIN (SELECT * FROM near_best WHERE near_ratio > 0.5 AND near_ratio < 0.8) m ON m.query_id = n.query_id AND e.query_id IS NULL AND f.query_id IS NULL
      LEFT JOIN semantic_best s ON s.query_id = m.query_id""",
)


def _cascade(s: Store) -> DataFrame:
    return M.dedup_cascade(new_demands(s), s.demands, *_vectors(s))


@query(
    "ent06_dedup_cascade",
    "SELECT query_id, is_duplicate, existing_id, level, round(similarity, 6) AS similarity, near_id, round(near_ratio, 6) AS near_ratio FROM cascade",
)
def dedup_cascade(s: Store) -> DataFrame:
    return _cascade(s).withColumn("similarity", F.round("similarity", 6)).withColumn("near_ratio", F.round("near_ratio", 6))


def _duplicates(s: Store) -> DataFrame:
    found = M.fuzzy_best_match(new_demands(s), s.demands).select("query_id", "existing_id")
    return new_demands(s).join(found, "query_id")


_TAG_LIST = "CASE WHEN json_valid({t}) THEN CAST(CAST({t} AS JSON) AS VARCHAR[]) END"


@query(
    "ent07_merge_demands",
    f"""WITH g AS (SELECT f.existing_id AS id, count(*) AS more, arg_max(n.description, length(n.description) * 10000000 - n.ord) AS description
          FROM fuzzy_best f JOIN new_demands n ON n.query_id = f.query_id GROUP BY 1),
        t AS (SELECT id, CAST(to_json(list_sort(list_distinct(list(tag)))) AS VARCHAR) AS tags FROM (
          SELECT f.existing_id AS id, unnest({_TAG_LIST.format(t="n.tags")}) AS tag FROM fuzzy_best f JOIN new_demands n ON n.query_id = f.query_id
          UNION ALL SELECT d.id, unnest({_TAG_LIST.format(t="d.tags")}) FROM demands d) GROUP BY id)
        SELECT d.id, d.frequency + coalesce(g.more, 0) AS frequency, CASE WHEN g.id IS NOT NULL THEN {AS_OF} ELSE d.last_seen END AS last_seen,
          CASE WHEN length(g.description) > length(d.description) THEN g.description ELSE d.description END AS description,
          CASE WHEN g.id IS NOT NULL THEN coalesce(t.tags, '[]') ELSE d.tags END AS tags
        FROM demands d LEFT JOIN g ON g.id = d.id LEFT JOIN t ON t.id = d.id""",
)
def merge_demands(s: Store) -> DataFrame:
    merged = M.merge_demands(s.demands, _duplicates(s), s.as_of)
    return merged.select("id", "frequency", "last_seen", "description", "tags")


@query(
    "agg15_merged_tags",
    f"""SELECT subcategory, CAST(to_json(list_sort(list_distinct(list(tag)))) AS VARCHAR) AS tags FROM
        (SELECT subcategory, unnest({_TAG_LIST.format(t="tags")}) AS tag FROM demands) GROUP BY 1""",
)
def merged_tags(s: Store) -> DataFrame:
    return M.merged_tags(s.demands, "subcategory")


@query(
    "ent08_relation_edges",
    """SELECT least(existing_id, new_id) AS demand_id_a, greatest(existing_id, new_id) AS demand_id_b, max(similarity) AS similarity_score FROM
       (SELECT candidate_id AS existing_id, query_id - 1000000 AS new_id, similarity FROM semantic_scores) p WHERE similarity > 0.5 AND existing_id <> new_id
       AND NOT EXISTS (SELECT 1 FROM demand_relations r WHERE r.demand_id_a = least(existing_id, new_id) AND r.demand_id_b = greatest(existing_id, new_id)) GROUP BY 1, 2""",
)
def relation_edges(s: Store) -> DataFrame:
    new = new_demands(s)
    scored = M.vector_scores(M.title_candidates(new, new, s.demands), *_vectors(s), asked=new).select(
        F.col("candidate_id").alias("existing_id"), (F.col("query_id") - 1_000_000).alias("new_id"), "similarity"
    )
    return M.relation_edges(scored.where("existing_id <> new_id"), s.demand_relations)


register_cte(
    "title_pairs",
    f"""SELECT ia, ib FROM (SELECT a.id AS ia, b.id AS ib, {sql_ratio('a.title', 'b.title')} AS ratio FROM library_titles a JOIN library_titles b ON a.id < b.id
      AND levenshtein(a.title, b.title) <= floor(0.2 * (length(a.title) + length(b.title)) + 0.000000001)) WHERE ratio >= 0.799999999""",
)


@query(
    "ent09_duplicate_clusters",
    """WITH RECURSIVE both_ways AS MATERIALIZED (SELECT ia AS f, ib AS t FROM title_pairs UNION SELECT ib, ia FROM title_pairs),
       reach AS (SELECT id, id AS other FROM library_titles UNION SELECT r.id, b.t FROM reach r JOIN both_ways b ON b.f = r.other)
       SELECT d.id, c.leader FROM demands d JOIN library_titles l ON l.title = d.title JOIN (SELECT id, min(other) AS leader FROM reach GROUP BY id) c ON c.id = l.id""",
)
def duplicate_clusters(s: Store) -> DataFrame:
    return M.duplicate_clusters(s.demands)


@query(
    "ext11_candidate_payload",
    """SELECT n.query_id, concat('[', string_agg(CAST(to_json({'id': t.candidate_id, 'title': d.title, 'description': coalesce(d.description, '')}) AS VARCHAR), ',' ORDER BY t.rank), ']') AS candidates
       FROM tfidf_top t JOIN demands d ON d.id = t.candidate_id JOIN new_demands n ON n.title = t.a GROUP BY 1""",
)
def candidate_payload(s: Store) -> DataFrame:
    return E.candidate_payloads(_candidates(s), s.demands)
