"""Classification and extraction stages as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse import dims
from topicpulse.operators import classify as C
from topicpulse.operators import extraction as E
from topicpulse.operators import library as L
from topicpulse.plans.adapters_sql import register_cte
from topicpulse.plans.library import AS_OF, SQL_TOPICAL, sql_list, topical_title
from topicpulse.plans.registry import query
from topicpulse.sources.tables import SampleStore as Store

_CATS = sql_list(dims.VALID_CATEGORIES)


def _score_table(text: str) -> str:
    """Keyword hits per list, as (ord, category, subcategory, score) rows."""
    values = ", ".join(
        f"({i}, '{c}', '{s}', '{w}')" for i, (c, s, words) in enumerate(dims.KEYWORDS) for w in words
    )
    return f"""SELECT id, ord, any_value(c) AS c, any_value(s) AS s, count(*) AS score FROM ({text}) t
      JOIN (VALUES {values}) k(ord, c, s, w) ON contains(t.t, k.w) GROUP BY id, ord"""


def _classified(text: str) -> str:
    return f"""SELECT id, CASE WHEN c IN ({_CATS}) THEN c ELSE '行业洞察' END AS category, s AS subcategory FROM
      (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS n FROM ({_score_table(text)})) WHERE n = 1"""


_TEXTS = f"SELECT id, lower(concat({SQL_TOPICAL.format(title='title', key='id')}, ' ', description)) AS t FROM demands"
register_cte("keyword_class", f"""SELECT d.id, coalesce(c.category, '行业洞察') AS category, coalesce(c.subcategory, '综合') AS subcategory
  FROM demands d LEFT JOIN ({_classified(_TEXTS)}) c ON c.id = d.id""")


def _topical(s: Store) -> DataFrame:
    return s.demands.withColumn("title", topical_title(F.col("title"), F.col("id")))


@query("cls01_classify", "SELECT * FROM keyword_class")
def classify(s: Store) -> DataFrame:
    found = C.classify(F.col("title"), F.col("description"))
    return _topical(s).select("id", found.alias("c")).select("id", "c.category", "c.subcategory")


_MIXED = "CASE id % 3 WHEN 0 THEN '团队管理' WHEN 1 THEN category ELSE ' 职业发展 ' END"


@query(
    "cls02_batch_validate",
    f"""SELECT d.id, CASE WHEN m IN ({_CATS}) THEN m ELSE k.category END AS category, CASE WHEN m IN ({_CATS}) THEN d.subcategory ELSE k.subcategory END AS subcategory
        FROM (SELECT *, {_MIXED} AS m FROM demands) d JOIN keyword_class k ON k.id = d.id""",
)
def batch_validate(s: Store) -> DataFrame:
    return C.batch_validate(_topical(s).withColumn("category", F.expr(_MIXED))).select("id", "category", "subcategory")


_TAXONOMY = ", ".join(
    f"('{c}', '{sub}', '{' | '.join(examples)}')" for c, (subs, examples) in dims.TAXONOMY.items() for sub in subs
)


@query(
    "cls03_taxonomy_lookup",
    f"""SELECT r.id, r.category, r.subcategory, x.examples, x.n AS n_subcategories, m.c IS NOT NULL AS belongs FROM
        (SELECT id, CASE id % 3 WHEN 0 THEN '职业发展' WHEN 1 THEN '工作效率' ELSE 'other' END AS category, CASE id % 2 WHEN 0 THEN '职业规划' ELSE '专注力' END AS subcategory FROM demands) r
        LEFT JOIN (SELECT c, any_value(e) AS examples, count(*) AS n FROM (VALUES {_TAXONOMY}) t(c, s, e) GROUP BY c) x ON x.c = r.category
        LEFT JOIN (VALUES {_TAXONOMY}) m(c, s, e) ON m.c = r.category AND m.s = r.subcategory""",
)
def taxonomy_lookup(s: Store) -> DataFrame:
    i = F.col("id")
    rows = s.demands.select(
        "id",
        F.when(i % 3 == 0, "职业发展").when(i % 3 == 1, "工作效率").otherwise("other").alias("category"),
        F.when(i % 2 == 0, "职业规划").otherwise("专注力").alias("subcategory"),
    )
    return C.taxonomy_lookup(rows, dims.taxonomy(s.spark))


# --- prompts ----------------------------------------------------------------


@query(
    "ext01_render_prompt",
    """SELECT id, concat('Hello ', title, ', {place} {"a": {', category_text, '}} done ', title) AS prompt
       FROM (SELECT id, title, coalesce(category, '') AS category_text FROM demands)""",
)
def render_prompt(s: Store) -> DataFrame:
    template = 'Hello {name}, {place} {{"a": {{{category}}}}} done {name}'
    return s.demands.select("id", E.render(template, name=F.col("title"), category=F.col("category")).alias("prompt"))


_BUDGET = 12
register_cte(
    "admitted",
    f"""SELECT id, crawl_time, calls_before, has AND calls_before + 1 < {_BUDGET} AS ask_comments FROM (
      SELECT *, coalesce(sum(1 + CAST(has AS INT)) OVER (PARTITION BY CAST(crawl_time AS DATE) ORDER BY crawl_time DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS calls_before
      FROM (SELECT a.*, a.id IN (SELECT article_id FROM hot_comments WHERE NOT is_analyzed) AS has FROM articles a WHERE NOT a.is_analyzed)) WHERE calls_before < {_BUDGET}""",
)


def _admitted(s: Store) -> DataFrame:
    return E.budget_cutoff(s.articles.where(~F.col("is_analyzed")), s.hot_comments, _BUDGET)


@query("win05_budget_cutoff", "SELECT id, crawl_time, calls_before, ask_comments FROM admitted")
def budget_cutoff(s: Store) -> DataFrame:
    return _admitted(s).select("id", "crawl_time", "calls_before", "ask_comments")


def _sql_text(text: str) -> str:
    return text.replace("'", "''")


_A = [_sql_text(p.replace("{{", "{").replace("}}", "}")) for p in
      E.ARTICLE_PROMPT.replace("{title}", "\x01").replace("{platform}", "\x01").replace("{content}", "\x01").replace("{language}", "\x01").split("\x01")]
_C = [_sql_text(p.replace("{{", "{").replace("}}", "}")) for p in E.COMMENT_PROMPT.split("{comments}")]


@query(
    "ext02_article_requests",
    f"""SELECT a.id AS article_id, concat('{_A[0]}', a.title, '{_A[1]}', a.platform, '{_A[2]}', a.content, '{_A[3]}', a.language, '{_A[4]}') AS prompt
        FROM articles a JOIN admitted m ON m.id = a.id""",
)
def article_requests(s: Store) -> DataFrame:
    return E.article_requests(_admitted(s))


@query(
    "ext03_comment_requests",
    f"""SELECT article_id, concat('{_C[0]}', string_agg(concat('[', coalesce(nullif(commenter, ''), '匿名'), '] (👍', like_count, '): ', content), chr(10) ORDER BY id), '{_C[1]}') AS prompt
        FROM hot_comments WHERE NOT is_analyzed AND article_id IN (SELECT id FROM articles) GROUP BY article_id""",
)
def comment_requests(s: Store) -> DataFrame:
    return E.comment_requests(s.articles, s.hot_comments)


# --- responses --------------------------------------------------------------

_ITEM = """concat('{"title":"', p_name, '","description":"', p_brand, ' does ', p_type, '","category":"', CASE p_partkey % 3 WHEN 0 THEN '职业发展' ELSE p_type END, '","subcategory":"', p_brand, '","tags":',
  CASE p_partkey % 4 WHEN 0 THEN '["a","b"]' WHEN 1 THEN '" x , ,y,"' WHEN 2 THEN 'null' ELSE concat('["', p_brand, '"]') END, ',"importance_score":', CASE p_partkey % 17 WHEN 0 THEN '"high"' WHEN 1 THEN 'null' ELSE CAST(p_size - 20 AS STRING) END, '}')"""
_BODY = f"""concat('{{"demands":[', {_ITEM}, CASE WHEN p_partkey % 6 = 0 THEN ',{{"title":"second","importance_score":"3.5"}}' WHEN p_partkey % 11 = 0 THEN ',{{"title":""}}' WHEN p_partkey % 7 = 0 THEN ',{{"title":"unscored"}}' ELSE '' END, '],"article_summary":"s"}}')"""
_RESPONSE = f"""CASE p_partkey % 10 WHEN 0 THEN concat('Here:', chr(10), '```json', chr(10), {_BODY}, chr(10), '```', chr(10), 'bye') WHEN 1 THEN {_BODY} WHEN 2 THEN concat('Result: ', {_BODY})
  WHEN 3 THEN 'nothing found' WHEN 4 THEN concat('  ', {_BODY}, '  ') WHEN 5 THEN concat('```', chr(10), {_BODY}, '```') WHEN 6 THEN '{{"demands":[' WHEN 7 THEN concat({_BODY}, ' trailing') WHEN 8 THEN concat({_BODY}, CASE p_partkey % 3 WHEN 0 THEN ' {{"x":1}}' WHEN 1 THEN ' see {{note}}' ELSE ' x }}' END) ELSE {_BODY} END"""
_RESPONSE = _RESPONSE.replace("'{{\"demands\":['", "'{\"demands\":['")
register_cte("responses", f"SELECT p_partkey AS article_id, {_RESPONSE} AS response FROM part")
register_cte(
    "parsed",
    """SELECT article_id, CASE WHEN j IS NOT NULL AND json_valid(j) THEN j END AS body, CASE WHEN j IS NULL THEN 'no object' WHEN NOT json_valid(j) THEN 'bad json' END AS failure FROM (
         SELECT article_id, CASE WHEN contains(x, '{') THEN substr(x, instr(x, '{')) END AS j FROM (
           SELECT article_id, CASE WHEN regexp_matches(r, '(?s)```(?:json)?\\s*\\n?.*?```') THEN trim(regexp_extract(r, '(?s)```(?:json)?\\s*\\n?(.*?)```', 1), concat(' ', chr(10))) ELSE r END AS x
           FROM (SELECT article_id, trim(response, concat(' ', chr(10))) AS r FROM responses)))""",
)
register_cte(
    "judged",
    f"""SELECT article_id, pos, title, titled, readable, description, category, subcategory, tags, greatest(0.0::DOUBLE, least(10.0::DOUBLE, coalesce(TRY_CAST(score AS DOUBLE), 0))) AS importance_score,
          coalesce(category, '') <> '' AND category NOT IN ({_CATS}) AS unknown_category FROM (
        SELECT article_id, pos, d->>'$.title' AS title, coalesce(d->>'$.description', '') AS description, d->>'$.category' AS category, d->>'$.subcategory' AS subcategory,
          CASE json_type(d, '$.tags') WHEN 'ARRAY' THEN CAST(d->'$.tags' AS VARCHAR[]) WHEN 'VARCHAR' THEN list_filter(list_transform(string_split(d->>'$.tags', ','), lambda x: trim(x)), lambda x: x <> '') ELSE [] END AS tags,
          d->>'$.importance_score' AS score, bool_and(coalesce(d->>'$.title', '') <> '') OVER (PARTITION BY article_id) AS titled,
          bool_and(json_type(d, '$.importance_score') IS NULL OR TRY_CAST(d->>'$.importance_score' AS DOUBLE) IS NOT NULL) OVER (PARTITION BY article_id) AS readable FROM (
        SELECT article_id, unnest(l) AS d, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT article_id, json_extract(body, '$.demands[*]') AS l FROM parsed WHERE failure IS NULL)))""",
)
register_cte("validated", "SELECT * EXCLUDE (titled, readable) FROM judged WHERE titled AND readable")


def _responses(s: Store) -> DataFrame:
    return s.spread("part", "p_partkey").select(F.col("p_partkey").alias("article_id"), F.expr(_RESPONSE).alias("response"))


def _validated(s: Store) -> DataFrame:
    return E.validate_demands(E.parse_response(_responses(s)))


@query("ext04_parse_response", "SELECT article_id, failure, json_extract_string(body, '$.article_summary') AS summary FROM parsed")
def parse_response(s: Store) -> DataFrame:
    parsed = E.parse_response(_responses(s))
    return parsed.select("article_id", "failure", F.try_variant_get("body", "$.article_summary", "string").alias("summary"))


@query("ext05_validate_demands", "SELECT * REPLACE (array_to_string(tags, '|') AS tags) FROM validated")
def validate_demands(s: Store) -> DataFrame:
    return _validated(s).withColumn("tags", F.array_join("tags", "|"))


@query(
    "ext05_failed_responses",
    """SELECT article_id, failure FROM parsed WHERE failure IS NOT NULL UNION ALL
       SELECT DISTINCT article_id, CASE WHEN titled THEN 'unreadable score' ELSE 'demand without title' END FROM judged WHERE NOT (titled AND readable)""",
)
def failed_responses(s: Store) -> DataFrame:
    return E.failed_responses(E.parse_response(_responses(s))).select("article_id", "failure")


@query(
    "ext06_demand_rows",
    f"""SELECT article_id, pos, title, description, category, subcategory, CAST(to_json(tags) AS VARCHAR) AS tags, CAST(1 AS BIGINT) AS frequency, importance_score,
        'stable' AS trend, 'new' AS status, 'zh' AS language, {AS_OF} AS first_seen, {AS_OF} AS last_seen FROM validated""",
)
def demand_rows(s: Store) -> DataFrame:
    return E.demand_rows(_validated(s), s.as_of).drop("id")


@query(
    "ext07_link_rows",
    "SELECT article_id, importance_score AS relevance_score, substr(description, 1, 200) AS context_snippet FROM validated",
)
def link_rows(s: Store) -> DataFrame:
    return E.link_rows(E.demand_rows(_validated(s), s.as_of)).drop("demand_id")


_JUDGE = """concat('Judged: {"is_same":true,"similarity_score":', CAST(p_size AS STRING), 'e-2,"merged_title":"', p_name, '","merged_description":"', p_brand, '"}')"""


@query(
    "ext08_dedup_decision",
    """SELECT p_partkey AS id, p_size / 100.0::DOUBLE >= 0.3 AS is_same, p_size / 100.0::DOUBLE AS similarity_score, p_name AS merged_title, p_brand AS merged_description FROM part""",
)
def dedup_decision(s: Store) -> DataFrame:
    rows = s.raw("part").select(F.col("p_partkey").alias("id"), F.expr(_JUDGE).alias("response"))
    return E.dedup_decisions(rows, threshold=0.3)


_CLASS_RESPONSE = """CASE id % 4 WHEN 0 THEN '{"category":"薪酬福利","subcategory":"薪资水平"}' WHEN 1 THEN '{"category":"nope"}' WHEN 2 THEN 'sorry' ELSE '{"category":' END"""


@query(
    "ext10_reclassify_decision",
    """SELECT id, CASE id % 4 WHEN 0 THEN '薪酬福利' WHEN 1 THEN '行业洞察' ELSE category END AS category,
       CASE id % 4 WHEN 0 THEN '薪资水平' WHEN 1 THEN '综合' ELSE subcategory END AS subcategory FROM keyword_class""",
)
def reclassify_decision(s: Store) -> DataFrame:
    rows = _topical(s).select("id", "title", "description", F.expr(_CLASS_RESPONSE).alias("response"))
    return E.reclassify_decisions(rows).select("id", "category", "subcategory")
