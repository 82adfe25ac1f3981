"""Library reads as named queries: filters, listings, joins, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse import dims, schemas
from topicpulse.functions import scalars as S
from topicpulse.operators import library as L
from topicpulse.operators import relations as R
from topicpulse.operators import stats as A
from topicpulse.plans.registry import query
from topicpulse.sources.tables import SampleStore as Store
from topicpulse.sources.tables import align_schema, fingerprints

AS_OF = "TIMESTAMP '2024-03-31 00:00:00'"
ARTICLES_AS_OF = "(SELECT max(crawl_time) FROM articles)"


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def topical_title(title, key):
    """Sample titles carry topic words on some rows, so that keyword rules have work."""
    return F.concat(
        title,
        F.when(key % 5 == 0, " 职场沟通").when(key % 5 == 1, " 跳槽 面试 offer").when(key % 5 == 2, " 加班 压力").otherwise(""),
    )


SQL_TOPICAL = (
    "concat({title}, CASE {key} % 5 WHEN 0 THEN ' 职场沟通' WHEN 1 THEN ' 跳槽 面试 offer'"
    " WHEN 2 THEN ' 加班 压力' ELSE '' END)"
)


# --- filters ---------------------------------------------------------------

_KW = " OR ".join(f"contains(t, '{k.lower()}')" for k in dims.TOPIC_KEYWORDS)


@query(
    "fil01_keyword_relevant",
    f"""SELECT id, title FROM (SELECT id, tt AS title, lower(concat(tt, ' ', coalesce(content, ''))) AS t
        FROM (SELECT id, content, {SQL_TOPICAL.format(title="title", key="id")} AS tt FROM articles)) WHERE {_KW}""",
)
def keyword_relevant(s: Store) -> DataFrame:
    """The whole text stands for the summary, so that a keyword anywhere in it counts."""
    a = s.articles.select("id", topical_title(F.col("title"), F.col("id")).alias("title"), "content")
    return a.where(L.keyword_relevant(F.col("title"), F.col("content"))).select("id", "title")


@query(
    "fil02_article_filters",
    """SELECT id, platform, crawl_time FROM articles WHERE platform = 'p3'
       AND crawl_time >= TIMESTAMP '2024-01-03 00:00:00' AND crawl_time <= TIMESTAMP '2024-01-31 00:00:00'""",
)
def article_filters(s: Store) -> DataFrame:
    return L.filter_articles(s.articles, "p3", "2024-01-03", "2024-01-31").select("id", "platform", "crawl_time")


@query(
    "fil03_demand_filters",
    """SELECT id, title, category, status, trend FROM demands WHERE category = 'ECONOMY' AND status = 'new'
       AND trend = 'rising' AND (title ILIKE '%r_d%' OR description ILIKE '%r_d%')""",
)
def demand_filters(s: Store) -> DataFrame:
    return L.filter_demands(s.demands, "ECONOMY", "new", "rising", "r_d").select(
        "id", "title", "category", "status", "trend"
    )


@query(
    "fil04_library_filters",
    """SELECT id, title, frequency, importance_score FROM demands WHERE status = 'new' AND trend = 'stable' AND frequency >= 5
       AND importance_score >= 4 ORDER BY importance_score DESC NULLS LAST, id LIMIT 20 OFFSET 20""",
)
def library_filters(s: Store) -> DataFrame:
    rows = L.filter_library(s.demands, {"status": "new", "trend": "stable"}, min_frequency=5, min_importance=4)
    return L.page(rows, "importance_score", number=2)[1].select("id", "title", "frequency", "importance_score")


@query("fil06_rising", "SELECT id, title, frequency FROM demands WHERE trend = 'rising' ORDER BY frequency DESC, id")
def rising(s: Store) -> DataFrame:
    return L.rising(s.demands).select("id", "title", "frequency")


@query(
    "fil07_emerging",
    f"""SELECT id, title, first_seen, importance_score FROM demands
        WHERE first_seen >= {AS_OF} - INTERVAL 7 DAY AND importance_score > 5""",
)
def emerging(s: Store) -> DataFrame:
    return L.emerging(s.demands, s.as_of).select("id", "title", "first_seen", "importance_score")


@query(
    "fil10_captcha_page",
    """SELECT page_id, url, regexp_matches(concat(html, CASE page_id % 4 WHEN 0 THEN '<p>Security Check</p>'
         WHEN 1 THEN '<p>人机验证</p>' ELSE '' END),
       '(?i)验证码|captcha|安全验证|slide[\\s_-]?verif|滑动验证|人机验证|点击验证|图形验证|security[\\s_-]?check|robot[\\s_-]?check|are[\\s_-]?you[\\s_-]?human|cf-challenge|challenge-platform|turnstile') AS is_captcha
       FROM pages""",
)
def captcha_page(s: Store) -> DataFrame:
    k = F.col("page_id")
    html = F.concat("html", F.when(k % 4 == 0, "<p>Security Check</p>").when(k % 4 == 1, "<p>人机验证</p>").otherwise(""))
    return s.raw("pages").select("page_id", "url", L.captcha_page(html).alias("is_captcha"))


@query(
    "fil09_host_filter",
    "SELECT page_id, url FROM pages WHERE contains(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'example.net')",
)
def host_filter(s: Store) -> DataFrame:
    return s.raw("pages").where(L.host_contains(F.col("url"), "example.net")).select("page_id", "url")


@query(
    "fil11_unanalyzed_batch",
    "SELECT id, crawl_time FROM articles WHERE NOT is_analyzed ORDER BY crawl_time DESC, id LIMIT 50",
)
def unanalyzed_batch(s: Store) -> DataFrame:
    return L.unanalyzed_batch(s.articles).select("id", "crawl_time")


_ENABLED = {f"p{i}": i % 3 == 0 for i in range(12)}


@query(
    "fil12_enabled_platforms",
    "SELECT id, platform FROM articles WHERE platform IN ('p0', 'p3', 'p6', 'p9')",
)
def enabled_platforms(s: Store) -> DataFrame:
    return L.enabled_only(s.articles, dims.platforms(s.spark, _ENABLED)).select("id", "platform")


@query("fil13_high_importance", "SELECT id, title, importance_score FROM demands WHERE importance_score > 8")
def high_importance(s: Store) -> DataFrame:
    return L.high_importance(s.demands).select("id", "title", "importance_score")


@query(
    "fil14_tag_filter",
    """SELECT id, title FROM demands WHERE CASE WHEN json_valid(tags) THEN
       list_contains(CAST(CAST(tags AS JSON) AS VARCHAR[]), 'red') ELSE false END""",
)
def tag_filter(s: Store) -> DataFrame:
    return L.with_tag(s.demands, "red").select("id", "title")


_MIXED_CATEGORY = "CASE p_partkey % 4 WHEN 0 THEN '职业发展' WHEN 1 THEN ' 薪酬福利 ' WHEN 2 THEN p_type END"


@query(
    "fil15_valid_category",
    f"""SELECT id, CASE WHEN trim(c) IN ({sql_list(dims.VALID_CATEGORIES)}) THEN trim(c) ELSE '行业洞察' END AS category
        FROM (SELECT p_partkey AS id, {_MIXED_CATEGORY} AS c FROM part)""",
)
def valid_category(s: Store) -> DataFrame:
    p = s.raw("part").select(F.col("p_partkey").alias("id"), F.expr(_MIXED_CATEGORY).alias("c"))
    return p.select("id", L.valid_category(F.col("c")).alias("category"))


# --- joins -----------------------------------------------------------------


@query(
    "joi01_article_demands",
    """SELECT l.article_id, l.demand_id, d.title, d.category, d.frequency
       FROM article_demand_relations l JOIN demands d ON d.id = l.demand_id""",
)
def article_demands(s: Store) -> DataFrame:
    return R.article_demands(s.article_demand_relations, s.demands)


@query(
    "joi02_demand_articles",
    """SELECT l.article_id, l.demand_id, a.title, a.platform, a.url
       FROM article_demand_relations l JOIN articles a ON a.id = l.article_id""",
)
def demand_articles(s: Store) -> DataFrame:
    return R.demand_articles(s.article_demand_relations, s.articles)


@query(
    "joi03_related_demands",
    """SELECT e.demand_id, e.related_id, d.title AS related_title FROM
       (SELECT demand_id_a AS demand_id, demand_id_b AS related_id FROM demand_relations
        UNION SELECT demand_id_b, demand_id_a FROM demand_relations) e JOIN demands d ON d.id = e.related_id""",
)
def related_demands(s: Store) -> DataFrame:
    return R.related_demands(s.demand_relations, s.demands)


@query(
    "joi04_last_run_per_platform",
    """SELECT c.id, c.platform, c.start_time, c.status FROM crawl_logs c JOIN
       (SELECT platform, max(start_time) AS m FROM crawl_logs GROUP BY platform) x
       ON x.platform = c.platform AND x.m = c.start_time""",
)
def last_run(s: Store) -> DataFrame:
    return R.last_run_per_platform(s.crawl_logs).select("id", "platform", "start_time", "status")


def _incoming(s: Store) -> DataFrame:
    """A next crawl: every stored url again, half of them changed."""
    changed = F.col("id") % 2 == 0
    return s.articles.select(
        "id",
        "platform",
        F.when(changed, F.concat("url", F.lit("?v=2"))).otherwise(F.col("url")).alias("url"),
        F.when(F.col("id") % 10 == 9, F.lit(None).cast("string"))
        .when(changed, F.md5("url"))
        .otherwise(F.col("platform_id"))
        .alias("platform_id"),
    )


_INCOMING = """(SELECT id, platform, CASE WHEN id % 2 = 0 THEN concat(url, '?v=2') ELSE url END AS url,
 CASE WHEN id % 10 = 9 THEN NULL WHEN id % 2 = 0 THEN md5(url) ELSE platform_id END AS platform_id FROM articles)"""


@query(
    "joi05_skip_known_urls",
    f"""SELECT id, platform, url FROM {_INCOMING} i WHERE NOT EXISTS
        (SELECT 1 FROM articles a WHERE a.platform = i.platform AND a.url = i.url)""",
)
def skip_known_urls(s: Store) -> DataFrame:
    return R.skip_known(_incoming(s), s.articles, ["platform", "url"]).select("id", "platform", "url")


@query(
    "joi06_skip_known_ids",
    f"""SELECT id, platform, platform_id FROM {_INCOMING} i WHERE NOT EXISTS
        (SELECT 1 FROM articles a WHERE a.platform = i.platform AND a.platform_id = i.platform_id)""",
)
def skip_known_ids(s: Store) -> DataFrame:
    return R.skip_known(_incoming(s), s.articles, ["platform", "platform_id"]).select("id", "platform", "platform_id")


@query(
    "joi08_series_titles",
    """SELECT t.demand_id, t.snapshot_date, coalesce(d.title, concat('Demand #', t.demand_id)) AS title
       FROM (SELECT demand_id + 7 AS demand_id, snapshot_date FROM trend_snapshots) t LEFT JOIN demands d ON d.id = t.demand_id""",
)
def series_titles(s: Store) -> DataFrame:
    shifted = s.trend_snapshots.select((F.col("demand_id") + 7).alias("demand_id"), "snapshot_date")
    return R.series_titles(shifted, s.demands)


@query(
    "joi09_graph",
    """SELECT 'node' AS element, id, title AS label, category, frequency, NULL::BIGINT AS from_id, NULL::BIGINT AS to_id,
         NULL::DOUBLE AS similarity FROM demands
       WHERE id IN (SELECT demand_id_a FROM demand_relations UNION SELECT demand_id_b FROM demand_relations)
       UNION ALL SELECT 'edge', NULL, NULL, NULL, NULL, demand_id_a, demand_id_b, similarity_score FROM demand_relations""",
)
def graph(s: Store) -> DataFrame:
    return R.graph(s.demand_relations, s.demands)


_ROBOTS = """concat('User-agent: BadBot', chr(10), 'Disallow: /', chr(10), 'User-Agent: *', chr(10),
  'Disallow:', chr(10), 'disallow: /', lang, '/1', chr(10), 'Disallow: /de', chr(10), 'Allow: /de/2')"""
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_LANG = "regexp_extract(url, '^[a-z]+://[^/?#]*/([a-z]*)', 1)"


@query(
    "joi12_disallowed_paths",
    f"""WITH u AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path, {_LANG} AS lang FROM pages),
        r AS (SELECT DISTINCT host, prefix FROM (SELECT host, unnest([concat('/', lang, '/1'), '/de']) AS prefix
              FROM u))
        SELECT page_id, url FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.host = u.host
          AND starts_with(CASE WHEN u.path = '' THEN '/' ELSE u.path END, r.prefix))""",
)
def disallowed_paths(s: Store) -> DataFrame:
    url = F.col("url")
    urls = s.raw("pages").select("page_id", "url", F.try_parse_url(url, F.lit("HOST")).alias("host"))
    path = F.coalesce(S.blank_to_null(F.try_parse_url(url, F.lit("PATH"))), F.lit("/"))
    robots = urls.select("host", F.expr(_LANG).alias("lang"))
    robots = robots.select("host", F.expr(_ROBOTS).alias("robots")).distinct()
    return R.disallowed_paths(urls, R.disallow_rules(robots).distinct(), path).select("page_id", "url")


@query(
    "joi13_localized",
    f"""SELECT d.id, d.status, d.trend,
         CASE d.status WHEN 'new' THEN 'New' WHEN 'confirmed' THEN 'Confirmed' ELSE d.status END AS label,
         CASE c WHEN '职业发展' THEN 'Career Development' ELSE c END AS category_label
        FROM demands d JOIN (SELECT p_partkey AS id, coalesce({_MIXED_CATEGORY}, '-') AS c FROM part) m ON m.id = d.id""",
)
def localized(s: Store) -> DataFrame:
    labels = dims.labels(s.spark)
    cats = s.raw("part").select(F.col("p_partkey").alias("id"), F.coalesce(F.expr(_MIXED_CATEGORY), F.lit("-")).alias("c"))
    named = L.localized(cats, labels, "category", "c", "en").select("id", F.col("label").alias("category_label"))
    rows = s.demands.select("id", "status", "trend").join(named, "id")
    return L.localized(rows, labels, "status", "status", "en")


@query(
    "joi15_article_comments",
    """SELECT c.id, c.article_id, c.commenter, c.like_count FROM hot_comments c
       WHERE NOT c.is_analyzed AND c.article_id IN (SELECT id FROM articles WHERE NOT is_analyzed)""",
)
def article_comments(s: Store) -> DataFrame:
    waiting = s.articles.where(~F.col("is_analyzed"))
    return R.article_comments(waiting, s.hot_comments).select("id", "article_id", "commenter", "like_count")


@query(
    "joi16_comment_digest",
    """SELECT article_id, count(*) AS n_comments,
       string_agg(concat('[', coalesce(nullif(commenter, ''), '匿名'), '] (👍', like_count, '): ', content), chr(10) ORDER BY id) AS comments
       FROM hot_comments GROUP BY article_id""",
)
def comment_digest(s: Store) -> DataFrame:
    return R.comment_digest(s.hot_comments)


@query(
    "joi17_orphans",
    """SELECT 'comment' AS child, article_id AS missing_id FROM hot_comments c WHERE NOT EXISTS (SELECT 1 FROM (SELECT id FROM articles WHERE NOT is_analyzed) a WHERE a.id = c.article_id)
       UNION ALL SELECT 'link', demand_id FROM article_demand_relations l WHERE NOT EXISTS (SELECT 1 FROM (SELECT id FROM demands WHERE trend <> 'declining') d WHERE d.id = l.demand_id)
       UNION ALL SELECT 'edge', demand_id_b FROM demand_relations e WHERE NOT EXISTS (SELECT 1 FROM demands d WHERE d.id = e.demand_id_b)
       UNION ALL SELECT 'snapshot', demand_id FROM trend_snapshots t WHERE NOT EXISTS (SELECT 1 FROM (SELECT id FROM demands WHERE trend <> 'declining') d WHERE d.id = t.demand_id)""",
)
def orphans(s: Store) -> DataFrame:
    kept_articles = s.articles.where("NOT is_analyzed").select("id")
    kept_demands = s.demands.where("trend <> 'declining'").select("id")
    return (
        R.orphans(s.hot_comments, "article_id", kept_articles, "comment")
        .unionByName(R.orphans(s.article_demand_relations, "demand_id", kept_demands, "link"))
        .unionByName(R.orphans(s.demand_relations, "demand_id_b", s.demands.select("id"), "edge"))
        .unionByName(R.orphans(s.trend_snapshots, "demand_id", kept_demands, "snapshot"))
    )


# --- statistics ------------------------------------------------------------


@query(
    "agg01_article_stats",
    """SELECT count(*) AS total, count(*) FILTER (is_analyzed) AS analyzed,
       count(*) FILTER (NOT is_analyzed) AS unanalyzed FROM articles""",
)
def article_stats(s: Store) -> DataFrame:
    return A.article_stats(s.articles)


@query("agg02_by_platform", "SELECT platform, count(*) AS articles FROM articles GROUP BY platform")
def by_platform(s: Store) -> DataFrame:
    return A.by_platform(s.articles)


@query(
    "agg03_by_date",
    "SELECT CAST(crawl_time AS DATE) AS crawl_date, count(*) AS articles FROM articles GROUP BY 1 ORDER BY 1 DESC LIMIT 30",
)
def by_date(s: Store) -> DataFrame:
    return A.by_date(s.articles)


@query(
    "agg04_category_counts",
    'SELECT category AS name, count(*) AS "count" FROM demands WHERE category IS NOT NULL GROUP BY 1',
)
def category_counts(s: Store) -> DataFrame:
    return A.category_counts(s.demands)


@query(
    "agg05_category_dist",
    """SELECT category AS name, count(*) AS "count", round(count(*) / (SELECT count(*) FROM demands) * 100, 1) AS percentage
       FROM demands WHERE category IS NOT NULL GROUP BY 1""",
)
def category_dist(s: Store) -> DataFrame:
    return A.category_dist(s.demands)


_TAGS = "SELECT unnest(CAST(CAST(tags AS JSON) AS VARCHAR[])) AS tag FROM demands WHERE json_valid(tags)"
_TAG_COUNTS = f'(SELECT tag, count(*) AS "count" FROM ({_TAGS}) GROUP BY tag)'


@query("agg06_tag_counts", f"SELECT * FROM {_TAG_COUNTS}")
def tag_counts(s: Store) -> DataFrame:
    return A.tag_counts(s.demands)


@query(
    "agg07_overview",
    f"""SELECT (SELECT count(*) FROM articles) AS total_articles, (SELECT count(*) FROM demands) AS total_demands,
        (SELECT count(*) FROM demands WHERE first_seen >= {AS_OF} - INTERVAL 7 DAY) AS week_new_demands,
        (SELECT round(count(*) FILTER (is_analyzed) / count(*) * 100, 1) FROM articles) AS analysis_rate""",
)
def overview(s: Store) -> DataFrame:
    return A.overview(s.articles, s.demands, s.as_of)


_CATEGORY_SUMMARY = """SELECT coalesce(nullif(category, ''), '未分类') AS category, count(*) AS "count",
    printf('%.1f%%', round(count(*) / (SELECT count(*) FROM demands) * 100.0, 1)) AS pct,
    round(avg(frequency), 1) AS avg_frequency, round(avg(importance_score), 2) AS avg_importance FROM demands GROUP BY 1
    UNION ALL SELECT '合计', count(*), '100%', NULL, NULL FROM demands"""


@query("agg08_category_summary", _CATEGORY_SUMMARY)
def category_summary(s: Store) -> DataFrame:
    return A.category_summary(s.demands)


@query(
    "agg09_category_pct_report",
    """SELECT coalesce(nullif(category, ''), '未分类') AS category, count(*) AS "count",
       printf('%.1f%%', round(count(*) / (SELECT count(*) FROM demands) * 100.0, 1)) AS pct FROM demands GROUP BY 1""",
)
def category_pct_report(s: Store) -> DataFrame:
    return A.category_pct_report(s.demands)


@query(
    "agg10_daily_new_demands",
    f"""SELECT CAST(g.day AS DATE) AS day, count(d.id) AS new_demands
        FROM generate_series(CAST({AS_OF} AS DATE) - INTERVAL 6 DAY, CAST({AS_OF} AS DATE), INTERVAL 1 DAY) g(day)
        LEFT JOIN demands d ON CAST(d.first_seen AS DATE) = CAST(g.day AS DATE) GROUP BY 1""",
)
def daily_new_demands(s: Store) -> DataFrame:
    return A.daily_new_demands(s.demands, s.as_of)


@query(
    "agg11_run_summary",
    """SELECT platform, status, count(*) AS runs, CAST(sum(articles_found) AS BIGINT) AS found,
       CAST(sum(articles_new) AS BIGINT) AS "new" FROM crawl_logs GROUP BY 1, 2""",
)
def run_summary(s: Store) -> DataFrame:
    return A.run_summary(s.crawl_logs)


@query(
    "agg14_token_usage",
    """SELECT user_id % 12 AS run_id, count(*) AS calls, CAST(sum(floor(value) + event_id % 100) AS BIGINT) AS total_tokens
       FROM events GROUP BY 1""",
)
def token_usage(s: Store) -> DataFrame:
    calls = s.raw("events").select(
        (F.col("user_id") % 12).alias("run_id"),
        F.floor("value").cast("bigint").alias("input_tokens"),
        (F.col("event_id") % 100).alias("output_tokens"),
    )
    return A.token_usage(calls)


@query(
    "agg16_health_overview",
    """SELECT c.platform, c.start_time AS last_crawl, c.status, c.articles_found,
         (SELECT count(*) FROM articles) AS total_articles, (SELECT count(*) FROM demands) AS total_demands
       FROM crawl_logs c JOIN (SELECT platform, max(start_time) AS m FROM crawl_logs GROUP BY 1) x
       ON x.platform = c.platform AND x.m = c.start_time""",
)
def health_overview(s: Store) -> DataFrame:
    return A.health_overview(s.articles, s.demands, s.crawl_logs)


@query(
    "win06_tag_size",
    f"""SELECT tag, "count", round(0.75 + CASE WHEN hi = lo THEN 1.0 ELSE ("count" - lo) / (hi - lo) END * 1.5, 6) AS size
        FROM {_TAG_COUNTS}, (SELECT greatest(max("count"), 1)::DOUBLE AS hi, least(min("count"), 1)::DOUBLE AS lo FROM {_TAG_COUNTS})""",
)
def tag_size(s: Store) -> DataFrame:
    return A.tag_size(A.tag_counts(s.demands))


# --- listings --------------------------------------------------------------


@query(
    "sor01_page_articles",
    """SELECT id, title, platform, heat_score, publish_time, (SELECT count(*) FROM articles) AS total
       FROM articles ORDER BY publish_time DESC NULLS LAST, id LIMIT 20 OFFSET 40""",
)
def page_articles(s: Store) -> DataFrame:
    total, rows = L.page(s.articles, "publish_time", number=3, allowed=L.ARTICLE_SORTS)
    return rows.select("id", "title", "platform", "heat_score", "publish_time", total.scalar().alias("total"))


@query(
    "sor02_page_demands",
    """SELECT id, title, frequency, (SELECT count(*) FROM demands WHERE trend = 'stable') AS total
       FROM demands WHERE trend = 'stable' ORDER BY title ASC NULLS FIRST, id LIMIT 100""",
)
def page_demands(s: Store) -> DataFrame:
    rows = L.filter_demands(s.demands, trend="stable")
    total, top = L.page(rows, "title", descending=False, size=100, allowed=L.DEMAND_SORTS)
    return top.select("id", "title", "frequency", total.scalar().alias("total"))


@query(
    "sor03_page_logs",
    """SELECT id, platform, start_time, status, (SELECT count(*) FROM crawl_logs) AS total
       FROM crawl_logs ORDER BY start_time DESC NULLS LAST, id LIMIT 20 OFFSET 20""",
)
def page_logs(s: Store) -> DataFrame:
    total, rows = L.page(s.crawl_logs, "start_time", number=2)
    return rows.select("id", "platform", "start_time", "status", total.scalar().alias("total"))


_SEARCH_A = """SELECT 'article' AS type, id, title, coalesce(nullif(summary, ''), nullif(substr(content, 1, 200), '')) AS snippet, platform
  FROM articles WHERE title ILIKE '%tion%' OR content ILIKE '%tion%' ORDER BY id LIMIT 50"""
_SEARCH_D = """SELECT 'demand' AS type, id, title, description AS snippet, NULL::VARCHAR AS platform
  FROM demands WHERE title ILIKE '%tion%' OR description ILIKE '%tion%' ORDER BY id LIMIT 50"""


@query("sor04_search_top", f"SELECT * FROM ({_SEARCH_A}) UNION ALL SELECT * FROM ({_SEARCH_D})")
def search_top(s: Store) -> DataFrame:
    return L.search(s.articles, s.demands, "TION")


@query(
    "set06_search_union",
    'SELECT * FROM ('
    + _SEARCH_A.replace("%tion%", "%red%")
    + ") UNION ALL SELECT * FROM ("
    + _SEARCH_D.replace("%tion%", "%red%")
    + ")",
)
def search_union(s: Store) -> DataFrame:
    return L.search(s.articles, s.demands, "red")


@query("sor05_recent_demands", "SELECT id, title, first_seen FROM demands ORDER BY first_seen DESC, id LIMIT 10")
def recent_demands(s: Store) -> DataFrame:
    return L.top_rows(s.demands, "first_seen").select("id", "title", "first_seen")


_RISING_TOP = "SELECT id, title, frequency FROM demands WHERE trend = 'rising' ORDER BY frequency DESC, id LIMIT 10"


@query("sor06_trending_top", _RISING_TOP)
def trending_top(s: Store) -> DataFrame:
    return L.top_rows(s.demands.where("trend = 'rising'"), "frequency").select("id", "title", "frequency")


@query("win01_rank_rows", f"SELECT *, row_number() OVER (ORDER BY frequency DESC, id) AS rank FROM ({_RISING_TOP})")
def rank_rows(s: Store) -> DataFrame:
    return L.ranked_top(s.demands.where("trend = 'rising'"), "frequency").select("id", "title", "frequency", "rank")


@query(
    "sor07_hot_articles",
    f"""SELECT id, title, platform, heat_score FROM articles WHERE crawl_time >= {ARTICLES_AS_OF} - INTERVAL 7 DAY
        ORDER BY heat_score DESC, id LIMIT 10""",
)
def hot_articles(s: Store) -> DataFrame:
    return L.hot_articles(s.articles, s.articles_as_of).select("id", "title", "platform", "heat_score")


@query(
    "sor08_hot_comments_top",
    """SELECT id, article_id, like_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY article_id
       ORDER BY like_count DESC, id) AS rank FROM hot_comments) WHERE rank <= 3""",
)
def hot_comments_top(s: Store) -> DataFrame:
    return L.top_comments(s.hot_comments, 3).select("id", "article_id", "like_count", "rank")


@query(
    "sor11_latest_report",
    """SELECT arg_max(content, report_date) AS content, CAST(max(report_date) AS VARCHAR) AS generated_at FROM
       (SELECT CAST(date_trunc('week', start_time) AS DATE) AS report_date, concat('runs: ', count(*)) AS content FROM crawl_logs GROUP BY 1)""",
)
def latest_report(s: Store) -> DataFrame:
    weekly = s.crawl_logs.groupBy(F.to_date(F.date_trunc("week", "start_time")).alias("report_date")).agg(
        F.concat(F.lit("runs: "), F.count(F.lit(1)).cast("string")).alias("content")
    )
    return L.latest_report(weekly)


# --- set shapes ------------------------------------------------------------


@query("set02_distinct_dates", "SELECT DISTINCT snapshot_date FROM trend_snapshots")
def distinct_dates(s: Store) -> DataFrame:
    return s.trend_snapshots.select("snapshot_date").distinct()


@query(
    "set03_tag_union",
    """SELECT a.id, array_to_string(list_sort(list_distinct(list_concat(
         coalesce(CASE WHEN json_valid(a.tags) THEN CAST(CAST(a.tags AS JSON) AS VARCHAR[]) END, []),
         coalesce(CASE WHEN json_valid(b.tags) THEN CAST(CAST(b.tags AS JSON) AS VARCHAR[]) END, [])))), ',') AS tags
       FROM demands a JOIN demands b ON b.id = a.id + 1""",
)
def tag_union(s: Store) -> DataFrame:
    empty = F.array().cast("array<string>")
    own = s.demands.select("id", F.coalesce(S.json_list("tags"), empty).alias("mine"))
    other = own.select((F.col("id") - 1).alias("id"), F.col("mine").alias("theirs"))
    merged = F.array_sort(F.array_union("mine", "theirs"))
    return own.join(other, "id").select("id", F.array_join(merged, ",").alias("tags"))


@query("set04_minus_known", f"SELECT url FROM {_INCOMING} EXCEPT SELECT url FROM articles")
def minus_known(s: Store) -> DataFrame:
    return R.skip_known(_incoming(s).select("url").distinct(), s.articles, ["url"])


@query(
    "set05_endpoint_union",
    "SELECT demand_id_a AS id FROM demand_relations UNION SELECT demand_id_b FROM demand_relations",
)
def endpoint_union(s: Store) -> DataFrame:
    return R.endpoints(s.demand_relations)


# --- table scans -----------------------------------------------------------


@query(
    "src18_table_scan",
    """SELECT 'articles' AS table_name, count(*) AS n FROM articles UNION ALL SELECT 'demands', count(*) FROM demands
       UNION ALL SELECT 'article_demand_relations', count(*) FROM article_demand_relations
       UNION ALL SELECT 'trend_snapshots', count(*) FROM trend_snapshots
       UNION ALL SELECT 'hot_comments', count(*) FROM hot_comments UNION ALL SELECT 'crawl_logs', count(*) FROM crawl_logs
       UNION ALL SELECT 'demand_relations', count(*) FROM demand_relations""",
)
def table_scan(s: Store) -> DataFrame:
    names = ["articles", "demands", "article_demand_relations", "trend_snapshots", "hot_comments", "crawl_logs", "demand_relations"]
    parts = [getattr(s, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Some articles without a title are bad rows; comments get the platform their table requires.
_SCANNED = {
    "articles": "SELECT * REPLACE (CASE WHEN id % 97 <> 5 THEN title END AS title), NULL::VARCHAR AS raw_html FROM articles",
    "demands": "SELECT *, NULL::VARCHAR AS notes, NULL::VARCHAR AS semantic_vector, 'zh' AS language FROM demands",
    "article_demand_relations": "SELECT *, NULL::VARCHAR AS context_snippet FROM article_demand_relations",
    "hot_comments": "SELECT *, concat('p', article_id % 12) AS platform, NULL::TIMESTAMP AS crawl_time FROM hot_comments",
    "crawl_logs": "SELECT *, NULL::TIMESTAMP AS end_time, NULL::VARCHAR AS error_message FROM crawl_logs",
    "trend_snapshots": "SELECT * FROM trend_snapshots",
    "demand_relations": "SELECT * FROM demand_relations",
}
_SQL_TEXT = {"double": "CAST(CAST(floor({} * 1000000 + 0.5) AS BIGINT) AS VARCHAR)", "timestamp_ntz": "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"}


def _sql_fingerprints() -> str:
    parts = []
    for name, rows in _SCANNED.items():
        bad = " OR ".join(f"{c} IS NULL" for c in schemas.REQUIRED[name])
        for field in schemas.TABLES[name].fields:
            text = _SQL_TEXT.get(field.dataType.simpleString(), "CAST({} AS VARCHAR)").format(field.name)
            parts.append(
                f"""SELECT '{name}' AS table_name, '{field.name}' AS column_name, count(*) AS n_rows, count(*) FILTER (bad) AS n_bad, count(x) FILTER (NOT bad) AS n_values,
                CAST(coalesce(sum(CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) FILTER (NOT bad), 0) AS VARCHAR) AS fingerprint
                FROM (SELECT {text} AS x, {bad} AS bad FROM ({rows}))"""
            )
    return " UNION ALL ".join(parts)


@query("src18_table_fingerprints", _sql_fingerprints())
def table_fingerprints(s: Store) -> DataFrame:
    """Every column of the seven tables, read and fingerprinted over its declared schema."""
    changed = {
        "articles": s.articles.withColumn("title", F.when(F.col("id") % 97 != 5, F.col("title"))),
        "hot_comments": s.hot_comments.withColumn("platform", F.concat(F.lit("p"), (F.col("article_id") % 12).cast("string"))),
    }
    return reduce(DataFrame.unionByName, [fingerprints(changed.get(n, getattr(s, n)), n) for n in _SCANNED])


@query(
    "src20_align_schema",
    """SELECT id, article_id, commenter, like_count, is_analyzed, NULL::VARCHAR AS platform, NULL::TIMESTAMP AS crawl_time FROM
       (SELECT id, article_id, commenter, CAST(0 AS BIGINT) AS like_count, false AS is_analyzed FROM hot_comments)""",
)
def align(s: Store) -> DataFrame:
    old = s.hot_comments.drop("like_count", "is_analyzed")
    new = align_schema(old, schemas.TABLES["hot_comments"], schemas.DEFAULTS["hot_comments"])
    return new.select("id", "article_id", "commenter", "like_count", "is_analyzed", "platform", "crawl_time")
