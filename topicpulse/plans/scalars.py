"""Scalar functions as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse.functions import scalars as S
from topicpulse.functions import text as X
from topicpulse.plans.adapters_sql import register_cte
from topicpulse.plans.registry import query
from topicpulse.sources.tables import SampleStore as Store

_K = "CAST(p_partkey AS STRING)"


@query("sca01_heat_score", "SELECT id, heat_score FROM articles")
def heat_score(s: Store) -> DataFrame:
    return s.articles.select("id", "heat_score")


_COUNT_TEXT = f"""CASE p_partkey % 6 WHEN 0 THEN concat(CAST(p_size AS STRING), '.5万') WHEN 1 THEN concat(CAST(p_size AS STRING), '亿')
 WHEN 2 THEN concat('赞 ', {_K}, ' 次') WHEN 3 THEN '' WHEN 4 THEN concat('x', CAST(p_size AS STRING), '万') ELSE concat({_K}, ',000') END"""


@query(
    "sca02_parse_count",
    f"""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_size * 10000 + 5000 WHEN 1 THEN p_size::BIGINT * 100000000
        WHEN 2 THEN p_partkey WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE p_partkey * 1000 END AS n FROM part""",
)
def parse_count(s: Store) -> DataFrame:
    return s.raw("part").select(F.col("p_partkey").alias("id"), S.parse_count(F.expr(_COUNT_TEXT)).alias("n"))


@query(
    "sca03_parse_datetime",
    """SELECT id, CASE id % 4 WHEN 0 THEN date_trunc('minute', last_seen) WHEN 1 THEN date_trunc('minute', last_seen)
       WHEN 2 THEN CAST(CAST(last_seen AS DATE) AS TIMESTAMP) END AS t FROM demands""",
)
def parse_datetime(s: Store) -> DataFrame:
    i = F.col("id") % 4
    text = (
        F.when(i == 0, F.date_format("last_seen", "yyyy-MM-dd HH:mm"))
        .when(i == 1, F.date_format("last_seen", "MM-dd HH:mm"))
        .when(i == 2, F.date_format("last_seen", "yyyy-MM-dd"))
        .otherwise("yesterday")
    )
    return s.demands.select("id", S.parse_datetime(text, s.as_of).alias("t"))


@query(
    "sca04_epoch_to_ts",
    """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN make_timestamp((1700000000 + p_partkey * 977) * 1000000) END AS from_seconds,
       CASE WHEN p_partkey % 5 < 2 THEN make_timestamp((1700000000123 + p_partkey * 977) * 1000) END AS from_millis FROM part""",
)
def epoch_to_ts(s: Store) -> DataFrame:
    k = F.col("p_partkey")
    sec = F.when(k % 5 == 0, (1_700_000_000 + k * 977).cast("string")).when(k % 5 == 1, "0").when(k % 5 == 2, "").otherwise("soon")
    ms = F.when(k % 5 < 2, (1_700_000_000_123 + k * 977).cast("string")).otherwise("0")
    return s.raw("part").select(
        k.alias("id"), S.epoch_text(sec).alias("from_seconds"), S.epoch_text(ms, millis=True).alias("from_millis")
    )


_URLS = f"""CASE p_partkey % 10 WHEN 0 THEN concat('https://www.36kr.com/p/', {_K}) WHEN 1 THEN concat('https://www.huxiu.com/article/', {_K}, '.html')
 WHEN 2 THEN concat('https://juejin.cn/post/', {_K}) WHEN 3 THEN concat('https://www.zhihu.com/question/9/answer/', {_K})
 WHEN 4 THEN concat('https://www.toutiao.com/i/', {_K}, '/') WHEN 5 THEN concat('https://www.bilibili.com/read/cv', {_K})
 WHEN 6 THEN concat('https://maimai.cn/gossip_detail?gid=', {_K}, '&x=1') WHEN 7 THEN concat('https://maimai.cn/web/', {_K}, '/tail')
 WHEN 8 THEN concat('https://www.xiaohongshu.com/explore/a', {_K}, '/') ELSE {_K} END"""


@query(
    "sca05_id_from_url",
    """SELECT p_partkey AS id, CASE WHEN m = 0 THEN k END AS kr36, CASE WHEN m = 1 THEN k WHEN m = 4 THEN NULL END AS huxiu, CASE WHEN m = 2 THEN k END AS juejin,
       CASE WHEN m = 3 THEN k END AS zhihu_answer, CASE WHEN m = 3 THEN '9' END AS zhihu_question,
       CASE WHEN m IN (1, 4) THEN k END AS toutiao, CASE WHEN m IN (5, 9) THEN k END AS bilibili,
       CASE WHEN m = 5 OR m = 8 OR m = 1 THEN NULL ELSE k END AS maimai,
       CASE m WHEN 0 THEN k WHEN 1 THEN concat(k, '.html') WHEN 2 THEN k WHEN 3 THEN k WHEN 4 THEN k WHEN 5 THEN concat('cv', k)
         WHEN 6 THEN concat('gossip_detail?gid=', k, '&x=1') WHEN 7 THEN 'tail' WHEN 8 THEN concat('a', k) ELSE k END AS xiaohongshu
       FROM (SELECT p_partkey, p_partkey % 10 AS m, CAST(p_partkey AS VARCHAR) AS k FROM part)""",
)
def id_from_url(s: Store) -> DataFrame:
    u = s.raw("part").select(F.col("p_partkey").alias("id"), F.expr(_URLS).alias("u"))
    names = [*S.URL_ID_PATTERNS, "bilibili", "maimai", "xiaohongshu"]
    return u.select("id", *[S.id_from_url("u", n).alias(n) for n in names])


@query(
    "sca06_absolute_url",
    """SELECT page_id, CASE WHEN r LIKE 'http%' THEN r WHEN r LIKE '/%' THEN concat('https://h.example', r) ELSE concat('https://h.example/p/', page_id) END AS url
       FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) ELSE concat('p', page_id) END AS r FROM pages)""",
)
def absolute_url(s: Store) -> DataFrame:
    k = F.col("page_id")
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*(.*)$", 1)
    raw = F.when(k % 3 == 0, F.col("url")).when(k % 3 == 1, path).otherwise(F.concat(F.lit("p"), k.cast("string")))
    other = F.concat(F.lit("https://h.example/p/"), k.cast("string"))
    return s.raw("pages").select("page_id", S.absolute_url(raw, "https://h.example", other).alias("url"))


@query(
    "sca07_make_summary",
    """SELECT id, coalesce(nullif(summary, ''), substr(content, 1, 200)) AS plain, coalesce(nullif(summary, ''),
       CASE WHEN length(content) > 200 THEN concat(substr(content, 1, 200), '...') ELSE content END) AS dotted FROM articles""",
)
def make_summary(s: Store) -> DataFrame:
    given = F.col("summary")
    return s.articles.select(
        "id", S.make_summary("content", given).alias("plain"), S.make_summary("content", given, ellipsis=True).alias("dotted")
    )


@query("sca08_url_key", "SELECT page_id, md5(url) AS platform_id FROM pages")
def url_key(s: Store) -> DataFrame:
    return s.raw("pages").select("page_id", S.url_key("url").alias("platform_id"))


_MARKDOWN = """concat('# ', substr(text, 1, 40), chr(10), chr(10), '> quoted', chr(10), '```py', chr(10), 'x = 1', chr(10), '```', chr(10),
 '![pic](http://i/', CAST(doc_id AS STRING), '.png) see [link ', lang, '](http://l/x) and `code` **bold ', source, '** _it_', chr(10), '---', chr(10), chr(10), chr(10), text)"""
register_cte("markdown_docs", f"SELECT doc_id, {_MARKDOWN} AS md FROM documents")


def sql_chain(column: str, rules: list[tuple[str, str]]) -> str:
    """Nested DuckDB replacements; RE2 spells groups with a backslash."""
    out = column
    for pattern, to in rules:
        shown = pattern.replace("'", "''")
        target = to.replace("$1", "\\1").replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{shown}', '{target}', 'g')"
    return out


@query(
    "sca09_markdown_to_text",
    f"SELECT doc_id, regexp_replace({sql_chain('md', [r[:2] for r in X.MARKDOWN_RULES])}, '\\A\\s+|\\s+\\z', '', 'g') AS text FROM markdown_docs",
)
def markdown_to_text(s: Store) -> DataFrame:
    docs = s.spread("documents", "doc_id").select("doc_id", F.expr(_MARKDOWN).alias("md"))
    return docs.select("doc_id", X.markdown_to_text(F.col("md")).alias("text"))


_LIST = "CASE WHEN json_valid(tags) THEN CAST(CAST(tags AS JSON) AS VARCHAR[]) END"


@query("sca10_tags_text", f"SELECT id, coalesce(array_to_string({_LIST}, ', '), tags, '') AS tags FROM demands")
def tags_text(s: Store) -> DataFrame:
    return s.demands.select("id", S.tags_text("tags").alias("tags"))


_MIXED_TAGS = "CASE id % 4 WHEN 0 THEN tags WHEN 1 THEN concat(' ', trend, ' , ,', status, ',') WHEN 2 THEN '[\"broken' ELSE tags END"


@query(
    "sca11_tags_array",
    f"""SELECT id, array_to_string(CASE WHEN t IS NULL THEN [] WHEN json_valid(t) THEN CAST(CAST(t AS JSON) AS VARCHAR[])
        ELSE list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') END, '|') AS tags
        FROM (SELECT id, {_MIXED_TAGS} AS t FROM demands)""",
)
def tags_array(s: Store) -> DataFrame:
    d = s.demands.select("id", F.expr(_MIXED_TAGS).alias("t"))
    return d.select("id", F.array_join(S.tags_array("t"), "|").alias("tags"))


@query(
    "sca12_clamp_score",
    "SELECT id, greatest(0.0::DOUBLE, least(10.0::DOUBLE, importance_score * 3 - 5)) AS score FROM demands",
)
def clamp_score(s: Store) -> DataFrame:
    return s.demands.select("id", S.clamp_score(F.col("importance_score") * 3 - 5).alias("score"))


@query("sca13_pct_text", "SELECT id, printf('%.1f%%', round(frequency / 20 * 100.0, 1)) AS pct FROM demands")
def pct_text(s: Store) -> DataFrame:
    return s.demands.select("id", S.pct_text(F.col("frequency"), F.lit(20)).alias("pct"))


@query("sca15_text_prefix", "SELECT id, substr(content, 1, 200) AS snippet FROM articles")
def text_prefix(s: Store) -> DataFrame:
    return s.articles.select("id", S.text_prefix("content").alias("snippet"))
