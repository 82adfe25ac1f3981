"""Text cleaning as named queries over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse.functions import page_text as P
from topicpulse.functions import text as X
from topicpulse.plans.adapters_sql import register_cte
from topicpulse.plans.registry import query
from topicpulse.plans.scalars import sql_chain
from topicpulse.sources.tables import SampleStore as Store

# Documents with planted promotion and boilerplate lines, whole texts otherwise.
_PROMO = """concat(text, CASE doc_id % 6 WHEN 0 THEN concat(chr(10), '★ 点击关注我们！', chr(10), '扫码领取 资料 123', chr(10), text)
 WHEN 1 THEN concat(chr(10), '  广告  ', chr(10), '下载 APP 看更多内容', chr(10), 'see https://ads.example.com/x?y=1 now @someone_1')
 WHEN 2 THEN concat(chr(10), '版权所有 © 2024 Example Inc', chr(10), 'All Rights Reserved. ', chr(10), '本文来自 somewhere', chr(10), '来源：Daily News')
 WHEN 3 THEN concat(chr(10), '免责声明 anything goes', chr(10), '上一篇：Old story', chr(10), '阅读 原文 here', chr(10), '微博：abc 限时优惠 now')
 ELSE '' END)"""
register_cte("promo_docs", f"SELECT doc_id, lang, source, {_PROMO} AS text FROM documents")


def promo_docs(s: Store) -> DataFrame:
    return s.spread("documents", "doc_id").select("doc_id", "lang", "source", F.expr(_PROMO).alias("text"))


def _sql_rules(patterns: list[str]) -> list[tuple[str, str]]:
    return [(p.replace("(?iu)", "(?i)").replace(r"\u4e00-\u9fff", "一-鿿"), "") for p in patterns]


_SQL_ADS = sql_chain("{}", _sql_rules(X.AD_PATTERNS))
_SQL_BOILER = sql_chain("{}", _sql_rules(X.BOILERPLATE_PATTERNS))


def sql_ads(c: str) -> str:
    return _SQL_ADS.replace("{}", c, 1)


def sql_boiler(c: str) -> str:
    return _SQL_BOILER.replace("{}", c, 1)


def sql_space(c: str) -> str:
    rules = [(r"[^\S\n]+", " "), (" *\\n *", "\n"), ("\\n{3,}", "\n\n"), (r"\A[ \n]+|[ \n]+\z", "")]
    return sql_chain(c, rules)


def sql_html(c: str) -> str:
    shown = f"regexp_replace(coalesce({c}, ''), '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!--.*?-->', '<x>', 'g')"
    lines = f"regexp_replace({shown}, '(?:<[^>]+>)+', chr(10), 'g')"
    lines = f"(CASE WHEN starts_with({c}, '<') THEN substr({lines}, 2) ELSE {lines} END)"
    lines = f"(CASE WHEN ends_with({c}, '>') THEN left({lines}, -1) ELSE {lines} END)"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        lines = f"replace({lines}, '{entity}', '{char}')"
    return lines


@query("txt01_strip_html", f"SELECT page_id, {sql_html('html')} AS text FROM pages")
def strip_html(s: Store) -> DataFrame:
    return s.spread("pages", "page_id").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query("txt02_remove_ads", f"SELECT doc_id, {sql_ads('text')} AS text FROM promo_docs")
def remove_ads(s: Store) -> DataFrame:
    return promo_docs(s).select("doc_id", X.remove_ads(F.col("text")).alias("text"))


@query("txt03_remove_boilerplate", f"SELECT doc_id, {sql_boiler('text')} AS text FROM promo_docs")
def remove_boilerplate(s: Store) -> DataFrame:
    return promo_docs(s).select("doc_id", X.remove_boilerplate(F.col("text")).alias("text"))


@query(
    "txt04_normalize_whitespace",
    f"SELECT doc_id, {sql_space('t')} AS text FROM (SELECT doc_id, concat(chr(9), replace(text, '. ', concat('. ', chr(13), chr(10), ' ', chr(10), chr(10)))) AS t FROM promo_docs)",
)
def normalize_whitespace(s: Store) -> DataFrame:
    rough = F.expr("concat(chr(9), replace(text, '. ', concat('. ', chr(13), chr(10), ' ', chr(10), chr(10))))")
    return promo_docs(s).select("doc_id", X.normalize_whitespace(rough).alias("text"))


register_cte(
    "stage_html", f"SELECT doc_id, lang, source, length(text) AS n0, {sql_html('text')} AS t FROM promo_docs"
)
register_cte("stage_ads", f"SELECT doc_id, lang, source, n0, length(t) AS n1, {sql_ads('t')} AS t FROM stage_html")
register_cte("stage_boiler", f"SELECT doc_id, lang, source, n0, n1, length(t) AS n2, {sql_boiler('t')} AS t FROM stage_ads")
register_cte(
    "stage_clean",
    f"SELECT doc_id, lang, source, n0, n1, n2, length(t) AS n3, {sql_space('t')} AS t FROM stage_boiler",
)


@query("txt05_clean_text", "SELECT doc_id, t AS text FROM stage_clean")
def clean_text(s: Store) -> DataFrame:
    return promo_docs(s).select("doc_id", X.clean_text(F.col("text")).alias("text"))


@query("txt06_main_text")
def main_text(s: Store) -> DataFrame:
    return P.with_main_text(s.raw("pages").select("page_id", "html"), "html", "text").select("page_id", "text")


@query("txt07_page_text")
def page_text(s: Store) -> DataFrame:
    pages = P.with_main_text(s.raw("pages").select("page_id", "html"), "html", "feed_text", "feed")
    return P.with_main_text(pages, "html", "baijiahao_text", "baijiahao").select("page_id", "feed_text", "baijiahao_text")


@query(
    "txt08_strip_tags",
    """SELECT page_id, regexp_replace(t, '\\A\\s+|\\s+\\z', '', 'g') AS bare,
       regexp_replace(regexp_replace(t, '\\A\\s+|\\s+\\z', '', 'g'), '\\s+', ' ', 'g') AS flat
       FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages)""",
)
def strip_tags(s: Store) -> DataFrame:
    html = F.col("html")
    return s.spread("pages", "page_id").select(
        "page_id", X.strip_tags(html).alias("bare"), X.strip_tags(html, collapse=True).alias("flat")
    )


@query(
    "txt09_cleaning_report",
    """SELECT lang, source, count(*) AS docs, CAST(sum(n0 - n1) AS BIGINT) AS html, CAST(sum(n1 - n2) AS BIGINT) AS ads,
       CAST(sum(n2 - n3) AS BIGINT) AS boilerplate, CAST(sum(n3 - length(t)) AS BIGINT) AS space FROM stage_clean GROUP BY 1, 2""",
)
def cleaning_report(s: Store) -> DataFrame:
    """Characters every stage removed, per language and source."""
    stages = X.clean_stages(F.col("text"))
    sized = promo_docs(s)
    names = ["text"]
    for name, _ in stages:
        names.append(name)
    steps = {"html": X.strip_html, "ads": X.remove_ads, "boilerplate": X.remove_boilerplate, "space": X.normalize_whitespace}
    for before, name in zip(names, names[1:]):
        sized = sized.withColumn(name, steps[name](F.col(before)))
    lengths = [F.length(n).alias(n) for n in names]
    removed = [F.sum(F.col(a) - F.col(b)).alias(b) for a, b in zip(names, names[1:])]
    return sized.select("lang", "source", *lengths).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"), *removed)
