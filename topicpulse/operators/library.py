"""Reading the library: filters, listings and searches over stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from topicpulse import dims
from topicpulse.functions import scalars as S

ARTICLE_SORTS = ("crawl_time", "heat_score", "publish_time", "title")
DEMAND_SORTS = ("importance_score", "frequency", "first_seen", "last_seen", "title")

# Texts that mark a verification page.
CAPTCHA_MARKS = [
    "验证码",
    "captcha",
    "安全验证",
    r"slide[\s_-]?verif",
    "滑动验证",
    "请完成安全验证",
    "人机验证",
    "点击验证",
    "图形验证",
    "请输入验证码",
    r"security[\s_-]?check",
    r"robot[\s_-]?check",
    r"are[\s_-]?you[\s_-]?human",
    "recaptcha",
    "hcaptcha",
    "cf-challenge",
    "challenge-platform",
    "turnstile",
]


# --- predicates -----------------------------------------------------------


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def keyword_relevant(title: Column, summary: Column, keywords: list[str] | None = None) -> Column:
    """Any keyword occurs in the lower-cased title and summary."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))
    words = dims.TOPIC_KEYWORDS if keywords is None else keywords
    return S.bind(text, lambda t: reduce(lambda a, w: a | t.contains(w.lower()), words, F.lit(False)))


def filter_articles(
    articles: DataFrame,
    platform: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Platform and crawl-time bounds; a date-only upper bound means its midnight."""
    tests: list[Column] = []
    if platform:
        tests.append(F.col("platform") == platform)
    if date_from:
        tests.append(F.col("crawl_time") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        tests.append(F.col("crawl_time") <= F.lit(date_to).cast("timestamp_ntz"))
    return articles.where(_all(tests))


def filter_demands(
    demands: DataFrame,
    category: str | None = None,
    status: str | None = None,
    trend: str | None = None,
    q: str | None = None,
) -> DataFrame:
    tests = [F.col(c) == v for c, v in (("category", category), ("status", status), ("trend", trend)) if v]
    if q:
        tests.append(_ilike_any(q, "title", "description"))
    return demands.where(_all(tests))


def _ilike_any(q: str, *columns: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` of the caller stay wildcards."""
    pattern = "%" + q.replace("\\", "\\\\") + "%"
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.col(name).ilike(pattern), F.lit(False))
    return hit


def filter_library(
    demands: DataFrame,
    equal: dict[str, str] | None = None,
    min_frequency: int | None = None,
    min_importance: float | None = None,
) -> DataFrame:
    tests = [F.col(c) == v for c, v in (equal or {}).items()]
    if min_frequency is not None:
        tests.append(F.col("frequency") >= min_frequency)
    if min_importance is not None:
        tests.append(F.col("importance_score") >= min_importance)
    return demands.where(_all(tests))


def rising(demands: DataFrame) -> DataFrame:
    return demands.where(F.col("trend") == "rising").orderBy(F.desc("frequency"), "id")


def emerging(demands: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """First seen inside the window and important."""
    since = as_of - F.make_dt_interval(F.lit(days))
    return demands.where((F.col("first_seen") >= since) & (F.col("importance_score") > 5))


def captcha_page(html: Column) -> Column:
    return html.rlike("(?i)" + "|".join(CAPTCHA_MARKS))


def host_contains(url: Column, domain: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).contains(domain), F.lit(False))


def unanalyzed_batch(articles: DataFrame, limit: int = 50) -> DataFrame:
    """Newest articles still waiting for analysis."""
    return articles.where(~F.col("is_analyzed")).orderBy(F.desc("crawl_time"), "id").limit(limit)


def enabled_only(rows: DataFrame, platforms: DataFrame) -> DataFrame:
    """Rows of switched-on platforms; the dimension has one row per known platform."""
    on = platforms.where("enabled").select("platform")
    return rows.join(on, "platform", "left_semi")


def high_importance(demands: DataFrame, above: float = 8.0) -> DataFrame:
    return demands.where(F.col("importance_score") > above)


def with_tag(demands: DataFrame, tag: str) -> DataFrame:
    return demands.where(F.coalesce(F.array_contains(S.json_list("tags"), tag), F.lit(False)))


def valid_category(category: Column) -> Column:
    """The category itself when known (after trimming), else the fallback."""
    trimmed = F.trim(category)
    return F.when(trimmed.isin(dims.VALID_CATEGORIES), trimmed).otherwise(dims.FALLBACK_CATEGORY)


# --- listings -------------------------------------------------------------


def page(
    rows: DataFrame,
    sort_by: str,
    descending: bool = True,
    number: int = 1,
    size: int = 20,
    allowed: tuple[str, ...] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(total, page)``: the row count before paging and one sorted page.

    NULLs sort lowest. Both frames are lazy; the page is a top-k, so nothing is
    fully sorted.
    """
    if allowed and sort_by not in allowed:
        raise ValueError(f"cannot sort by {sort_by}")
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page must be >= 1 and size within 1..100")
    key = F.desc_nulls_last(sort_by) if descending else F.asc_nulls_first(sort_by)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return total, rows.orderBy(key, "id").offset((number - 1) * size).limit(size)


def search(articles: DataFrame, demands: DataFrame, q: str, per_kind: int = 50) -> DataFrame:
    """At most ``per_kind`` articles then demands whose text contains ``q``."""
    head = S.text_prefix("content")
    a = (
        articles.where(_ilike_any(q, "title", "content"))
        .orderBy("id")
        .limit(per_kind)
        .select(
            F.lit("article").alias("type"),
            "id",
            "title",
            F.coalesce(S.blank_to_null("summary"), S.blank_to_null(head)).alias("snippet"),
            "platform",
        )
    )
    d = (
        demands.where(_ilike_any(q, "title", "description"))
        .orderBy("id")
        .limit(per_kind)
        .select(
            F.lit("demand").alias("type"),
            "id",
            "title",
            F.col("description").alias("snippet"),
            F.lit(None).cast("string").alias("platform"),
        )
    )
    return a.unionByName(d)


def top_rows(rows: DataFrame, by: str, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(by), "id").limit(n)


def ranked_top(rows: DataFrame, by: str, n: int = 10) -> DataFrame:
    """Top ``n`` with a 1-based rank; only the ``n`` rows are ranked."""
    order = W.orderBy(F.desc_nulls_last(by), F.col("id"))
    return top_rows(rows, by, n).withColumn("rank", F.row_number().over(order).cast("bigint"))


def hot_articles(articles: DataFrame, as_of: Column, days: int = 7, n: int = 10) -> DataFrame:
    since = as_of - F.make_dt_interval(F.lit(days))
    return top_rows(articles.where(F.col("crawl_time") >= since), "heat_score", n)


def top_comments(comments: DataFrame, n: int = 20) -> DataFrame:
    """Best-liked comments per article; the rank filter prunes before the shuffle."""
    order = W.partitionBy("article_id").orderBy(F.desc("like_count"), F.col("id"))
    ranked = comments.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= n)


def latest_report(reports: DataFrame, missing: str = "No weekly report available yet.") -> DataFrame:
    """Newest report by its date key, or a placeholder row."""
    newest = reports.agg(F.max_by("content", "report_date").alias("content"), F.max("report_date").alias("d"))
    return newest.select(
        F.coalesce("content", F.lit(missing)).alias("content"),
        F.coalesce(F.col("d").cast("string"), F.lit("")).alias("generated_at"),
    )


def localized(rows: DataFrame, labels: DataFrame, domain: str, key: str, lang: str) -> DataFrame:
    """Add ``label``: the name of ``key`` in ``lang``, or the key itself."""
    names = labels.where((F.col("domain") == domain) & (F.col("lang") == lang)).select(
        F.col("key").alias("_key"), F.col("label").alias("_label")
    )
    joined = rows.join(names, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("label", F.coalesce("_label", key)).drop("_key", "_label")
