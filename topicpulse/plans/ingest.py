"""Ingest operators as named queries: first seen, streaks, limits, upserts, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse.operators import ingest as I
from topicpulse.operators import relations as R
from topicpulse.plans.registry import query
from topicpulse.sources.tables import SampleStore as Store


@query(
    "set01_union_sources",
    """SELECT 'article' AS kind, id, title, platform, url FROM articles
       UNION ALL SELECT 'page', page_id, NULL, NULL, url FROM pages
       UNION ALL SELECT 'demand', id, title, NULL, NULL FROM demands""",
)
def union_sources(s: Store) -> DataFrame:
    return I.union_sources(
        [
            s.articles.select(F.lit("article").alias("kind"), "id", "title", "platform", "url"),
            s.raw("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url"),
            s.demands.select(F.lit("demand").alias("kind"), "id", "title"),
        ]
    )


@query(
    "win02_failure_streak",
    """SELECT id, platform, CAST(count(*) FILTER (status <> 'completed') OVER (PARTITION BY platform, island ORDER BY start_time, id
         ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak,
       count(*) FILTER (status <> 'completed') OVER (PARTITION BY platform, island ORDER BY start_time, id ROWS UNBOUNDED PRECEDING) >= 5 AS blocked
       FROM (SELECT *, sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) OVER (PARTITION BY platform ORDER BY start_time, id
         ROWS UNBOUNDED PRECEDING) AS island FROM crawl_logs)""",
)
def failure_streak(s: Store) -> DataFrame:
    return I.failure_streaks(s.crawl_logs, F.col("status") != "completed").select("id", "platform", "streak", "blocked")


@query(
    "win03_last_completed_position",
    """SELECT platform, last_position FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY start_time DESC, id) AS n
       FROM crawl_logs WHERE status = 'completed') WHERE n = 1""",
)
def last_completed_position(s: Store) -> DataFrame:
    return I.last_completed_position(s.crawl_logs)


@query(
    "win04_first_seen_wins",
    """SELECT id, platform, platform_id FROM (SELECT *, row_number() OVER (PARTITION BY platform, platform_id ORDER BY id) AS n
       FROM articles) WHERE n = 1""",
)
def first_seen_wins(s: Store) -> DataFrame:
    return I.first_seen_wins(s.articles, ["platform", "platform_id"], ["id"]).select("id", "platform", "platform_id")


_DETAIL_SQL = """SELECT url, CASE WHEN id % 4 = 0 THEN NULL ELSE content END AS content,
  CASE WHEN id % 3 = 0 THEN view_count + 5 END AS view_count, id % 6 = 0 AS has_view_count,
  CASE WHEN id % 5 = 0 THEN 'detail' END AS summary FROM articles WHERE is_analyzed"""


@query(
    "src19_merge_list_detail",
    f"""SELECT id, platform, summary, view_count, md5(content) AS content_key, round(30.0::DOUBLE * ln(1 + v) / ln(1000001) + 40.0::DOUBLE * ln(1 + like_count) / ln(100001)
          + 20.0::DOUBLE * ln(1 + comment_count) / ln(10001) + 10.0::DOUBLE * ln(1 + share_count) / ln(50001), 2) AS heat_score FROM
        (SELECT *, coalesce(view_count, 0) AS v FROM
          (SELECT a.id, coalesce(a.platform, 'unknown') AS platform, coalesce(d.summary, a.summary) AS summary,
             CASE WHEN d.has_view_count THEN d.view_count ELSE coalesce(d.view_count, a.view_count) END AS view_count,
             d.content, a.like_count, a.comment_count, a.share_count FROM articles a LEFT JOIN ({_DETAIL_SQL}) d ON d.url = a.url))""",
)
def merge_list_detail(s: Store) -> DataFrame:
    i = F.col("id")
    listed = s.articles.drop("content", "heat_score")
    detail = s.articles.where("is_analyzed").select(
        "url",
        F.when(i % 4 != 0, F.col("content")).alias("content"),
        F.when(i % 3 == 0, F.col("view_count") + 5).alias("view_count"),
        (i % 6 == 0).alias("has_view_count"),
        F.when(i % 5 == 0, "detail").alias("summary"),
    )
    merged = I.merge_list_detail(listed, detail)
    return merged.select("id", "platform", "summary", "view_count", F.md5("content").alias("content_key"), "heat_score")


@query(
    "sor10_run_limit",
    """SELECT id, platform FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY id) AS n FROM
       (SELECT * FROM articles a WHERE NOT is_analyzed AND NOT EXISTS (SELECT 1 FROM articles b WHERE b.is_analyzed
         AND b.platform = a.platform AND b.url = a.url))) WHERE n <= 7""",
)
def run_limit(s: Store) -> DataFrame:
    stored, listed = s.articles.where("is_analyzed"), s.articles.where("NOT is_analyzed")
    fresh = R.skip_known(listed.select("id", "platform", "url"), stored, ["platform", "url"])
    return I.run_limit(fresh, 7, ["id"]).select("id", "platform")


# Stored rows have unique keys; the batch repeats some and adds others.
_STORED = """(SELECT id, platform, platform_id, title, author, view_count FROM (SELECT *, row_number() OVER (PARTITION BY platform, platform_id ORDER BY id) AS n
  FROM articles) WHERE n = 1 AND is_analyzed)"""
_BATCH = """(SELECT id + 1000000 AS id, platform, CASE WHEN id % 10 = 1 THEN NULL ELSE platform_id END AS platform_id, concat(title, '!') AS title,
  CASE WHEN id % 3 = 0 THEN concat(author, '2') END AS author, view_count + 1 AS view_count, id AS ord FROM articles)"""


def _stored_and_batch(s: Store) -> tuple[DataFrame, DataFrame]:
    i = F.col("id")
    cols = ["id", "platform", "platform_id", "title", "author", "view_count"]
    stored = I.first_seen_wins(s.articles, ["platform", "platform_id"], ["id"]).where("is_analyzed").select(*cols)
    batch = s.articles.select(
        (i + 1_000_000).alias("id"),
        "platform",
        F.when(i % 10 != 1, F.col("platform_id")).alias("platform_id"),
        F.concat("title", F.lit("!")).alias("title"),
        F.when(i % 3 == 0, F.concat("author", F.lit("2"))).alias("author"),
        (F.col("view_count") + 1).alias("view_count"),
        i.alias("ord"),
    )
    return stored, batch


@query(
    "ups01_upsert_articles",
    f"""WITH s AS {_STORED}, b AS {_BATCH},
        m AS (SELECT platform, platform_id, arg_max(id, ord) AS id, arg_max(title, ord) FILTER (title IS NOT NULL) AS title,
              arg_max(author, ord) FILTER (author IS NOT NULL) AS author, arg_max(view_count, ord) FILTER (view_count IS NOT NULL) AS view_count
              FROM b WHERE platform_id IS NOT NULL GROUP BY 1, 2)
        SELECT coalesce(s.id, m.id) AS id, coalesce(s.platform, m.platform) AS platform, coalesce(s.platform_id, m.platform_id) AS platform_id,
          coalesce(m.title, s.title) AS title, coalesce(m.author, s.author) AS author, coalesce(m.view_count, s.view_count) AS view_count
        FROM s FULL JOIN m ON s.platform = m.platform AND s.platform_id = m.platform_id
        UNION ALL SELECT id, platform, platform_id, title, author, view_count FROM b WHERE platform_id IS NULL""",
)
def upsert_articles(s: Store) -> DataFrame:
    return I.upsert_articles(*_stored_and_batch(s), order="ord")


@query(
    "ups01_upsert_articles_skip",
    f"""WITH s AS {_STORED}, b AS {_BATCH}
        SELECT * FROM s UNION ALL
        SELECT id, platform, platform_id, title, author, view_count FROM (SELECT *, row_number() OVER (PARTITION BY platform, platform_id ORDER BY ord) AS n
          FROM b WHERE platform_id IS NOT NULL) f WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.platform = f.platform AND s.platform_id = f.platform_id)
        UNION ALL SELECT id, platform, platform_id, title, author, view_count FROM b WHERE platform_id IS NULL""",
)
def upsert_articles_skip(s: Store) -> DataFrame:
    return I.upsert_articles(*_stored_and_batch(s), order="ord", mode="skip")


@query(
    "snk08_crawl_log_record",
    """SELECT event_id AS run_id, concat('p', user_id % 12) AS platform, ts AS start_time,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
         CAST(floor(value) AS BIGINT) AS articles_found, CAST(floor(value / 2) AS BIGINT) AS articles_new,
         CASE WHEN event_type = 'error' THEN 'fetch error' END AS error_message, ts + INTERVAL 5 MINUTE AS end_time FROM events""",
)
def crawl_log_record(s: Store) -> DataFrame:
    """Append a start row and an end row per run, then view the latest state."""
    e = s.raw("events")
    platform = F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string"))
    later = F.col("ts") + F.expr("INTERVAL 5 MINUTES")
    failed = F.col("event_type") == "error"
    started = e.select(
        F.col("event_id").alias("run_id"), platform.alias("platform"), F.col("ts").alias("logged_at"), F.lit(1).alias("seq"),
        F.lit("running").alias("status"),
    )
    ended = e.select(
        F.col("event_id").alias("run_id"), platform.alias("platform"), later.alias("logged_at"), F.lit(2).alias("seq"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.floor("value").cast("bigint").alias("articles_found"), F.floor(F.col("value") / 2).cast("bigint").alias("articles_new"),
        F.when(failed, "fetch error").alias("error_message"), later.alias("end_time"),
    )
    return I.run_records(started.unionByName(ended, allowMissingColumns=True))
