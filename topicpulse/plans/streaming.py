"""Streaming jobs as named queries: run over what is available, then read the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicpulse.functions import scalars as S
from topicpulse.plans.registry import query
from topicpulse.session import new_folder
from topicpulse.sources.tables import SampleStore as Store
from topicpulse.sources.tables import crawl_logs_of, first_line
from topicpulse.streaming import jobs as J


def _stream(s: Store, name: str) -> DataFrame:
    return J.read_stream(s.spark, s.folder, f"{name}.parquet")


def _articles(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("p"), (F.col("n_chars") % 12).cast("string")).alias("platform"),
        F.md5("text").alias("platform_id"),
        first_line("text", 60).alias("title"),
        F.col("text").alias("content"),
        S.epoch_seconds(1_704_067_200 + F.col("doc_id") * 3600).alias("crawl_time"),
    )


@query("str01_stream_ingest_dedup", "SELECT DISTINCT platform, platform_id, title, content FROM articles")
def stream_ingest_dedup(s: Store) -> DataFrame:
    return J.run_to_table(J.first_arrivals(_articles(_stream(s, "documents"))).select("platform", "platform_id", "title", "content"))


@query(
    "str02_stream_upsert",
    "SELECT platform, platform_id, any_value(title) AS title, any_value(content) AS content FROM articles GROUP BY platform, platform_id",
)
def stream_upsert(s: Store) -> DataFrame:
    """Four micro-batches, folded after every third one; a batch has more files as the table grows."""
    staged = new_folder(s.spark, "arrivals")
    rows = s.raw("documents")
    files = -(-rows.rdd.getNumPartitions() // 4)
    rows.repartitionByRange(4 * files, "doc_id").write.parquet(staged)
    articles = _articles(J.read_stream(s.spark, staged, files_per_batch=files)).withColumn("ord", F.col("id"))
    columns = "id bigint, platform string, platform_id string, title string, content string, crawl_time timestamp_ntz"
    log = J.ChangeLog(s.spark, new_folder(s.spark, "articles"), columns)
    J.upsert_stream(articles, log, "ord", compact_every=3)
    return log.latest().select("platform", "platform_id", "title", "content")


@query(
    "str03_stream_snapshot",
    """SELECT l_partkey AS demand_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS snapshot_date, count(*) AS frequency FROM lineitem
       WHERE date_trunc('week', l_shipdate) + INTERVAL 7 DAY <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY GROUP BY 1, 2""",
)
def stream_snapshot(s: Store) -> DataFrame:
    mentions = _stream(s, "lineitem").select(F.col("l_partkey").alias("demand_id"), F.col("l_shipdate").alias("seen_at"))
    return J.run_to_table(J.weekly_snapshots(mentions))


# Rows of a staged batch that make a file of their own.
FILE_ROWS = 500_000


def _arrivals(
    s: Store, table: str, time: str, key: str, days: int = 8, late_days: int = 2, file_rows: int = FILE_ROWS
) -> DataFrame:
    """The table as a stream of several batches: each holds the rows of some days, every seventh
    row ``late_days`` after its time. The table is cut once; batches have equally many files."""
    rows = s.raw(table)
    shift = F.when(F.col(key) % 7 == 3, late_days).otherwise(0)
    number = F.floor((F.unix_seconds(F.col(time).cast("timestamp")) / 86_400 + shift) / days).cast("bigint")
    cut, folder = new_folder(s.spark, "cut"), new_folder(s.spark, "arrivals")
    rows.withColumn("_batch", F.coalesce(number, F.lit(0))).write.partitionBy("_batch").parquet(cut)
    parts = s.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_batch", T.LongType())])).parquet(cut)
    # One number a batch; a stream takes so many files at a time, so each batch needs as many.
    sizes = {r["_batch"]: r["n"] for r in parts.groupBy("_batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    files = max(1, min(sizes.values(), default=0) // file_rows)
    for n in sorted(sizes):
        batch = parts.where(F.col("_batch") == n).drop("_batch")
        batch = batch.coalesce(1) if files == 1 else batch.repartition(files)
        batch.write.mode("append").parquet(folder)
    if not sizes:
        rows.limit(0).write.parquet(folder)
    return J.read_stream(s.spark, folder, files_per_batch=files)


_STREAKS = """SELECT id, platform, start_time, CAST(5 AS BIGINT) AS streak FROM (SELECT *, count(*) FILTER (status <> 'completed') OVER (PARTITION BY platform, island
         ORDER BY start_time, id ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT *, sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END)
         OVER (PARTITION BY platform ORDER BY start_time, id ROWS UNBOUNDED PRECEDING) AS island FROM crawl_logs)) WHERE n = 5 AND status <> 'completed'
         AND epoch_ms(start_time) < (SELECT epoch_ms(max(start_time)) FROM crawl_logs) - {days} * 86400000"""


@query("str04_stream_failure_streak", _STREAKS.format(days=3))
def stream_failure_streak(s: Store) -> DataFrame:
    """Streaks over several batches with late rows; the last three days still wait."""
    logs = crawl_logs_of(_arrivals(s, "events", "ts", "event_id"))
    return J.run_to_table(J.failure_streak_stream(logs, delay="3 days"))


@query("str05_stream_alerts", "SELECT id, title, importance_score FROM demands WHERE importance_score > 8")
def stream_alerts(s: Store) -> DataFrame:
    demands = _stream(s, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title"),
        (F.col("p_size").cast("double") / 5).alias("importance_score"),
    )
    return J.run_to_table(J.alerts(demands))


@query(
    "str06_stream_platform_rate",
    """SELECT platform, b AS window_start, b + INTERVAL 1 DAY AS window_end, count(*) AS runs, CAST(sum(articles_found) AS BIGINT) AS found FROM (
         SELECT platform, articles_found, make_timestamp(CAST(floor(epoch(start_time) / 21600) * 21600 * 1000000 AS BIGINT)) - INTERVAL 6 HOUR * k AS b
         FROM crawl_logs, (VALUES (0), (1), (2), (3)) v(k))
       WHERE b + INTERVAL 1 DAY <= (SELECT max(start_time) FROM crawl_logs) - INTERVAL 6 HOUR GROUP BY 1, 2""",
)
def stream_platform_rate(s: Store) -> DataFrame:
    return J.run_to_table(J.platform_rate(crawl_logs_of(_stream(s, "events"))))
