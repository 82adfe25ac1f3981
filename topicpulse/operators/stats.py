"""Counts, distributions and overview figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicpulse import dims
from topicpulse.functions import scalars as S
from topicpulse.operators.relations import last_run_per_platform



def article_stats(articles: DataFrame) -> DataFrame:
    return articles.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_analyzed").alias("analyzed"),
        F.count_if(~F.col("is_analyzed")).alias("unanalyzed"),
    )


def by_platform(articles: DataFrame) -> DataFrame:
    return articles.groupBy("platform").agg(F.count(F.lit(1)).alias("articles")).orderBy(F.desc("articles"), "platform")


def by_date(articles: DataFrame, newest: int = 30) -> DataFrame:
    """Count per crawl day of the newest days; an undated bucket is dropped last."""
    days = articles.groupBy(F.to_date("crawl_time").alias("crawl_date")).agg(F.count(F.lit(1)).alias("articles"))
    return days.orderBy(F.desc_nulls_last("crawl_date")).limit(newest).where("crawl_date IS NOT NULL")


def category_counts(demands: DataFrame) -> DataFrame:
    return (
        demands.where("category IS NOT NULL")
        .groupBy(F.col("category").alias("name"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "name")
    )


def category_dist(demands: DataFrame) -> DataFrame:
    """Counts and share of all demands, the uncategorised included in the base."""
    total = demands.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.round(F.col("count") / total * 100, 1)
    return category_counts(demands).withColumn("percentage", share)


def tag_counts(demands: DataFrame) -> DataFrame:
    """How often each tag occurs; rows without a JSON list are skipped."""
    return (
        demands.select(F.explode(S.json_list("tags")).alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "tag")
    )


def tag_size(counts: DataFrame) -> DataFrame:
    """Scale counts to display sizes from 0.75 to 2.25; the smallest bound is one."""
    hi = counts.agg(F.greatest(F.max("count"), F.lit(1)).alias("hi")).scalar()
    lo = counts.agg(F.least(F.min("count"), F.lit(1)).alias("lo")).scalar()
    ratio = F.when(hi == lo, 1.0).otherwise((F.col("count") - lo) / (hi - lo))
    return counts.select("tag", "count", F.round(0.75 + ratio * 1.5, 6).alias("size"))


def overview(articles: DataFrame, demands: DataFrame, as_of: Column) -> DataFrame:
    """Totals, demands new this week and the analysed share, in one row."""
    since = as_of - F.make_dt_interval(F.lit(7))
    done = F.count_if("is_analyzed")
    rate = F.when(F.count(F.lit(1)) > 0, done / F.count(F.lit(1)) * 100).otherwise(0.0)
    fresh = demands.agg(F.count_if(F.col("first_seen") >= since).alias("n")).scalar()
    return articles.agg(F.count(F.lit(1)).alias("total_articles"), F.round(rate, 1).alias("analysis_rate")).select(
        "total_articles",
        demands.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_demands"),
        fresh.alias("week_new_demands"),
        "analysis_rate",
    )


def _category_groups(demands: DataFrame) -> DataFrame:
    name = F.coalesce(S.blank_to_null("category"), F.lit(dims.UNCATEGORISED))
    return demands.groupBy(name.alias("category"))


def category_summary(demands: DataFrame) -> DataFrame:
    """Per category count, share and averages, with a total row."""
    total = demands.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = (
        _category_groups(demands)
        .agg(F.count(F.lit(1)).alias("count"), F.avg("frequency").alias("f"), F.avg("importance_score").alias("i"))
        .select(
            "category",
            "count",
            S.pct_text(F.col("count"), total).alias("pct"),
            F.round("f", 1).alias("avg_frequency"),
            F.round("i", 2).alias("avg_importance"),
        )
    )
    empty = F.lit(None).cast("double")
    footer = demands.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("合计").alias("category"),
        "count",
        F.lit("100%").alias("pct"),
        empty.alias("avg_frequency"),
        empty.alias("avg_importance"),
    )
    return rows.unionByName(footer)


def category_pct_report(demands: DataFrame) -> DataFrame:
    total = demands.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        _category_groups(demands)
        .agg(F.count(F.lit(1)).alias("count"))
        .select("category", "count", S.pct_text(F.col("count"), total).alias("pct"))
        .orderBy(F.desc("count"), "category")
    )


def daily_new_demands(demands: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """New demands on each of the last ``days`` days, empty days as zero."""
    last = F.to_date(as_of)
    first = F.date_sub(last, days - 1)
    spine = demands.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    counts = (
        demands.where((F.col("first_seen") >= first) & (F.col("first_seen") < F.date_add(last, 1)))
        .groupBy(F.to_date("first_seen").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("new_demands"))


def run_summary(logs: DataFrame) -> DataFrame:
    """Runs, rows found and rows new per platform and final status."""
    return logs.groupBy("platform", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("articles_found").alias("found"), F.sum("articles_new").alias("new")
    )


def token_usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens per run of a call log."""
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return calls.groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("total_tokens"))


def health_overview(articles: DataFrame, demands: DataFrame, logs: DataFrame) -> DataFrame:
    """System totals next to the last run of every platform."""
    return last_run_per_platform(logs).select(
        "platform",
        F.col("start_time").alias("last_crawl"),
        "status",
        "articles_found",
        articles.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_articles"),
        demands.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_demands"),
    )
