"""Snapshots over time: change rates, trend labels, series and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicpulse.operators.relations import series_titles

THRESHOLD = 0.2


def create_snapshot(demands: DataFrame, day: Column) -> DataFrame:
    """One row per demand: its frequency and importance on ``day``."""
    return demands.select(
        F.col("id").alias("demand_id"),
        F.to_date(day).alias("snapshot_date"),
        "frequency",
        F.col("importance_score").alias("heat_score"),
        F.unix_micros(day.cast("timestamp")).alias("taken"),
    )


def append_snapshot(snapshot: DataFrame, path: str) -> None:
    """Append to the history, one folder per snapshot date."""
    snapshot.write.mode("append").partitionBy("snapshot_date").parquet(path)


def change_rate(old: Column, new: Column) -> Column:
    """Relative change; growth from nothing counts as one."""
    grown = F.when(new > 0, 1.0).otherwise(0.0)
    return F.when(old == 0, grown).otherwise((new - old) / F.nullif(old, F.lit(0)))


def _label(rate: Column) -> Column:
    return F.when(rate > THRESHOLD, "rising").when(rate < -THRESHOLD, "declining").otherwise("stable")


def _newest_dates(snapshots: DataFrame) -> DataFrame:
    """``(snapshot_date, newest)``: the last two dates; no row if there are fewer than two."""
    two = snapshots.select("snapshot_date").where("snapshot_date IS NOT NULL").distinct()
    ends = two.orderBy(F.desc("snapshot_date")).limit(2).agg(
        F.max("snapshot_date").alias("now"), F.min("snapshot_date").alias("then")
    )
    both = F.array(
        F.struct(F.col("now").alias("snapshot_date"), F.lit(True).alias("newest")),
        F.struct(F.col("then").alias("snapshot_date"), F.lit(False).alias("newest")),
    )
    return ends.where("now <> then").select(F.inline(both))


def detect_trends(demands: DataFrame, snapshots: DataFrame, order: str = "taken") -> DataFrame:
    """Label every demand by its two newest snapshot dates.

    Adds ``change`` (new, rising, declining, stable, or NULL when unlisted) and
    replaces ``trend``. With fewer than two dates nothing changes. Of several
    snapshots of a demand on one date the last by ``order`` counts (of equal ones the
    largest).
    """
    newest = F.col("newest")
    place = F.struct(F.col(order), F.col("frequency"))
    pairs = (
        # Two rows, so every executor gets them and only matching rows are shuffled.
        snapshots.join(F.broadcast(_newest_dates(snapshots)), "snapshot_date")
        .groupBy(F.col("demand_id").alias("id"))
        .agg(
            F.max_by("frequency", F.when(newest, place)).alias("current_frequency"),
            F.max_by("frequency", F.when(~newest, place)).alias("previous_frequency"),
        )
    )
    now, then = F.col("current_frequency"), F.col("previous_frequency")
    listed = now.isNotNull()
    change = F.when(listed & then.isNull(), "new").when(listed, _label(change_rate(then, now)))
    trend = F.when(F.col("change") == "new", "rising").otherwise(F.coalesce("change", "trend"))
    return demands.join(pairs, "id", "left").withColumn("change", change).withColumn("trend", trend)


def trend_summary(labelled: DataFrame) -> DataFrame:
    """How many demands fall into each change class."""
    return labelled.where("change IS NOT NULL").groupBy("change").agg(F.count(F.lit(1)).alias("demands"))


def trend_facts(labelled: DataFrame, emerging: DataFrame) -> DataFrame:
    """Titles per class for a report, as rows: the lists themselves are unbounded."""
    facts = labelled.where("change IS NOT NULL").select(F.col("change").alias("class"), "id", "title")
    return facts.unionByName(emerging.select(F.lit("emerging").alias("class"), "id", "title"))


def trend_history(snapshots: DataFrame, periods: int = 12) -> DataFrame:
    """The last ``periods`` snapshots of every demand, oldest first as ``position``."""
    by_date = W.partitionBy("demand_id").orderBy(F.desc("snapshot_date"))
    kept = snapshots.withColumn("_back", F.row_number().over(by_date)).where(F.col("_back") <= periods)
    oldest = W.partitionBy("demand_id").orderBy("snapshot_date")
    return kept.withColumn("position", F.row_number().over(oldest).cast("bigint")).drop("_back")


def trend_series(snapshots: DataFrame, demands: DataFrame, as_of: Column, weeks: int = 12) -> DataFrame:
    """Per demand its points of the last weeks as ``date:frequency:heat score`` text, in date order."""
    since = F.date_sub(F.to_date(as_of), weeks * 7)
    heat = F.coalesce("heat_score", F.lit(0.0)).cast("decimal(18,2)").alias("heat")
    point = F.struct(F.col("snapshot_date"), F.col("frequency"), heat)
    series = (
        snapshots.where(F.col("snapshot_date") >= since)
        .groupBy("demand_id")
        .agg(F.array_sort(F.collect_list(point)).alias("points"))
    )
    shown = F.transform("points", lambda p: F.concat_ws(":", p["snapshot_date"], p["frequency"], p["heat"]))
    return series_titles(series, demands).select(
        "demand_id", "title", F.size("points").cast("bigint").alias("n_points"), F.array_join(shown, ",").alias("data")
    )


def trend_matrix(snapshots: DataFrame, demands: DataFrame, top: int = 10) -> DataFrame:
    """Every snapshot date against the ``top`` demands by frequency; gaps are zero."""
    best = demands.orderBy(F.desc("frequency"), "id").limit(top).select("id")
    dates = snapshots.select("snapshot_date").distinct()
    # At most ``top`` rows: spread them over the dates through one array.
    ids = best.agg(F.collect_list("id").alias("ids")).scalar()
    grid = dates.select("snapshot_date", F.explode(ids).alias("demand_id"))
    picked = snapshots.join(best.withColumnRenamed("id", "demand_id"), "demand_id", "left_semi")
    found = picked.groupBy("snapshot_date", "demand_id").agg(F.max("frequency").alias("f"))
    return grid.join(found, ["snapshot_date", "demand_id"], "left").select(
        "snapshot_date", "demand_id", F.coalesce("f", F.lit(0)).alias("value")
    )


def all_period_changes(snapshots: DataFrame) -> DataFrame:
    """Change rate between every two consecutive snapshots of a demand."""
    order = W.partitionBy("demand_id").orderBy("snapshot_date")
    before = F.lag("frequency").over(order)
    rated = snapshots.withColumn("previous", before).where("previous IS NOT NULL")
    rate = F.round(change_rate(F.col("previous"), F.col("frequency")), 6)
    return rated.select("demand_id", "snapshot_date", "previous", "frequency", rate.alias("rate")).withColumn(
        "label", _label(F.col("rate"))
    )


def weekly_pulse(demands: DataFrame, snapshots: DataFrame, as_of: Column, top: int = 5) -> DataFrame:
    """Strongest risers per category, with their change and an emerging flag."""
    labelled = detect_trends(demands, snapshots)
    fresh = F.col("first_seen") >= as_of - F.make_dt_interval(F.lit(7))
    rate = change_rate(F.col("previous_frequency"), F.col("current_frequency"))
    risers = labelled.where("change IN ('rising', 'new')").select(
        F.coalesce(F.nullif("category", F.lit("")), F.lit("未分类")).alias("category"),
        "id",
        "title",
        "change",
        "current_frequency",
        F.round(rate, 6).alias("rate"),
        F.coalesce(fresh & (F.col("importance_score") > 5), F.lit(False)).alias("emerging"),
    )
    order = W.partitionBy("category").orderBy(F.desc("current_frequency"), F.col("id"))
    return risers.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
