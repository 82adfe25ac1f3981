"""From fetched rows to stored articles: first seen, known, limits, upserts, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicpulse.functions import scalars as S
from topicpulse.operators.ranges import in_ranges


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Concatenate normalised article frames, filling absent columns with NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def first_seen_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in list order; rows with an empty last key are dropped."""
    key = F.col(keys[-1])
    w = W.partitionBy(*keys).orderBy(*order)
    kept = rows.where(key.isNotNull() & (key.cast("string") != ""))
    return kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_list_detail(listed: DataFrame, detail: DataFrame, platform: str = "unknown") -> DataFrame:
    """Detail values override list values of the same url; absent ones keep them.

    A detail column ``has_<name>`` (boolean) makes a NULL detail value override too.
    """
    flags = [c for c in detail.columns if c.startswith("has_")]
    fields = [c for c in detail.columns if c != "url" and c not in flags]
    d = detail.select("url", *[F.col(c).alias(f"_d_{c}") for c in [*fields, *flags]])
    joined = listed.join(d, "url", "left")
    out = []
    for name in [*listed.columns, *[c for c in fields if c not in listed.columns]]:
        if name not in fields:
            out.append(F.col(name))
        elif name not in listed.columns:
            out.append(F.col(f"_d_{name}").alias(name))
        else:
            value = F.coalesce(f"_d_{name}", name)
            if f"has_{name}" in flags:
                value = F.when(F.col(f"_d_has_{name}"), F.col(f"_d_{name}")).otherwise(value)
            out.append(value.alias(name))
    merged = joined.select(*out).withColumn("platform", F.coalesce("platform", F.lit(platform)))
    counts = [F.coalesce(F.col(c), F.lit(0)) for c in ("view_count", "like_count", "comment_count", "share_count")]
    heat = S.heat_score(*counts)
    if "heat_score" in merged.columns:
        heat = F.coalesce("heat_score", heat)
    return merged.withColumn("heat_score", heat)


def run_limit(rows: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The first ``limit`` new rows of each platform run."""
    w = W.partitionBy("platform").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def failure_streaks(
    logs: DataFrame, failed: Column, threshold: int = 5, segment: Column | None = None
) -> DataFrame:
    """Consecutive failures so far on each platform, and whether it is blocked.

    A platform may own most of the log, so the log is cut into sorted ranges: streaks
    are counted inside a range, and one small row per platform and range carries the open
    streak into the next. ``segment`` names other cuts, in the order of time.
    A row whose ``failed`` is NULL counts as a failure; rows without a platform form one of their own.
    """
    rows = logs.withColumn("_ok", ~failed)
    if segment is None:
        rows = in_ranges(rows, ["platform", "start_time", "id"]).withColumnRenamed("_part", "_seg")
    else:
        rows = rows.withColumn("_seg", segment)
    inside = W.partitionBy("platform", "_seg").orderBy("start_time", "id")
    rows = rows.withColumn("_i", F.row_number().over(inside))
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_hit", F.max(F.when(F.col("_ok"), F.col("_i"))).over(so_far))
    rows = rows.withColumn("_local", F.col("_i") - F.coalesce("_hit", F.lit(0)))

    parts = rows.groupBy("platform", "_seg").agg(
        F.max_by("_local", "_i").alias("_tail"), F.max(F.coalesce(F.col("_ok").cast("int"), F.lit(0))).alias("_reset")
    )
    along = W.partitionBy("platform").orderBy("_seg")
    island = F.sum("_reset").over(along.rowsBetween(W.unboundedPreceding, W.currentRow))
    parts = parts.withColumn("_island", island)
    open_run = W.partitionBy("platform", "_island").orderBy("_seg")
    parts = parts.withColumn("_open", F.sum("_tail").over(open_run.rowsBetween(W.unboundedPreceding, W.currentRow)))
    carry = parts.select(
        F.col("platform").alias("_p"), F.col("_seg").alias("_s"), F.coalesce(F.lag("_open").over(along), F.lit(0)).alias("_carry")
    )

    streak = F.col("_local") + F.when(F.col("_hit").isNull(), F.col("_carry")).otherwise(0)
    here = F.col("platform").eqNullSafe(F.col("_p")) & F.col("_seg").eqNullSafe(F.col("_s"))
    return (
        rows.join(carry, here)
        .withColumn("streak", streak.cast("bigint"))
        .withColumn("blocked", F.col("streak") >= threshold)
        .drop("_seg", "_ok", "_i", "_hit", "_local", "_carry", "_p", "_s")
    )


def last_completed_position(logs: DataFrame) -> DataFrame:
    """Where the newest completed run of each platform stopped; may be NULL."""
    newest = F.struct(F.col("start_time"), -F.col("id"))
    return logs.where("status = 'completed'").groupBy("platform").agg(
        F.max_by("last_position", newest).alias("last_position")
    )


def _supplied_last(columns: list[str], order: str, explicit: set[str]) -> list[Column]:
    out = []
    for c in columns:
        rank = F.col(order) if c in explicit else F.when(F.col(c).isNotNull(), F.col(order))
        out.append(F.max_by(F.col(c), rank).alias(c))
    return out


def supplied_rows(incoming: DataFrame, order: str) -> DataFrame:
    """What a batch supplies: one row per (platform, platform_id) with the last value of each field.

    Rows without a platform_id stay as they are; ``order`` is left out.
    """
    keys = ["platform", "platform_id"]
    keyless = F.coalesce(F.col("platform_id"), F.lit("")) == ""
    columns = [c for c in incoming.columns if c != order]
    fields = [c for c in columns if c not in keys]
    keyed = incoming.where(~keyless).groupBy(*keys).agg(*_supplied_last(fields, order, set()))
    return keyed.select(*columns).unionByName(incoming.where(keyless).select(*columns))


def folded_rows(rows: DataFrame, batch: str, *more: str) -> DataFrame:
    """Supplied rows of several batches as one row per key: later values win, the first id stays.

    Rows of one key and batch must agree, as those of a batch that is there twice do. The result
    is the same however batches are folded before, one by one or in groups.
    """
    keys = ["platform", "platform_id"]
    fields = [c for c in rows.columns if c not in (*keys, batch, *more)]
    last = [
        (F.min_by if c == "id" else F.max_by)(c, F.when(F.col(c).isNotNull(), F.col(batch))).alias(c) for c in fields
    ]
    columns = [c for c in rows.columns if c != batch]
    return rows.groupBy(*keys, *more).agg(*last).select(*columns)


def upsert_articles(
    stored: DataFrame,
    incoming: DataFrame,
    order: str,
    mode: str = "update",
    explicit_nulls: frozenset[str] = frozenset(),
) -> DataFrame:
    """Merge ``incoming`` into ``stored`` on (platform, platform_id).

    ``update``: a match overwrites the supplied (non-NULL, or listed in
    ``explicit_nulls``) fields, later rows of the batch after earlier ones.
    ``skip``: stored rows stay, and the first row of a new key is inserted.
    Rows without a platform_id are always inserted.
    """
    if mode not in ("update", "skip"):
        raise ValueError("mode is update or skip")
    keys = ["platform", "platform_id"]
    columns = stored.columns
    keyless = F.coalesce(F.col("platform_id"), F.lit("")) == ""
    fields = [c for c in columns if c not in keys]
    given = [c for c in fields if c in incoming.columns]

    if mode == "skip":
        fresh = first_seen_wins(incoming.where(~keyless), keys, [order]).join(
            stored.select(*keys), keys, "left_anti"
        )
        added = fresh.unionByName(incoming.where(keyless))
        return stored.unionByName(added.drop(order), allowMissingColumns=True)

    batch = incoming.where(~keyless).groupBy(*keys).agg(*_supplied_last(given, order, set(explicit_nulls)))
    renamed = batch.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in given])
    old = stored.where(~keyless).withColumn("_old", F.lit(True))
    joined = old.join(renamed, keys, "full")

    def value(c: str) -> Column:
        if c in keys or c not in given:
            return F.col(c)
        if c == "id":
            return F.coalesce("id", "_n_id").alias("id")
        if c in explicit_nulls:
            return F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
        return F.coalesce(f"_n_{c}", c).alias(c)

    merged = joined.select(*[value(c) for c in columns])
    return merged.unionByName(stored.where(keyless)).unionByName(
        incoming.where(keyless).select(*[c for c in columns if c in incoming.columns]), allowMissingColumns=True
    )


def run_records(events: DataFrame) -> DataFrame:
    """Latest state of each run from its append-only log of state rows."""
    state = F.struct("status", "articles_found", "articles_new", "error_message", "end_time")
    return (
        events.groupBy("run_id", "platform")
        .agg(F.min("logged_at").alias("start_time"), F.max_by(state, F.col("seq")).alias("s"))
        .select("run_id", "platform", "start_time", "s.*")
    )
