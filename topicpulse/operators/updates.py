"""Updates of stored demands and articles, as table-to-table rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicpulse.operators.ranges import running_sum
from topicpulse.session import saved

EDITABLE = ("category", "status", "notes", "tags")


def update_fields(demands: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the editable fields that a change row supplies.

    One change row per demand, or several with an ``ord`` column: then the last
    supplied value of each field counts.
    """
    given = [c for c in EDITABLE if c in changes.columns and c in demands.columns]
    if "ord" in changes.columns:
        last = [F.max_by(g, F.when(F.col(g).isNotNull(), F.col("ord"))).alias(g) for g in given]
        changes = changes.groupBy("id").agg(*last)
    c = changes.select("id", *[F.col(g).alias(f"_c_{g}") for g in given])
    joined = demands.join(c, "id", "left")
    return joined.select(*[F.coalesce(f"_c_{n}", n).alias(n) if n in given else F.col(n) for n in demands.columns])


def set_status(demands: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace the status of the listed demands."""
    return update_fields(demands, changes.select("id", "status", *[c for c in ("ord",) if c in changes.columns]))


def annotate(demands: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(demands, rejected)`` after confirm / reject annotations.

    Unknown actions and unknown demands come back as rejected rows.
    """
    action = F.col("action")
    status = F.when(action == "confirm", "confirmed").when(action == "reject", "rejected")
    known = demands.select("id")
    bad = notes.where(status.isNull()).withColumn("reason", F.lit("action must be confirm or reject"))
    lost = notes.where(status.isNotNull()).join(known, "id", "left_anti").withColumn("reason", F.lit("demand not found"))
    order = [c for c in ("ord",) if c in notes.columns]
    changes = notes.where(status.isNotNull()).select(
        "id", status.alias("status"), F.nullif("notes", F.lit("")).alias("notes"), *order
    )
    return update_fields(demands, changes), bad.unionByName(lost)


def merge_plan(merges: DataFrame, demands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split merge requests ``(source, target, notes, ord)`` into valid and rejected.

    ``ord`` names a request and orders them. A request is rejected when either end is
    missing, when it points at itself, or when its source was merged away by an earlier
    valid request. Chains and cycles are valid: requests take effect in their order.
    """
    ids = demands.select("id")
    able = (
        merges.where("source <> target AND ord IS NOT NULL")
        .join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    )
    first = able.groupBy("source").agg(F.min_by(F.struct("target", "notes"), "ord").alias("m"), F.min("ord").alias("ord"))
    valid = first.select("source", "m.target", "m.notes", "ord")
    return valid, merges.join(valid.select("ord"), "ord", "left_anti")


def _with_next(plan: DataFrame) -> DataFrame:
    """Requests with ``up``, the later request that moves on what this one has moved."""
    later = plan.select(F.col("source").alias("_at"), F.col("ord").alias("up"))
    moved_on = (F.col("target") == F.col("_at")) & (F.col("up") > F.col("ord"))
    return plan.join(later, moved_on, "left").drop("_at")


def _jumps(nodes: DataFrame) -> DataFrame | None:
    """Where two steps lead, ``(ord, up, over)``; None when no request has a next one.

    Every request has one next at most, of a higher ``ord``, so there are no cycles.
    """
    if nodes.where("up IS NOT NULL").isEmpty():
        return None
    return nodes.select(F.col("ord").alias("_up"), F.col("up").alias("_over"))


def _carried(nodes: DataFrame, value: str) -> DataFrame:
    """``nodes`` with ``value`` summed over each request and all that flow into it.

    Steps double: before round k a request holds what comes in over fewer than ``2^k``
    requests, and ``up`` lies ``2^k`` further on.
    """
    now = nodes
    while (jump := _jumps(now)) is not None:
        gains = now.where("up IS NOT NULL").groupBy(F.col("up").alias("_to")).agg(F.sum(value).alias("_gain"))
        grown = now.join(gains, F.col("ord") == F.col("_to"), "left").join(jump, F.col("up") == F.col("_up"), "left")
        now = saved(
            grown.withColumn(value, F.col(value) + F.coalesce("_gain", F.lit(0))).withColumn("up", F.col("_over")).select(*nodes.columns),
            "merges",
        )
    return now


def _places(plan: DataFrame) -> DataFrame:
    """``(source, final, place)``: where the links of a source end, and who is there first.

    Of links that meet at a demand the one that was there stays. Numbering the requests
    so that each comes before those that flow into it, and these by their order, gives the
    link that stays the smallest number among all that end at the same demand.
    """
    linked = saved(_with_next(plan).select("source", "target", "ord", "up"), "merges")
    sizes = _carried(linked.withColumn("n", F.lit(1).cast("bigint")), "n").select(F.col("ord").alias("_o"), "n")
    # Before this one come its next request and all that its earlier siblings hold.
    sized = linked.join(sizes, F.col("ord") == F.col("_o")).drop("_o")
    counted = running_sum(sized, ["target", "up"], ["ord"], F.col("n"), "_upto")
    now = counted.select("source", F.col("target").alias("final"), "ord", "up", (1 + F.col("_upto") - F.col("n")).alias("place"))
    while _jumps(now) is not None:
        ahead = now.select(
            F.col("ord").alias("_up"), F.col("up").alias("_over"), F.col("final").alias("_final"), F.col("place").alias("_place")
        )
        now = saved(
            now.join(ahead, F.col("up") == F.col("_up"), "left").select(
                "source",
                F.coalesce("_final", "final").alias("final"),
                "ord",
                F.col("_over").alias("up"),
                (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place"),
            ),
            "merges",
        )
    return now.select("source", "final", "place")


def merge_links(links: DataFrame, plan: DataFrame) -> DataFrame:
    """Move links along the requests; of links that meet, the one there first stays."""
    places = _places(plan)
    tagged = links.join(places, links["demand_id"] == places["source"], "left").select(
        "article_id",
        F.coalesce("final", "demand_id").alias("demand_id"),
        "relevance_score",
        F.coalesce("place", F.lit(0)).alias("_place"),
        F.col("demand_id").alias("_from"),
    )
    first = F.struct("_place", "_from")
    return tagged.groupBy("article_id", "demand_id").agg(F.min_by("relevance_score", first).alias("relevance_score"))


def merge_demands_into(demands: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source frequencies to targets and mark sources as merged; rows stay.

    A source brings what earlier requests have added to it. A missing frequency counts as zero there.
    """
    held = demands.select(F.col("id").alias("_id"), F.coalesce("frequency", F.lit(0)).cast("bigint").alias("f"))
    p = _with_next(plan).join(held, F.col("source") == F.col("_id")).select("target", "ord", "up", "f")
    gains = _carried(saved(p, "merges"), "f").groupBy(F.col("target").alias("id")).agg(F.sum("f").alias("_gain"))
    into = plan.select(F.col("source").alias("id"), F.col("target").alias("_target"), F.col("notes").alias("_notes"))
    extra = F.when(F.coalesce("_notes", F.lit("")) != "", F.concat(F.lit(" — "), F.col("_notes"))).otherwise("")
    note = F.concat(F.lit("Merged into demand #"), F.col("_target").cast("string"), extra)
    old_notes = F.col("notes") if "notes" in demands.columns else F.lit(None).cast("string")
    gone = F.col("_target").isNotNull()
    gained = F.coalesce("frequency", F.lit(0)) + F.col("_gain")
    return (
        demands.join(into, "id", "left")
        .join(gains, "id", "left")
        .withColumn("frequency", F.coalesce(gained, "frequency"))
        .withColumn("status", F.when(gone, "merged").otherwise(F.col("status")))
        .withColumn("notes", F.when(gone, note).otherwise(old_notes))
        .drop("_target", "_notes", "_gain")
    )


def purge_raw_html(articles: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Drop stored pages older than the cutoff (strictly); ``purged`` marks the rows."""
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    old = F.coalesce((F.col("crawl_time") < cutoff) & F.col("raw_html").isNotNull(), F.lit(False))
    return articles.withColumn("purged", old).withColumn(
        "raw_html", F.when(~F.col("purged"), F.col("raw_html"))
    )


def mark_analyzed(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Flag the rows whose key is in ``done``."""
    d = done.select(F.col(done.columns[0]).alias(key)).distinct().withColumn("_done", F.lit(True))
    return rows.join(d, key, "left").withColumn("is_analyzed", F.col("is_analyzed") | F.coalesce("_done", F.lit(False))).drop("_done")
