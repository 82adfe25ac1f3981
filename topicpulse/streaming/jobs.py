"""The continuous jobs as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from topicpulse.operators import ingest, library
from topicpulse.session import new_folder, saved


def read_stream(
    spark: SparkSession, folder: str, pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """A stream over the Parquet files of a folder.

    ``pattern`` names entries of the folder, each a file or a folder of part files.
    """
    # A path with a wildcard may stand for a single file, which a plain stream path may not.
    path = f"{folder.rstrip('/')}/{pattern[:-1]}[{pattern[-1]}]" if pattern else folder
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which stateful processors need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_to_table(stream: DataFrame, output: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available into an append-only table and read it back."""
    return run_counted(stream, output, checkpoint)[0]


def run_counted(stream: DataFrame, output: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, int]:
    """``run_to_table`` with the number of rows that came after the watermark and were dropped."""
    spark = stream.sparkSession
    out = output or new_folder(spark, "stream")
    with _state_on_disk(spark):
        query = (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", checkpoint or new_folder(spark, "stream-state"))
            .outputMode("append")
            .trigger(availableNow=True)
            .start(out)
        )
    query.awaitTermination()
    late = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(out), late


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Feed every micro-batch to ``each(batch, batch_id)``."""
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint or new_folder(stream.sparkSession, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class ChangeLog:
    """Articles as a log of changes: a micro-batch writes its own changes and nothing else.

    ``changes/batch=N/bucket=b`` holds the rows that batch N supplies, one per key, so what is
    written follows the batch, and a batch that is run again replaces its own folder.
    ``folded/bucket=b`` holds the rows of a bucket up to the batch ``upto``; :meth:`compact`
    renews the buckets that batches have touched and leaves the others. Rows without a
    platform_id are never changed and so stay in ``changes``, in bucket -1. Files of folded
    batches may be removed by age. ``columns`` is the schema of the articles.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, buckets: int = 32) -> None:
        self.spark, self.path, self.columns, self.buckets = spark, path.rstrip("/"), columns, buckets
        # Appending no rows makes the folder where it is missing and changes nothing else.
        self._upto = f"{columns}, upto bigint, bucket int"
        spark.createDataFrame([], self._upto).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/folded")

    def write(self, batch: DataFrame, batch_id: int, order: str) -> None:
        """The changes of one batch; an empty batch leaves an empty folder."""
        rows = ingest.supplied_rows(batch, order)
        spread = F.pmod(F.xxhash64("platform", "platform_id"), F.lit(self.buckets)).cast("int")
        keyless = F.coalesce(F.col("platform_id"), F.lit("")) == ""
        dealt = rows.withColumn("bucket", F.when(keyless, -1).otherwise(spread))
        # Ranges, so that a large batch fills more tasks than there are buckets.
        dealt = dealt.repartitionByRange("bucket", "platform", "platform_id")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/changes/batch={batch_id}")

    def _changes(self) -> DataFrame:
        return self.spark.read.schema(f"{self.columns}, batch bigint, bucket int").parquet(f"{self.path}/changes")

    def _parts(self) -> tuple[DataFrame, DataFrame]:
        """Folded rows, and the changes that came after their bucket was folded."""
        folded = self.spark.read.schema(self._upto).parquet(f"{self.path}/folded")
        marks = folded.groupBy("bucket").agg(F.max("upto").alias("upto"))
        later = self._changes().join(marks, "bucket", "left").where("upto IS NULL OR batch > upto").drop("upto")
        return folded.withColumnRenamed("upto", "batch"), later

    def latest(self) -> DataFrame:
        """The table: for each key the last supplied value of every field, and its first id."""
        folded, later = self._parts()
        keyed = ingest.folded_rows(folded.unionByName(later.where("bucket >= 0")).drop("bucket"), "batch")
        loose = later.where("bucket < 0")
        return keyed.unionByName(loose.select(keyed.columns))

    def compact(self, least: int = 2) -> None:
        """Fold the buckets that at least ``least`` batches have touched since they were folded.

        Buckets are replaced when all their new rows are written. A reader that meets both the
        old and the new state gets the same table, since folding a change twice changes nothing.
        """
        folded, later = self._parts()
        due = later.where("bucket >= 0").groupBy("bucket").agg(
            F.count_distinct("batch").alias("n"), F.max("batch").alias("now")
        ).where(F.col("n") >= least).drop("n")
        due = saved(due)
        rows = folded.unionByName(later.where("bucket >= 0")).join(due, "bucket")
        new = ingest.folded_rows(rows.drop("now"), "batch", "bucket").join(due.withColumnRenamed("now", "upto"), "bucket")
        ready = saved(new)
        spread = ready.repartitionByRange("bucket", "platform", "platform_id")
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(
            f"{self.path}/folded"
        )


def first_arrivals(articles: DataFrame, delay: str | None = None) -> DataFrame:
    """First article per (platform, platform_id).

    Every key seen is kept in the state store, however far apart its copies arrive.
    With ``delay`` keys older than the watermark are forgotten, and so may pass again.
    """
    if delay is None:
        return articles.dropDuplicates(["platform", "platform_id"])
    timed = articles.withColumn("arrived", F.col("crawl_time").cast("timestamp"))
    return timed.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["platform", "platform_id"])


def upsert_stream(articles: DataFrame, log: ChangeLog, order: str, compact_every: int | None = None) -> None:
    """Upsert every micro-batch through the log, folding it after every ``compact_every`` batches."""

    def each(batch: DataFrame, batch_id: int) -> None:
        log.write(batch, batch_id, order)
        if compact_every and (batch_id + 1) % compact_every == 0:
            log.compact()

    run_batches(articles, each)


def weekly_snapshots(mentions: DataFrame, delay: str = "30 days") -> DataFrame:
    """Mentions ``(demand_id, seen_at)`` per demand and week (from Monday).

    Weeks are emitted once the watermark has passed them; later rows are dropped.
    """
    timed = mentions.withColumn("at", F.col("seen_at").cast("timestamp")).withWatermark("at", delay)
    weeks = timed.groupBy(F.window("at", "7 days", "7 days", "4 days").alias("w"), "demand_id")
    return weeks.agg(F.count(F.lit(1)).alias("frequency")).select(
        "demand_id", F.to_date("w.start").alias("snapshot_date"), "frequency"
    )


# A waiting row of a platform, and the rows that one state entry holds.
_WAITING = np.dtype([("at", "<i8"), ("id", "<i8"), ("failed", "?")])
_BLOCK_ROWS = 50_000


def _blocks(rows: np.ndarray) -> list[tuple[bytes]]:
    return [(rows[i : i + _BLOCK_ROWS].tobytes(),) for i in range(0, len(rows), _BLOCK_ROWS)]


class _Streaks(StatefulProcessor):
    """Failure streak of a platform; rows wait until the watermark has passed them.

    Waiting rows are kept as blocks, so that the state is read and written by block, not by row.
    """

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")
        self.streak = handle.getValueState("streak", "n bigint")
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        earliest = None
        for batch in rows:
            block = np.empty(len(batch), _WAITING)
            for name in _WAITING.names:
                block[name] = batch[name].to_numpy()
            self.waiting.appendList(_blocks(block))
            low = int(block["at"].min()) // 1000
            earliest = low if earliest is None else min(earliest, low)
        if earliest is not None:
            self._wake(earliest, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.due.clear()
        now = timerValues.getCurrentWatermarkInMs()
        rows = np.concatenate([np.empty(0, _WAITING), *(np.frombuffer(b[0], _WAITING) for b in self.waiting.get())])
        ready = rows["at"] // 1000 < now
        later = rows[~ready]
        if len(later):
            self.waiting.put(_blocks(later))
            self._wake(int(later["at"].min()) // 1000, now)
        else:
            self.waiting.clear()
        done = rows[ready]
        if not len(done):
            return
        done = done[np.lexsort((done["id"], done["at"]))]
        open_run = self.streak.get()[0] if self.streak.exists() else 0
        place = np.arange(1, len(done) + 1)
        # The last completed run so far; before the first one the open streak goes on.
        last = np.maximum.accumulate(np.where(done["failed"], -open_run, place))
        run = place - last
        self.streak.update((int(run[-1]),))
        hit = done[run == self.threshold]
        if len(hit):
            yield pd.DataFrame(
                {"id": hit["id"], "platform": key[0], "start_time": pd.to_datetime(hit["at"], unit="us"), "streak": self.threshold}
            )

    def _wake(self, at: int, now: int) -> None:
        """One timer a platform, at its earliest waiting row."""
        at = max(at, now + 1)
        if self.due.exists():
            due = self.due.get()[0]
            if due <= at:
                return
            self.handle.deleteTimer(due)
        self.handle.registerTimer(at)
        self.due.update((at,))


def failure_streak_stream(logs: DataFrame, threshold: int = 5, delay: str = "1 day") -> DataFrame:
    """Rows at which a platform reaches ``threshold`` failures in a row, as a stream.

    Rows count in the order of ``(start_time, id)``, whichever batch brings them: a row waits
    in the state until the watermark, ``delay`` behind the newest start, has passed it, so
    rows that come late by less than ``delay`` take their place. Later ones are dropped and
    counted by Spark. The state holds the rows of the last ``delay`` and one number a platform.
    Rows without a platform or a start time take no part; a NULL status counts as a failure.
    """
    timed = logs.where("platform IS NOT NULL AND start_time IS NOT NULL AND id IS NOT NULL").select(
        "platform",
        F.col("id").cast("bigint").alias("id"),
        F.col("start_time").cast("timestamp").alias("time"),
        F.coalesce(F.col("status") != "completed", F.lit(True)).alias("failed"),
    )
    # Microseconds as a number, so that no time zone comes into the Python side.
    rows = timed.withWatermark("time", delay).withColumn("at", F.unix_micros("time"))
    crossings = rows.groupBy("platform").transformWithStateInPandas(
        statefulProcessor=_Streaks(threshold),
        outputStructType="id bigint, platform string, start_time timestamp_ntz, streak bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    return crossings


def alerts(demands: DataFrame) -> DataFrame:
    """Important demands as they arrive."""
    return library.high_importance(demands)


def platform_rate(logs: DataFrame, delay: str = "6 hours") -> DataFrame:
    """Articles found per platform over a day, every six hours."""
    timed = logs.withColumn("at", F.col("start_time").cast("timestamp")).withWatermark("at", delay)
    spans = timed.groupBy(F.window("at", "1 day", "6 hours").alias("w"), "platform")
    return spans.agg(F.count(F.lit(1)).alias("runs"), F.sum("articles_found").alias("found")).select(
        "platform",
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "runs",
        "found",
    )
