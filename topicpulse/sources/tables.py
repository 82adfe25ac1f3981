"""Table scans: the seven stored tables, and views of them over other Parquet data."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicpulse import schemas
from topicpulse.functions import scalars as S
from topicpulse.session import balanced, ship_package


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one stored table with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{folder}/{name}")


def align_schema(
    df: DataFrame, target: T.StructType, defaults: dict[str, object] | None = None
) -> DataFrame:
    """Add the columns a table lacks, with their declared default; never retype or drop."""
    defaults = defaults or {}
    have = set(df.columns)
    added = [
        F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name)
        for f in target.fields
        if f.name not in have
    ]
    return df.select("*", *added)


def _canonical(c: Column, kind: T.DataType) -> Column:
    """A value as text that does not depend on the engine; fractions count to a millionth."""
    if isinstance(kind, T.DoubleType):
        return F.floor(c * 1_000_000 + 0.5).cast("string")
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return c.cast("string")


def is_bad(name: str) -> Column:
    """Whether a row lacks a value its table requires."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in schemas.REQUIRED[name]])


def fingerprints(df: DataFrame, name: str) -> DataFrame:
    """One row per declared column of a stored table, from one scan:
    ``(table_name, column_name, n_rows, n_bad, n_values, fingerprint)``.

    The fingerprint is the sum of the first 32 bits of the values' md5, as decimal text: it depends
    on no order or partitioning, and equal tables have equal ones. Bad rows are counted apart
    and left out. Columns the table lacks are read as their default, further ones are ignored; an
    empty table has zeros.
    """
    fields = schemas.TABLES[name].fields
    rows = align_schema(df, schemas.TABLES[name], schemas.DEFAULTS.get(name))
    good = ~F.col("bad")
    texts = rows.select(
        is_bad(name).alias("bad"),
        *[_canonical(F.col(f.name).cast(f.dataType), f.dataType).alias(f"c{i}") for i, f in enumerate(fields)],
    )
    bits = lambda c: F.conv(F.left(F.md5(c), F.lit(8)), 16, 10).cast("decimal(20,0)")
    one = texts.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("bad").alias("n_bad"),
        *[F.count(F.when(good, F.col(f"c{i}"))).alias(f"n{i}") for i in range(len(fields))],
        *[F.coalesce(F.sum(F.when(good, bits(F.col(f"c{i}")))), F.lit(0)).cast("string").alias(f"f{i}") for i in range(len(fields))],
    )
    per_column = [
        F.struct(F.lit(f.name).alias("column_name"), F.col(f"n{i}").alias("n_values"), F.col(f"f{i}").alias("fingerprint"))
        for i, f in enumerate(fields)
    ]
    return one.select(F.lit(name).alias("table_name"), "n_rows", "n_bad", F.inline(F.array(*per_column)))


def _text(value: Column) -> Column:
    return value.cast("string")


class SampleStore:
    """The reference tables derived from a folder of star-schema Parquet files.

    Every table is a lazy projection over whole files, so filters and column
    pruning still reach the Parquet scan.
    """

    AS_OF = "2024-03-31 00:00:00"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        ship_package(spark)

    def spread(self, name: str, key: str) -> DataFrame:
        """A table for heavy per-row work."""
        return balanced(self.raw(name), key)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def as_of(self) -> Column:
        return F.lit(self.AS_OF).cast("timestamp_ntz")

    @property
    def articles_as_of(self) -> Column:
        """Newest crawl time, as a scalar subquery."""
        newest = self.raw("documents").agg(F.max("doc_id").alias("n"))
        return newest.select(_crawl_time(F.col("n")).alias("t")).scalar()

    @cached_property
    def articles(self) -> DataFrame:
        docs = self.raw("documents")
        labelled = self.raw("labels").select(F.col("doc_id").alias("labelled_id"))
        i = F.col("doc_id")
        url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/p/"), _text(i))
        counts = {
            "view_count": (7919, 1_000_000),
            "like_count": (104_729, 100_000),
            "comment_count": (1_299_709, 10_000),
            "share_count": (15_485_863, 50_000),
        }
        crawl = _crawl_time(i)
        base = docs.join(labelled, i == F.col("labelled_id"), "left").select(
            i.alias("id"),
            F.concat(F.lit("p"), _text(F.col("n_chars") % 12)).alias("platform"),
            F.md5("text").alias("platform_id"),
            first_line("text", 60).alias("title"),
            F.col("source").alias("author"),
            url.alias("url"),
            F.col("text").alias("content"),
            F.when(i % 3 == 0, F.substring("text", 1, 120)).alias("summary"),
            crawl.alias("crawl_time"),
            F.when(
                i % 7 != 0, S.epoch_seconds(1_704_067_200 + i * 3600 - (i % 72) * 3600)
            ).alias("publish_time"),
            *[((i * a) % m).alias(name) for name, (a, m) in counts.items()],
            F.col("labelled_id").isNotNull().alias("is_analyzed"),
            F.col("lang").alias("language"),
        )
        return base.withColumn("heat_score", S.heat_score())

    @cached_property
    def demands(self) -> DataFrame:
        p = self.raw("part")
        i, size = F.col("p_partkey"), F.col("p_size")
        seen = 1_704_067_200 + (i % 90) * 86_400
        tags = F.concat(
            F.lit('["'), F.replace(F.col("p_name"), F.lit(" "), F.lit('","')), F.lit('"]')
        )
        return p.select(
            i.alias("id"),
            F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title"),
            F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("description"),
            F.when(size % 10 != 0, F.col("p_type")).alias("category"),
            F.col("p_brand").alias("subcategory"),
            F.when(i % 41 == 0, F.lit(None).cast("string"))
            .when(i % 37 == 0, F.lit("not-json"))
            .otherwise(tags)
            .alias("tags"),
            (1 + i % 20).cast("bigint").alias("frequency"),
            (size.cast("double") / 5).alias("importance_score"),
            F.when(i % 3 == 0, "rising").when(i % 3 == 1, "stable").otherwise("declining").alias("trend"),
            S.epoch_seconds(seen).alias("first_seen"),
            S.epoch_seconds(seen + (i % 11) * 3600).alias("last_seen"),
            F.when(i % 13 == 0, "confirmed").otherwise("new").alias("status"),
        )

    @cached_property
    def article_demand_relations(self) -> DataFrame:
        n_docs = self.raw("documents").agg(F.count(F.lit(1)).alias("n")).scalar()
        return (
            self.raw("lineitem")
            .groupBy(
                (F.col("l_orderkey") % n_docs).alias("article_id"),
                F.col("l_partkey").alias("demand_id"),
            )
            .agg(F.max("l_discount").alias("relevance_score"))
        )

    @cached_property
    def trend_snapshots(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy(
                F.col("l_partkey").alias("demand_id"),
                F.to_date(F.date_trunc("year", "l_shipdate")).alias("snapshot_date"),
            )
            .agg(
                F.count(F.lit(1)).alias("frequency"),
                F.sum("l_quantity").alias("heat_score"),
                F.unix_date(F.max("l_shipdate").cast("date")).cast("bigint").alias("taken"),
            )
        )

    @cached_property
    def hot_comments(self) -> DataFrame:
        return self.raw("conversations").select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
            F.col("conv_id").alias("article_id"),
            F.when(F.col("role") != "system", F.col("role")).alias("commenter"),
            F.col("text").alias("content"),
            ((F.length("text") * 7) % 500).cast("bigint").alias("like_count"),
            (F.col("turn") % 2 == 0).alias("is_analyzed"),
        )

    @cached_property
    def crawl_logs(self) -> DataFrame:
        return crawl_logs_of(self.raw("events"))

    @cached_property
    def demand_relations(self) -> DataFrame:
        part = self.raw("part")
        n = part.agg((F.count(F.lit(1)) + 5).alias("n")).scalar()
        edges = part.select(
            F.col("p_partkey").alias("a"),
            ((F.col("p_partkey") * 7 + 1) % n).alias("b"),
            (0.5 + F.col("p_size").cast("double") / 100).alias("s"),
        )
        return (
            edges.where("a <> b")
            .groupBy(F.least("a", "b").alias("demand_id_a"), F.greatest("a", "b").alias("demand_id_b"))
            .agg(F.max("s").alias("similarity_score"))
        )


def first_line(text: str, length: int) -> Column:
    """Head of the first line; cut before it is split, so long texts stay cheap."""
    return F.substring_index(F.left(text, F.lit(length)), "\n", 1)


def _crawl_time(doc_id: Column) -> Column:
    return S.epoch_seconds(1_704_067_200 + doc_id * 3600)


def crawl_logs_of(events: DataFrame) -> DataFrame:
    """Crawl log rows from an event table or stream."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("p"), _text(F.col("user_id") % 12)).alias("platform"),
        F.col("ts").alias("start_time"),
        F.when(kind == "error", "failed")
        .when(kind == "view", "stopped_blocked")
        .otherwise("completed")
        .alias("status"),
        F.floor("value").cast("bigint").alias("articles_found"),
        F.floor(F.col("value") / 2).cast("bigint").alias("articles_new"),
        F.col("props").alias("last_position"),
    )
