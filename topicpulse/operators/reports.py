"""Exports and reports: flat rows, category sheets, weekly report, sync documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicpulse import dims
from topicpulse.functions import scalars as S
from topicpulse.operators import library, stats

# Export columns and their printed headers.
EXPORT_HEADERS = {
    "id": "ID",
    "title": "标题",
    "category": "分类",
    "subcategory": "子分类",
    "frequency": "频次",
    "importance": "重要性",
    "trend": "趋势",
    "status": "状态",
    "first_seen": "首次发现",
    "last_seen": "最后发现",
    "tags": "标签",
}
BYTE_ORDER_MARK = "\ufeff"

_LAST = 2**62


def _day(c: str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


def export_rows(demands: DataFrame) -> DataFrame:
    """The eleven export columns of every demand."""
    return demands.select(
        "id",
        "title",
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("subcategory", F.lit("")).alias("subcategory"),
        "frequency",
        F.round("importance_score", 2).alias("importance"),
        "trend",
        "status",
        _day("first_seen").alias("first_seen"),
        _day("last_seen").alias("last_seen"),
        S.tags_text("tags").alias("tags"),
    )


def sheet_rows(demands: DataFrame) -> DataFrame:
    """Export rows with the name of their category sheet (at most 31 characters)."""
    name = F.coalesce(S.blank_to_null("category"), F.lit(dims.UNCATEGORISED))
    return export_rows(demands).withColumn("sheet", F.left(name, F.lit(31)))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV by descending frequency; the header of each file starts with a byte order mark."""
    ordered = rows.select(*EXPORT_HEADERS).orderBy(F.desc("frequency"), "id")
    marked = ordered.toDF(BYTE_ORDER_MARK + "ID", *list(EXPORT_HEADERS.values())[1:])
    marked.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an export written by :func:`write_csv`, with their types.

    Nulls are written as nothing and empty texts as quotes.
    """
    kinds = {"id": "bigint", "frequency": "bigint", "importance": "double"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in EXPORT_HEADERS)
    reader = spark.read.schema(schema).option("header", True).option("escape", '"')
    # A null value that no text holds; otherwise quoted empty texts would be read as nulls.
    return reader.option("nullValue", "\u0000").csv(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Property documents ``(id, properties)`` as JSON lines."""
    line = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"properties":'), F.col("properties"), F.lit("}"))
    documents.select(line.alias("value")).write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents written by :func:`write_documents`."""
    head = r'^\{"id":(-?[0-9]+),"properties":(.*)\}$'
    lines = spark.read.text(path)
    return lines.select(
        F.regexp_extract("value", head, 1).cast("bigint").alias("id"), F.regexp_extract("value", head, 2).alias("properties")
    )


def write_sheets(rows: DataFrame, path: str) -> None:
    """One folder of files per category sheet, each file in descending frequency.

    A range split on (sheet, frequency) spreads a dominant category over many tasks.
    """
    ordered = rows.repartitionByRange("sheet", F.desc("frequency"), "id").sortWithinPartitions(
        "sheet", F.desc("frequency"), "id"
    )
    ordered.write.mode("overwrite").option("header", True).partitionBy("sheet").csv(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as text files in reading order."""
    lines.orderBy("section", "ord").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def _lines(df: DataFrame, section: int, lines: Column) -> DataFrame:
    return df.select(F.posexplode(lines).alias("ord", "line")).select(
        F.lit(section).cast("bigint").alias("section"), F.col("ord").cast("bigint").alias("ord"), "line"
    )


def _table(section: int, heading: str, head: list[str], body: DataFrame, empty: str | None) -> DataFrame:
    """A heading, a table header, ``body`` rows ``(ord, line)`` and a closing blank line."""

    def frame_lines(lines: list[str]) -> Column:
        places = [*range(len(lines)), _LAST]
        return F.array(
            *[F.struct(F.lit(p).cast("bigint").alias("ord"), F.lit(x).alias("line")) for p, x in zip(places, [*lines, ""])]
        )

    framed = frame_lines([heading, "", *head])
    n = body.agg(F.count(F.lit(1)).alias("n"))
    if empty is not None:
        framed = F.when(F.col("n") > 0, framed).otherwise(frame_lines([heading, "", empty]))
    here = F.lit(section).cast("bigint").alias("section")
    around = n.select(F.inline(framed)).select(here, "ord", "line")
    return around.unionByName(body.select(here, (F.col("ord") + 10).cast("bigint").alias("ord"), "line"))


def _cells(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _one_digit(c: str) -> Column:
    return F.format_string("%.1f", F.round(c, 1))


def weekly_report(articles: DataFrame, demands: DataFrame, as_of: Column, articles_as_of: Column | None = None) -> DataFrame:
    """The weekly Markdown report as rows ``(section, ord, line)``."""
    a_now = as_of if articles_as_of is None else articles_as_of
    week = F.make_dt_interval(F.lit(7))
    fresh = demands.where(F.col("first_seen") >= as_of - week)
    recent = articles.where(F.col("crawl_time") >= a_now - week)

    counts = demands.agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("first_seen") >= as_of - week).alias("nd"))
    text = lambda c: F.col(c).cast("string")
    n_articles = articles.agg(F.count(F.lit(1)).cast("string").alias("n")).scalar()
    n_recent = recent.agg(F.count(F.lit(1)).cast("string").alias("n")).scalar()
    overview = _lines(
        counts,
        1,
        F.array(
            F.lit("## 本周概览"),
            F.lit(""),
            F.lit("| 指标 | 数量 |"),
            F.lit("|------|------|"),
            _cells(F.lit("新发现需求"), text("nd")),
            _cells(F.lit("新增文章"), n_recent),
            _cells(F.lit("需求总数"), text("d")),
            _cells(F.lit("文章总数"), n_articles),
            F.lit(""),
        ),
    )
    title = F.concat(F.lit("# 职场需求周报 ("), F.date_format(as_of, "yyyy-MM-dd"), F.lit(")"))
    heading = _lines(demands.sparkSession.range(1), 0, F.array(title, F.lit("")))

    category = F.coalesce(S.blank_to_null("category"), F.lit("-"))
    row = [F.col("title"), category, F.col("frequency").cast("string"), _one_digit("importance_score")]
    new_rows = fresh.select(F.col("id").alias("ord"), _cells(*row).alias("line"))
    risers = library.ranked_top(demands.where("trend = 'rising'"), "frequency")
    rising_rows = risers.select(F.col("rank").alias("ord"), _cells(text("rank"), *row).alias("line"))
    hot = library.ranked_top(recent, "heat_score")
    hot_rows = hot.select(
        F.col("rank").alias("ord"),
        _cells(text("rank"), F.col("title"), F.col("platform"), _one_digit("heat_score")).alias("line"),
    )
    shares = stats.category_pct_report(demands)
    share_rows = _ranked_shares(shares)

    return (
        heading.unionByName(overview)
        .unionByName(
            _table(2, "## 新发现的需求", ["| 标题 | 分类 | 频次 | 重要性 |", "|------|------|------|--------|"], new_rows, "本周暂无新发现的需求。")
        )
        .unionByName(
            _table(
                3,
                "## 趋势上升 TOP 10",
                ["| 排名 | 标题 | 分类 | 频次 | 重要性 |", "|------|------|------|------|--------|"],
                rising_rows,
                "暂无趋势上升的需求。",
            )
        )
        .unionByName(
            _table(4, "## 热门文章 TOP 10", ["| 排名 | 标题 | 平台 | 热度 |", "|------|------|------|------|"], hot_rows, "本周暂无热门文章。")
        )
        .unionByName(_table(5, "## 分类统计", ["| 分类 | 数量 | 占比 |", "|------|------|------|"], share_rows, None))
    )


def _ranked_shares(shares: DataFrame) -> DataFrame:
    """Largest category first; one row per category, so one task ranks them."""
    rank = F.row_number().over(W.orderBy(F.desc("count"), "category"))
    return shares.select(
        rank.cast("bigint").alias("ord"), _cells(F.col("category"), F.col("count").cast("string"), F.col("pct")).alias("line")
    )


def property_documents(demands: DataFrame) -> DataFrame:
    """One nested property document per demand, as JSON text."""
    tags = F.coalesce(S.json_list("tags"), S.comma_list("tags"), F.array().cast("array<string>"))
    text = lambda c: F.struct(F.struct(c.alias("content")).alias("text"))
    choice = lambda c: F.struct(F.struct(c.alias("name")).alias("select"))
    number = lambda c: F.struct(c.alias("number"))
    category = F.coalesce(S.blank_to_null("category"), F.lit(dims.UNCATEGORISED))
    doc = F.struct(
        F.struct(F.array(text(F.col("title"))).alias("title")).alias("Title"),
        choice(category).alias("Category"),
        number(F.col("frequency")).alias("Frequency"),
        number(F.round("importance_score", 2)).alias("Importance"),
        choice(F.col("trend")).alias("Trend"),
        choice(F.col("status")).alias("Status"),
        F.struct(F.transform(tags, lambda t: F.struct(t.alias("name"))).alias("multi_select")).alias("Tags"),
    )
    return demands.select("id", F.to_json(doc).alias("properties"))


def sync_plan(demands: DataFrame, pages: DataFrame) -> DataFrame:
    """Whether each demand updates an existing page of its title or creates one."""
    last = pages.where("title <> ''").groupBy("title").agg(F.max_by("page_id", "ord").alias("page_id"))
    planned = demands.select("id", "title").join(last, "title", "left")
    return planned.withColumn("action", F.when(F.col("page_id").isNull(), "create").otherwise("update"))
