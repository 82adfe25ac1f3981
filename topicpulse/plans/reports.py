"""Exports and reports as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse.operators import reports as P
from topicpulse.operators import stats as A
from topicpulse.plans.library import _CATEGORY_SUMMARY, ARTICLES_AS_OF, AS_OF
from topicpulse.plans.registry import query
from topicpulse.session import new_folder
from topicpulse.sources.tables import SampleStore as Store

_LIST = "CASE WHEN json_valid(tags) THEN CAST(CAST(tags AS JSON) AS VARCHAR[]) END"
_ROWS = f"""SELECT id, title, coalesce(category, '') AS category, coalesce(subcategory, '') AS subcategory, frequency,
  round(importance_score, 2) AS importance, trend, status, coalesce(strftime(first_seen, '%Y-%m-%d'), '') AS first_seen,
  coalesce(strftime(last_seen, '%Y-%m-%d'), '') AS last_seen, coalesce(array_to_string({_LIST}, ', '), tags, '') AS tags FROM demands"""


@query("snk01_export_rows", _ROWS)
def export_rows(s: Store) -> DataFrame:
    return P.export_rows(s.demands)


@query("snk01_export_files", _ROWS)
def export_files(s: Store) -> DataFrame:
    """The export written as CSV, with its mark and in its order, and read back."""
    path = new_folder(s.spark, "export")
    P.write_csv(P.export_rows(s.demands), path)
    return P.read_csv(s.spark, path)


@query("snk02_export_by_category", f"SELECT *, left(coalesce(nullif(category, ''), '未分类'), 31) AS sheet FROM ({_ROWS})")
def export_by_category(s: Store) -> DataFrame:
    return P.sheet_rows(s.demands)


@query(
    "snk02_sheet_files",
    f"SELECT left(coalesce(nullif(category, ''), '未分类'), 31) AS sheet, count(*) AS n, CAST(sum(frequency) AS BIGINT) AS frequency FROM ({_ROWS}) GROUP BY 1",
)
def sheet_files(s: Store) -> DataFrame:
    """Category sheets written and read back."""
    path = new_folder(s.spark, "sheets")
    P.write_sheets(P.sheet_rows(s.demands), path)
    rows = s.spark.read.option("header", True).option("inferSchema", False).csv(path)
    return rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("frequency").cast("bigint")).alias("frequency"))


@query("snk03_export_category_stats", _CATEGORY_SUMMARY)
def export_category_stats(s: Store) -> DataFrame:
    return A.category_summary(s.demands)


_HEADS = """SELECT 0::BIGINT AS section, i AS ord, l AS line FROM (SELECT unnest([0, 1]) AS i, unnest(['# 职场需求周报 (2024-03-31)', '']) AS l)
UNION ALL SELECT 1, i, l FROM (SELECT unnest(range(9)) AS i, unnest(['## 本周概览', '', '| 指标 | 数量 |', '|------|------|',
   concat('| 新发现需求 | ', (SELECT count(*) FROM demands WHERE first_seen >= {as_of} - INTERVAL 7 DAY), ' |'),
   concat('| 新增文章 | ', (SELECT count(*) FROM articles WHERE crawl_time >= {a_of} - INTERVAL 7 DAY), ' |'),
   concat('| 需求总数 | ', (SELECT count(*) FROM demands), ' |'), concat('| 文章总数 | ', (SELECT count(*) FROM articles), ' |'), '']) AS l)
UNION ALL SELECT 2, i, l FROM (SELECT unnest([0, 1, 2, 3, 4611686018427387904]) AS i, unnest(['## 新发现的需求', '', '| 标题 | 分类 | 频次 | 重要性 |', '|------|------|------|--------|', '']) AS l)
UNION ALL SELECT 3, i, l FROM (SELECT unnest([0, 1, 2, 3, 4611686018427387904]) AS i, unnest(['## 趋势上升 TOP 10', '', '| 排名 | 标题 | 分类 | 频次 | 重要性 |', '|------|------|------|------|--------|', '']) AS l)
UNION ALL SELECT 4, i, l FROM (SELECT unnest([0, 1, 2, 3, 4611686018427387904]) AS i, unnest(['## 热门文章 TOP 10', '', '| 排名 | 标题 | 平台 | 热度 |', '|------|------|------|------|', '']) AS l)
UNION ALL SELECT 5, i, l FROM (SELECT unnest([0, 1, 2, 3, 4611686018427387904]) AS i, unnest(['## 分类统计', '', '| 分类 | 数量 | 占比 |', '|------|------|------|', '']) AS l)""".format(
    as_of=AS_OF, a_of=ARTICLES_AS_OF
)


@query(
    "snk04_weekly_report",
    f"""{_HEADS}
UNION ALL SELECT 2, 10 + id, concat('| ', title, ' | ', coalesce(nullif(category, ''), '-'), ' | ', frequency, ' | ', printf('%.1f', round(importance_score, 1)), ' |')
  FROM demands WHERE first_seen >= {AS_OF} - INTERVAL 7 DAY
UNION ALL SELECT 3, 10 + n, concat('| ', n, ' | ', title, ' | ', coalesce(nullif(category, ''), '-'), ' | ', frequency, ' | ', printf('%.1f', round(importance_score, 1)), ' |')
  FROM (SELECT *, row_number() OVER (ORDER BY frequency DESC, id) AS n FROM demands WHERE trend = 'rising') WHERE n <= 10
UNION ALL SELECT 4, 10 + n, concat('| ', n, ' | ', title, ' | ', platform, ' | ', printf('%.1f', round(heat_score, 1)), ' |')
  FROM (SELECT *, row_number() OVER (ORDER BY heat_score DESC, id) AS n FROM articles WHERE crawl_time >= {ARTICLES_AS_OF} - INTERVAL 7 DAY) WHERE n <= 10
UNION ALL SELECT 5, 10 + row_number() OVER (ORDER BY c DESC, category), concat('| ', category, ' | ', c, ' | ', printf('%.1f%%', round(c / (SELECT count(*) FROM demands) * 100.0, 1)), ' |')
  FROM (SELECT coalesce(nullif(category, ''), '未分类') AS category, count(*) AS c FROM demands GROUP BY 1)""",
)
def weekly_report(s: Store) -> DataFrame:
    return P.weekly_report(s.articles, s.demands, s.as_of, s.articles_as_of)


_DOCUMENTS = f"""SELECT id, CAST(json_object('Title', json_object('title', json_array(json_object('text', json_object('content', title)))),
         'Category', json_object('select', json_object('name', coalesce(nullif(category, ''), '未分类'))),
         'Frequency', json_object('number', frequency), 'Importance', json_object('number', round(importance_score, 2)),
         'Trend', json_object('select', json_object('name', trend)), 'Status', json_object('select', json_object('name', status)),
         'Tags', json_object('multi_select', to_json(list_transform(CASE WHEN tags IS NULL THEN []
            WHEN json_valid(tags) THEN {_LIST} ELSE list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x <> '') END,
            lambda x: {{'name': x}})))) AS VARCHAR) AS properties FROM demands"""


@query("snk05_property_documents", _DOCUMENTS)
def property_documents(s: Store) -> DataFrame:
    return P.property_documents(s.demands)


@query("snk05_document_files", _DOCUMENTS)
def document_files(s: Store) -> DataFrame:
    """Documents written as JSON lines and read back."""
    path = new_folder(s.spark, "documents")
    P.write_documents(P.property_documents(s.demands), path)
    return P.read_documents(s.spark, path)


@query(
    "snk06_sync_plan",
    """SELECT d.id, d.title, p.page_id, CASE WHEN p.page_id IS NULL THEN 'create' ELSE 'update' END AS action FROM demands d LEFT JOIN
       (SELECT title, arg_max(concat('page-', id), id) AS page_id FROM demands WHERE status = 'confirmed' GROUP BY title) p ON p.title = d.title""",
)
def sync_plan(s: Store) -> DataFrame:
    pages = s.demands.where("status = 'confirmed'").select(
        "title", F.concat(F.lit("page-"), F.col("id").cast("string")).alias("page_id"), F.col("id").alias("ord")
    )
    return P.sync_plan(s.demands, pages)
