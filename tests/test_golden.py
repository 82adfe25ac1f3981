"""Literal cases: scores, classes, matching, parsing, cleaning."""

import re

import pytest
from pyspark.sql import functions as F

from topicpulse import dims
from topicpulse.functions import scalars as S
from topicpulse.functions import text as X
from topicpulse.operators import classify as C
from topicpulse.operators import extraction as E
from topicpulse.operators import library as L
from topicpulse.operators import matching as M
from topicpulse.sources import details as D
from topicpulse.sources import payloads as P


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "counts, low, high",
    [((5000, 200, 50, 10), 0.01, 100), ((0, 0, 0, 0), 0, 0), ((10**6, 10**5, 10**4, 50_000), 99.9, 100.1)],
)
def test_heat_score(spark, counts, low, high):
    assert low <= value(spark, S.heat_score(*[F.lit(c) for c in counts])) <= high


def test_heat_score_ignores_a_zero_maximum(spark):
    assert value(spark, S.heat_score(*[F.lit(9)] * 4, maxima=(0, 0, 0, 0))) == 0.0


def test_categories():
    assert len(dims.VALID_CATEGORIES) == 9
    assert all(len(subs) == 5 for subs, _ in dims.TAXONOMY.values())
    assert "跳槽" in dims.TOPIC_KEYWORDS


@pytest.mark.parametrize(
    "title, description, category, sub",
    [
        ("如何提高职场沟通能力", "跨部门沟通困难", "行业洞察", "沟通协作"),
        ("跳槽时机选择", "什么时候跳槽最合适", "职业发展", "跳槽求职"),
        ("xyz", "abc", "行业洞察", "综合"),
    ],
)
def test_classify(spark, title, description, category, sub):
    got = value(spark, C.classify(F.lit(title), F.lit(description)))
    assert (got["category"], got["subcategory"]) == (category, sub)


@pytest.mark.parametrize("given, want", [("职业发展", "职业发展"), (" 薪酬福利 ", "薪酬福利"), ("no", "行业洞察")])
def test_valid_category(spark, given, want):
    assert value(spark, L.valid_category(F.lit(given))) == want


def test_ratio(spark):
    got = value(spark, M.indel_ratio(F.lit("职场沟通效率低下"), F.lit("职场沟通效率低")))
    assert got == pytest.approx(14 / 15)


@pytest.mark.parametrize(
    "response, failure",
    [
        ('{"demands": []}', None),
        ('```json\n{"demands": []}\n```', None),
        ('Here is the result: {"demands": []}', None),
        ("no json here", "no object"),
        ('{"demands": [', "bad json"),
        ('{"demands": []} trailing', "bad json"),
    ],
)
def test_parse_response(spark, response, failure):
    rows = spark.createDataFrame([(1, response)], "article_id bigint, response string")
    assert E.parse_response(rows).first()["failure"] == failure


def test_render_keeps_unknown_placeholders(spark):
    assert value(spark, E.render("Hello {name}, welcome to {place}!", name=F.lit("Alice"))) == "Hello Alice, welcome to {place}!"
    assert value(spark, E.render("{{x}} {a}{b}", a=F.lit("{b}"), b=F.lit("2"))) == "{x} {b}2"


@pytest.mark.parametrize("text, n", [("1.2万", 12_000), ("3亿", 300_000_000), ("1,234次", 1234), ("", 0), ("x万", 0), (None, 0)])
def test_parse_count(spark, text, n):
    assert one(spark, S.parse_count("t"), text) == n


SAMPLES = [
    "点击关注我们！\n正文　 内容\r\n\r\n\r\n尾部",
    "扫码领取 资料\n下载 APP 看\n  广告 \nhttps://a.b/c?d=1 @someone 微博：abc",
    "版权所有 © 2024 Acme\nAll rights reserved.\n本文来自 x\n来源：每日 报\n阅读原文",
    "plain text with odd\x0bspaces\x85and — dashes",
    "",
]


def _python_clean(text: str) -> str:
    """The same steps in plain Python."""
    strip = lambda p: re.compile(p.replace("(?iu)", "(?i)"))
    for p in X.AD_PATTERNS + X.BOILERPLATE_PATTERNS:
        text = strip(p).sub("", text)
    text = re.sub(r"[^\S\n]+", " ", text)
    out = []
    for line in (x.strip() for x in text.splitlines()):
        if line or not out or out[-1]:
            out.append(line)
    return "\n".join(out).strip()


@pytest.mark.parametrize("text", SAMPLES)
def test_cleaning_agrees_with_python(spark, text):
    assert one(spark, X.clean_text(F.col("t")), text) == _python_clean(text)


def test_strip_html(spark):
    page = "<html><!-- c --><script>var a='<p>';</script><p>A &amp;amp; B</p> <b>c</b>d</html>"
    assert one(spark, X.strip_html(F.col("t")), page) == "A & B\n \nc\nd"


def test_detail_reads_page_state(spark):
    page = '<script>window.initialState={"articleDetail":{"articleDetailData":{"data":{"widgetContent":"body","summary":"s"}}}};</script>'
    row = D.detail_fields("kr36", spark.createDataFrame([(1, page)], "payload_id bigint, payload string")).first()
    assert (row["content"], row["summary"]) == ("body", "s")


def test_detail_falls_back_to_the_container(spark):
    page = '<meta name="description" content="about"><div class="article-content"><p>one</p><p>two</p></div>'
    row = D.detail_fields("kr36", spark.createDataFrame([(1, page)], "payload_id bigint, payload string")).first()
    assert (row["content"], row["summary"]) == ("one\ntwo", "about")
    assert row["raw_html"] == '<div class="article-content"><p>one</p><p>two</p></div>'


def test_a_source_can_be_plugged_in(spark):
    P.register("echo", lambda rows: rows.withColumn("title", F.col("payload")))
    rows = spark.createDataFrame([(1, "x")], "payload_id bigint, payload string")
    assert P.normalize("echo", rows).first()["title"] == "x"
    del P.NORMALIZERS["echo"]


def test_bad_payload_gives_no_rows(spark):
    rows = spark.createDataFrame([(1, "not json"), (2, '{"data": 3}'), (3, None)], "payload_id bigint, payload string")
    assert all(P.normalize(p, rows).count() == 0 for p in P.NORMALIZERS)
