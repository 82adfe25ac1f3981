"""Cleaning skips patterns that a text cannot match, and detail payloads are parsed once."""

import re

from pyspark.sql import functions as F

from topicpulse.functions import text as X
from topicpulse.sources import details as D

TEXTS = [
    None, "", "plain text", "see http://a.example/x?y=1 now", "mail @someone about it", "café @ann © 2024 Some Corp rest",
    "COPYRIGHT 2024 abc All Rights Reserved. end", "a &copy; 2020 b", "点击关注我们 正文", "下载 APP now http://x.example",
    "来源: abc 正文", "广告\n正文", "B站: abc def", "a\t\x0b\x1c\x1f\x85b     c    　d", "a ​ b \n\n\n\n c",
]


def _plain(text: F.Column, patterns: list[str]) -> F.Column:
    for p in patterns:
        text = F.regexp_replace(text, "(?Ud)" + p, "")
    return text


def test_removals_equal_the_bare_patterns(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, t string")
    t = F.col("t")
    got = rows.select(
        "t", X.remove_ads(t).alias("ads"), X.remove_boilerplate(t).alias("boiler"), X.normalize_whitespace(t).alias("space"),
        _plain(t, X.AD_PATTERNS).alias("ads2"), _plain(t, X.BOILERPLATE_PATTERNS).alias("boiler2"),
        F.regexp_replace(t, X._ODD_SPACES, "_").alias("odd"),
    ).collect()
    assert [(r.ads, r.boiler) for r in got] == [(r.ads2, r.boiler2) for r in got]
    assert sum(r.ads != r.t for r in got) > 4 and sum(r.boiler != r.t for r in got) > 3
    assert [r.odd for r in got] == [r.t and re.sub(f"[{X._ODD_SPACE}]+", "_", r.t) for r in got]
    assert got[-2].space == "a b c d" and got[-1].space == "a ​ b\n\nc"


def test_texts_without_chinese_skip_chinese_words(spark):
    plan = spark.range(1).select(X.remove_ads(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert X._HAN in plan


def test_rows_without_content_go_and_the_payload_is_parsed_once(spark, tmp_path):
    payloads = ['{"data":{"content":"<p>one</p> two"}}', '{"data":{"content":""}}', '{"data":{}}', "no json", None, '{"data":{"content":"<br>"}}']
    rows = spark.createDataFrame(list(enumerate(payloads)), "payload_id long, payload string")
    rows.write.parquet(str(tmp_path / "rows"))
    found = D.detail_fields("toutiao", spark.read.parquet(str(tmp_path / "rows")))
    assert sorted(map(tuple, found.collect())) == [(0, "one two", "<p>one</p> two", "one two"), (5, "", "<br>", "")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
