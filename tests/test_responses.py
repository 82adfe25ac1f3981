"""Responses with text behind the object, and pages in Arrow batches."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicpulse.functions import text as X
from topicpulse.operators.extraction import parse_response
from topicpulse.sources import details


@pytest.mark.parametrize(
    "response, failure",
    [
        ('{"demands": []}', None),
        (' x {"demands": [{"title": "a"}]} ', None),
        ('{"demands": []} {"x": 1}', "bad json"),
        ('{"demands": []} see {note}', "bad json"),
        ('{"a": 1}} x }', "bad json"),
        ('{"demands": []},"x":{"b":2}', "bad json"),
        ("nothing", "no object"),
    ],
)
def test_only_a_single_object_parses(spark, response, failure):
    row = parse_response(spark.createDataFrame([(1, response)], "article_id long, response string")).first()
    assert row.failure == failure


def test_python_holds_a_few_pages_of_a_batch_at_a_time(spark):
    sizes = []
    parts = X.in_slices([pa.array([f"&amp;{i}" for i in range(700)])], lambda some: sizes.append(len(some)) or pa.array(some))
    first = next(parts)
    assert len(first) == X.SLICE_ROWS and sizes == [X.SLICE_ROWS]
    assert sum(map(len, parts)) == 700 - X.SLICE_ROWS and max(sizes) == X.SLICE_ROWS
    pages = spark.createDataFrame([(i, f'<div id="js_content"><p>a{i} &amp; b</p></div>' if i % 3 else None) for i in range(700)], "i int, page string")
    box = details.container_text(F.col("page"), "#js_content")
    got = {r.i: (r.text, r.raw) for r in pages.coalesce(1).select("i", box.alias("box")).select("i", "box.*").collect()}
    want = {i: (f"a{i} & b", f'<div id="js_content"><p>a{i} &amp; b</p></div>') if i % 3 else ("", "") for i in range(700)}
    assert got == want
