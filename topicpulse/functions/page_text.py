"""Main text of pages, by tables of their tags.

A page is cut at its tags; every tag with the text behind it is a row. Windows over these
rows give each element's span (an end tag closes the innermost open element of its name; an
element that nothing closes reaches to the end of the page) and running sums of text give its
length. Rules then rank elements, and the texts inside the chosen span are joined. Equal
pages are read once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicpulse.functions import text as X
from topicpulse.session import saved

# Where pages keep their article body, best first.
ARTICLE_SELECTORS = [
    "article", "[role='main']", ".article-content", ".article-body", ".post-content", ".post-body",
    ".entry-content", ".content-body", ".rich_media_content", "#js_content", "div.content",
    "div.main-content", "div.text", "div.body",
]
NON_CONTENT_TAGS = ["script", "style", "nav", "header", "footer", "aside", "iframe", "noscript", "form"]
FEED_SELECTORS = ["article", "[role=main]", ".post-content", ".article-content", ".entry-content", "#content", "main"]
FEED_NON_CONTENT = ["script", "style", "nav", "header", "footer"]
BAIJIAHAO_SELECTORS = [
    ".article-content", "#article-content", ".index-module_articleWrap", "[class*=article-content]", ".mainContent", "article",
]

LEAST_FEED_CHARS = 100
_ROOT = "page"
_VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
_TAG = r"(?s)<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>([^<]*+(?:<(?![/a-zA-Z])[^<]*+)*+)"
_SELECTOR = re.compile(r"([a-z]*)(?:([.#])([\w-]+)|\[(\w+)(\*?)='?([\w-]+)'?\])?")


def _attribute(name: str) -> Column:
    pattern = rf"""(?is)(?:^|[\s"'])@\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""".replace("@", name)
    return F.concat(*(F.regexp_extract("attributes", pattern, k) for k in (1, 2, 3)))


def _matches(selector: str) -> Column:
    """Whether a start tag fits a selector of one step."""
    tag, kind, name, attribute, part, value = _SELECTOR.fullmatch(selector).groups()
    hit = F.col("tag") == tag if tag else F.lit(True)
    if kind == ".":
        hit &= F.concat(F.lit(" "), "class", F.lit(" ")).contains(f" {name} ")
    elif kind == "#":
        hit &= F.col("id") == name
    elif attribute:
        hit &= F.col(attribute).contains(value) if part else F.col(attribute) == value
    return hit


def tag_rows(pages: DataFrame, drop: list[str], twice: bool = False) -> DataFrame:
    """(page, pos, closing, tag, attributes, text, size, full) of every tag, with the text up to the next one.

    ``size`` and ``full`` are the characters and the non-empty texts before the row. Comments and
    the elements named in ``drop`` are left out; these end at their first end tag.
    """
    shown = F.regexp_replace("html", r"(?s)<!--.*?(?:-->|\z)", "")
    shown = F.regexp_replace(shown, rf"(?is)<({'|'.join([*drop, 'template'])})\b[^>]*>.*?(?:</\1\s*>|\z)", "")
    cut = F.regexp_extract_all(F.concat(F.lit(f"<{_ROOT}>"), shown), F.lit(_TAG), F.lit(0))
    rows = pages.select("page", F.posexplode(cut).alias("pos", "token"))
    own = rows.select(
        "page", "pos", F.col("token").startswith("</").alias("closing"),
        F.lower(F.regexp_extract("token", _TAG, 2)).alias("tag"), F.regexp_extract("token", _TAG, 3).alias("attributes"),
        X.trim_space(X.unescape(F.regexp_extract("token", _TAG, 4), twice)).alias("text"),
    )
    before = W.partitionBy("page").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return own.select(
        "*",
        F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("size"),
        F.coalesce(F.sum((F.col("text") != "").cast("int")).over(before), F.lit(0)).alias("full"),
    )


def elements(rows: DataFrame) -> DataFrame:
    """(page, pos, tag, class, id, role, stop, chars): each element's span of rows, and its text's length with line breaks."""
    in_order = W.partitionBy("page", "tag").orderBy("pos")
    level = F.sum(F.when(F.col("closing"), -1).otherwise(1)).over(in_order)
    leveled = rows.withColumn("level", level + F.col("closing").cast("int"))
    following = W.partitionBy("page", "tag", "level").orderBy("pos")
    whole = W.partitionBy("page")
    ends = leveled.select(
        "*",
        F.lead(F.struct("pos", "size", "full")).over(following).alias("end"),
        F.max(F.col("pos") + 1).over(whole).alias("last"),
        F.max(F.col("size") + F.length("text")).over(whole).alias("all_size"),
        F.max(F.col("full") + (F.col("text") != "").cast("int")).over(whole).alias("all_full"),
    )
    size = F.coalesce("end.size", "all_size") - F.col("size")
    full = F.coalesce("end.full", "all_full") - F.col("full")
    opened = ends.filter(~F.col("closing") & ~F.col("tag").isin(_VOID))
    names = [F.when(F.col("attributes").contains("="), value).otherwise("").alias(name) for name, value in (
        ("class", F.regexp_replace(_attribute("class"), r"\s+", " ")), ("id", _attribute("id")), ("role", _attribute("role"))
    )]
    return opened.select(
        "page", "pos", "tag", *names, F.coalesce("end.pos", "last").alias("stop"), (size + F.greatest(full - 1, F.lit(0))).alias("chars")
    )


def _first(found: DataFrame, *order: Column) -> DataFrame:
    """(page, pos, stop) of each page's first element in ``order``."""
    return found.groupBy("page").agg(F.min(F.struct(*order, "pos", "stop")).alias("m")).select("page", "m.pos", "m.stop")


def _ranked(found: DataFrame, selectors: list[str]) -> Column:
    place = F.lit(None).cast("int")
    for k, selector in reversed(list(enumerate(selectors))):
        place = F.when(_matches(selector), k).otherwise(place)
    return place


def _joined(rows: DataFrame, spans: DataFrame, by: list[str], glue: str) -> DataFrame:
    """The texts inside each span, in page order."""
    s = spans.select(*by, F.col("pos").alias("start"), "stop")
    inside = s.join(rows.filter("text <> ''").select("page", "pos", "text"), "page").filter("pos >= start AND pos < stop")
    grouped = inside.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "text")))["text"].alias("t"))
    return grouped.select(*by, F.array_join("t", glue).alias("text"))


def _article(pages: DataFrame) -> DataFrame:
    """Paragraphs of the first article container, else of the body; without paragraphs all its text."""
    rows = saved(tag_rows(pages, NON_CONTENT_TAGS, twice=True), "page-tags")
    found = saved(elements(rows), "page-elements")
    ranks = found.withColumn("place", _ranked(found, [*ARTICLE_SELECTORS, "body", _ROOT])).filter("place IS NOT NULL")
    box = _first(ranks, F.col("place"))
    limits = box.select("page", F.col("pos").alias("box_start"), F.col("stop").alias("box_stop"))
    inside = found.filter("tag = 'p'").join(limits, "page").filter("pos > box_start AND pos < box_stop")
    p = inside.select("page", "pos", F.least("stop", "box_stop").alias("stop"), F.col("pos").alias("p"))
    of_p = p.select("page", "p").join(_joined(rows, p, ["page", "p"], " "), ["page", "p"], "left")
    of_p = of_p.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("p", F.coalesce("text", F.lit("")).alias("text"))))["text"].alias("t"))
    whole = _joined(rows, box, ["page"], "\n")
    both = box.select("page").join(of_p, "page", "left").join(whole, "page", "left")
    return both.select("page", X.normalize_whitespace(F.coalesce(F.array_join("t", "\n"), "text", F.lit(""))).alias("text"))


def _feed(pages: DataFrame) -> DataFrame:
    """The first element of the best selector whose text is long enough, else the body."""
    rows = saved(tag_rows(pages, FEED_NON_CONTENT), "page-tags")
    found = saved(elements(rows), "page-elements")
    asked = [*FEED_SELECTORS, "body", _ROOT]
    # An element may fit several selectors; each selector's first element counts.
    fits = F.filter(F.array(*(F.when(_matches(c), k) for k, c in enumerate(asked))), lambda x: x.isNotNull())
    firsts = found.select("*", F.explode(fits).alias("place")).groupBy("page", "place")
    firsts = firsts.agg(F.min(F.struct("pos", "stop", "chars")).alias("m")).select("page", "place", "m.*")
    long = firsts.filter((F.col("chars") > LEAST_FEED_CHARS) | (F.col("place") >= len(FEED_SELECTORS)))
    return _joined(rows, _first(long, F.col("place")), ["page"], "\n")


def _baijiahao(pages: DataFrame) -> DataFrame:
    """The first known container, else the longest div (the first among equals)."""
    rows = saved(tag_rows(pages, ["script", "style"]), "page-tags")
    found = saved(elements(rows), "page-elements")
    place = F.coalesce(_ranked(found, BAIJIAHAO_SELECTORS), F.when(F.col("tag") == "div", len(BAIJIAHAO_SELECTORS)))
    ranks = found.withColumn("place", place).filter("place IS NOT NULL")
    longest = F.when(F.col("place") == len(BAIJIAHAO_SELECTORS), -F.col("chars")).otherwise(0)
    return _joined(rows, _first(ranks, F.col("place"), longest.alias("longest")), ["page"], "\n")


_RULES = {"article": _article, "feed": _feed, "baijiahao": _baijiahao}


def with_main_text(rows: DataFrame, html: str, into: str, rule: str = "article") -> DataFrame:
    """``rows`` with the main text of their page by one of the rules ``article``, ``feed``, ``baijiahao``.

    A null or empty page, and one without any text, has an empty main text.
    """
    key = F.md5(F.coalesce(F.col(html), F.lit("")))
    pages = rows.select(key.alias("page"), F.coalesce(F.col(html), F.lit("")).alias("html")).dropDuplicates(["page"])
    texts = _RULES[rule](pages).select(F.col("page").alias("_page"), F.col("text").alias("_main"))
    joined = rows.withColumn("_key", key).join(texts, F.col("_key") == F.col("_page"), "left")
    return joined.withColumn(into, F.coalesce("_main", F.lit(""))).drop("_key", "_page", "_main")
