"""Detail payloads and pages to ``content``, ``raw_html`` and ``summary``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicpulse.functions import html_dom as D
from topicpulse.functions import page_text
from topicpulse.functions import scalars as S
from topicpulse.functions import text as X
from topicpulse.sources.payloads import get, text, truthy

# Containers of the article body on each site.
BODY_SELECTORS = {
    "kr36": "div.article-content, div.articleDetailContent",
    "huxiu": "div.article-content-wrap, div.article__content, div#article_content, div.text-content",
    "weixin_sogou": "#js_content",
}
SSR_CONTENT = r'(?s)articleInfo.*?"content"\s*:\s*"(.*?)"'
ARTICLE_TAG = r"(?s)<article[^>]*>(.*?)</article>"
BILIBILI_BODY = r'(?s)<div\s+class="article-content"[^>]*>(.*?)</div>'
DOUBAN_BODIES = [
    r'(?s)<div\s+class="topic-content"[^>]*>(.*?)</div>',
    r'(?s)<div\s+class="rich-content"[^>]*>(.*?)</div>',
]
KR36_STATE = r"(?s)(?:window\.__initialState__|window\.initialState)\s*=\s*(\{.+?\});?\s*(?:</script>|\z)"
HUXIU_STATE = r"(?s)(?:__NUXT__|__INITIAL_STATE__)\s*=\s*(\{.+?\});?\s*</script>"


def _fields(rows: DataFrame, content: Column, raw_html: Column, summary: Callable[[Column], Column]) -> DataFrame:
    """Content first; the summary is made from the finished column, not from its formula."""
    done = rows.withColumn("content", content).withColumn("raw_html", raw_html)
    return done.select("payload_id", "content", "raw_html", summary(F.col("content")).alias("summary"))


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc", F.try_parse_json("payload"))


def meta_description(page: Column) -> Column:
    q = r"""["']"""
    name, value = rf"name={q}description{q}", rf"content={q}([^\"']*){q}"
    either = [rf"(?is)<meta[^>]*\b{name}[^>]*\b{value}", rf"(?is)<meta[^>]*\b{value}[^>]*\b{name}"]
    return F.coalesce(*[S.blank_to_null(X.unescape(F.regexp_extract(page, p, 1))) for p in either])


def zhihu_answer(rows: DataFrame) -> DataFrame:
    raw = text(F.col("doc"), "$.content")
    content = X.clean_text(raw)
    return _fields(_parsed(rows), content, raw, lambda c: S.make_summary(c, get(F.col("doc"), "$.excerpt")))


def zhihu_question(rows: DataFrame) -> DataFrame:
    """An empty excerpt stays empty; only an absent one falls back."""
    raw = text(F.col("doc"), "$.detail")
    content = X.clean_text(raw)
    return _fields(_parsed(rows), content, raw, lambda c: F.coalesce(get(F.col("doc"), "$.excerpt"), S.text_prefix(c)))


def juejin(rows: DataFrame) -> DataFrame:
    raw = text(F.col("doc"), "$.data.article_info.mark_content")
    content = X.markdown_to_text(raw)
    given = get(F.col("doc"), "$.data.article_info.brief_content")
    return _fields(_parsed(rows), content, raw, lambda c: S.make_summary(c, given))


def toutiao_api(rows: DataFrame) -> DataFrame:
    """Rows without content are dropped: they need the page instead.

    An empty list drops a row; a filter would be moved below, where it parses the payload once more.
    """
    found = F.filter(F.array(text(F.col("doc"), "$.data.content")), lambda t: t != "")
    given = _parsed(rows).select("payload_id", F.explode(found).alias("raw"))
    return _fields(given, X.strip_tags(F.col("raw")), F.col("raw"), lambda c: S.make_summary(c, ellipsis=True))


def toutiao_page(rows: DataFrame) -> DataFrame:
    """Server-side state first, else the article element."""
    page = F.col("payload")
    state = F.regexp_extract(page, SSR_CONTENT, 1)
    for code, char in (("\\u003C", "<"), ("\\u003E", ">"), ("\\u0026", "&"), ('\\"', '"')):
        state = F.replace(state, F.lit(code), F.lit(char))
    article = F.regexp_extract(page, ARTICLE_TAG, 1)
    raw = F.when(X.strip_tags(state) != "", state).otherwise(article)
    content = X.strip_tags(raw)
    return _fields(rows, content, raw, lambda c: S.make_summary(c, ellipsis=True))


def xiaohongshu(rows: DataFrame) -> DataFrame:
    card = "$.data.items[0].note_card"
    body, title = text(F.col("doc"), f"{card}.desc"), S.blank_to_null(get(F.col("doc"), f"{card}.title"))
    full = F.coalesce(F.concat(title, F.lit("\n\n"), body), body)
    return _fields(_parsed(rows), full, body, lambda c: S.make_summary(c, ellipsis=True))


def maimai(rows: DataFrame) -> DataFrame:
    raw = text(F.col("doc"), "$.data.gossip.text")
    content = X.clean_text(raw)
    return _fields(_parsed(rows), content, raw, lambda c: X.trim_space(S.text_prefix(c)))


def bilibili(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """Body container, else all text of the page; ``cap`` may bound that fallback."""
    page = F.col("payload")
    body = F.regexp_extract(page, BILIBILI_BODY, 1)
    rest = X.strip_tags(page)
    if cap is not None:
        rest = F.left(rest, F.lit(cap))
    content = F.when(page.rlike(BILIBILI_BODY), X.strip_tags(body)).otherwise(rest)
    given = F.col("given") if "given" in rows.columns else F.lit(None).cast("string")
    return _fields(rows, content, page, lambda c: S.make_summary(c, given, ellipsis=True))


def douban(rows: DataFrame) -> DataFrame:
    page = F.col("payload")
    found = [X.trim_space(F.regexp_extract(page, p, 1)) for p in DOUBAN_BODIES]
    raw = F.when(X.strip_tags(found[0]) != "", found[0]).otherwise(found[1])
    content = X.strip_tags(raw, collapse=True)
    return _fields(rows, content, raw, lambda c: S.make_summary(c, ellipsis=True))


_BOX = T.StructType([T.StructField("text", T.StringType()), T.StructField("raw", T.StringType())])


def container_text(page: Column, selectors: str) -> Column:
    """``text`` and ``raw`` of the first matching element; pages are read a few at a time."""

    def one(page: str | None) -> tuple[str, str]:
        node = D.parse(page or "").first(D.any_of(selectors))
        return (node.text("\n", strip=True), node.markup()) if node else ("", "")

    def boxes(pages: list[str | None]) -> pa.StructArray:
        texts, raws = zip(*map(one, pages))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(raws, pa.string())], ["text", "raw"])

    @F.arrow_udf(_BOX)
    def container(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return X.in_slices(pages, boxes)

    return container(page)


def _with_state(rows: DataFrame, site: str, pattern: str, bodies: list[str], abouts: list[str]) -> DataFrame:
    state = F.try_parse_json(F.regexp_extract("payload", pattern, 1))
    found = rows.withColumn("doc", state).withColumn("box", container_text(F.col("payload"), BODY_SELECTORS[site]))
    doc = F.col("doc")
    body = truthy(doc, *bodies)
    content = F.coalesce(body, F.col("box.text"), F.lit(""))
    raw = F.coalesce(body, F.col("box.raw"), F.lit(""))
    summary = F.coalesce(truthy(doc, *abouts), meta_description(F.col("payload")), F.lit(""))
    return _fields(found, content, raw, lambda _: summary)


def kr36(rows: DataFrame) -> DataFrame:
    """Page state, else the body container; summary from state or the meta tag."""
    roots = ["$.articleDetail.articleDetailData.data", "$.articleDetail"]
    bodies = [f"{r}.{k}" for r in roots for k in ("widgetContent", "content")]
    return _with_state(rows, "kr36", KR36_STATE, bodies, [f"{r}.summary" for r in roots])


def huxiu(rows: DataFrame) -> DataFrame:
    roots = ["$.data.articleDetail", "$.articleDetail", "$.state.article", "$.data.article"]
    abouts = [f"{r}.{k}" for r in roots for k in ("summary", "description")]
    return _with_state(rows, "huxiu", HUXIU_STATE, [f"{r}.content" for r in roots], abouts)


def weixin(rows: DataFrame) -> DataFrame:
    box = rows.withColumn("box", container_text(F.col("payload"), BODY_SELECTORS["weixin_sogou"]))
    content = X.clean_text(F.col("box.text"))
    return _fields(box, content, F.col("box.raw"), lambda c: X.trim_space(S.text_prefix(c)))


def baidu(rows: DataFrame) -> DataFrame:
    rows = page_text.with_main_text(rows, "payload", "main_text", "baijiahao")
    about = F.trim(meta_description(F.col("payload")))
    return _fields(rows, F.col("main_text"), F.col("payload"), lambda c: F.coalesce(about, X.trim_space(S.text_prefix(c))))


def rss_page(rows: DataFrame) -> DataFrame:
    rows = page_text.with_main_text(rows, "payload", "main_text", "feed")
    about = F.trim(meta_description(F.col("payload")))
    return _fields(rows, F.col("main_text"), F.col("payload"), lambda c: F.coalesce(about, X.trim_space(S.text_prefix(c))))


DETAIL_READERS = {
    "zhihu_answer": zhihu_answer,
    "zhihu_question": zhihu_question,
    "juejin": juejin,
    "toutiao": toutiao_api,
    "toutiao_page": toutiao_page,
    "xiaohongshu": xiaohongshu,
    "maimai": maimai,
    "bilibili": bilibili,
    "douban": douban,
    "kr36": kr36,
    "huxiu": huxiu,
    "weixin_sogou": weixin,
    "baidu_baijiahao": baidu,
    "rss_generic": rss_page,
}


def detail_fields(platform: str, rows: DataFrame) -> DataFrame:
    """``(payload_id, content, raw_html, summary)`` of fetched detail payloads."""
    return DETAIL_READERS[platform](rows)


# --- comments inside pages --------------------------------------------------

# Comment entries of a search-engine page, and their author, text and likes.
COMMENT_LISTS, COMMENT_ITEM = ".comment-list, .c-comment", ".comment-item"
OTHER_COMMENT_LIST, OTHER_COMMENT_ITEM = "[class*=comment]", ".item"
COMMENT_USER = ".comment-user, .user-name, [class*=name]"
COMMENT_TEXT = ".comment-content, .content, [class*=content]"
COMMENT_LIKES = ".like-count, .praise, [class*=like]"

# Reply entries of a discussion page.
REPLY_ITEM = r'(?s)<li[^>]+class="[^"]*comment-item[^"]*"[^>]*>(.*?)</li>'
REPLY_NAME = r'(?s)<a[^>]+class="[^"]*reply-doc[^"]*"[^>]*>.*?<span[^>]*>([^<]+)</span>'
REPLY_TEXT = r'(?s)<p\s+class="[^"]*reply-content[^"]*"[^>]*>(.*?)</p>'
REPLY_VOTES = r'<span\s+class="[^"]*comment-vote[^"]*"[^>]*>\s*(\d+)'


def page_replies(rows: DataFrame) -> DataFrame:
    """Replies of a discussion page; entries without a text element are skipped."""
    items = rows.select("payload_id", F.posexplode(F.regexp_extract_all("payload", F.lit(REPLY_ITEM), F.lit(1))).alias("pos", "li"))
    li = F.col("li")
    return items.where(li.rlike(REPLY_TEXT)).select(
        "payload_id",
        F.col("pos").cast("bigint").alias("pos"),
        X.trim_space(F.regexp_extract(li, REPLY_NAME, 1)).alias("commenter"),
        X.strip_tags(F.regexp_extract(li, REPLY_TEXT, 1)).alias("content"),
        F.coalesce(F.regexp_extract(li, REPLY_VOTES, 1).try_cast("bigint"), F.lit(0)).alias("like_count"),
    )


def baidu_comments(rows: DataFrame) -> DataFrame:
    """Server-rendered comments of a search-engine page; empty ones are skipped."""
    schema = "payload_id BIGINT, pos BIGINT, commenter STRING, content STRING, likes STRING"

    def read(page: str):
        root = D.parse(page)
        boxes = D.below(root, D.any_of(COMMENT_LISTS), D.selector(COMMENT_ITEM))
        boxes += [b for b in D.below(root, D.selector(OTHER_COMMENT_LIST), D.selector(OTHER_COMMENT_ITEM)) if b not in boxes]
        for box in boxes:
            nodes = [box.first(D.any_of(css)) for css in (COMMENT_USER, COMMENT_TEXT, COMMENT_LIKES)]
            who, body, likes = (n.text("", strip=True) if n else "" for n in nodes)
            if body:
                yield who, body, likes or "0"

    def run(batches):
        for batch in batches:
            hits = [(k, i, *c) for k, p in zip(batch["payload_id"], batch["payload"]) for i, c in enumerate(read(p or ""))]
            yield pd.DataFrame(hits, columns=["payload_id", "pos", "commenter", "content", "likes"])

    found = rows.select("payload_id", "payload").mapInPandas(run, schema)
    return found.select("payload_id", "pos", "commenter", "content", S.parse_count("likes").alias("like_count"))
