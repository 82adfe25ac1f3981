"""Fetched HTML and feeds to the article model.

Regular pages are read with JVM regular expressions; result lists whose meaning
depends on nesting go through one Arrow-batched parse per page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicpulse.functions import html_dom as D
from topicpulse.functions import scalars as S
from topicpulse.functions import text as X
from topicpulse.operators import library
from topicpulse.operators.ingest import first_seen_wins
from topicpulse.sources import payloads as P

# How a discussion group lists its topics.
GROUP_ROW = r'(?s)<tr\s[^>]*class=""[^>]*>(.*?)</tr>'
GROUP_LINK = r'<a[^>]+href="(https://www\.douban\.com/group/topic/(\d+)/)"[^>]*title="([^"]*)"'
GROUP_AUTHOR = r'<a[^>]+href="https://www\.douban\.com/people/[^"]*"[^>]*>([^<]+)</a>'
GROUP_REPLIES = r"<td[^>]*>\s*(\d+)\s*</td>"
GROUP_TIME = r"<td[^>]*nowrap[^>]*>\s*([^<]+)\s*</td>"

# Where sites keep page state in scripts.
PAGE_STATE = r"(?s)(?:__NUXT__|__INITIAL_STATE__)\s*=\s*(\{.+?\});?\s*\z"
STATE_KEYS = ("data", "state", "articleList", "hotList")
STATE_LISTS = [
    path
    for key in STATE_KEYS
    for path in (f"$.{key}", f"$.{key}.articleList", f"$.{key}.dataList", f"$.{key}.list")
]
CARD_SELECTOR = "div.article-item, a.article-item, div.recommend-article-item, div.mob-ctt"

# Fixed value: article triplets inside a search page script.
TRIPLET = r'(?s)"article_url"\s*:\s*"(.*?)".*?"title"\s*:\s*"(.*?)".*?"media_name"\s*:\s*"(.*?)"'


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def group_topics(pages: DataFrame, as_of: Column) -> DataFrame:
    """Topic rows of discussion group pages (``payload_id``, ``payload`` as HTML)."""
    rows = pages.select("payload_id", F.posexplode(F.regexp_extract_all("payload", F.lit(GROUP_ROW), F.lit(1))).alias("pos", "row"))
    r = F.col("row")
    stamp = S.parse_datetime(X.trim_space(_first(r, GROUP_TIME)), as_of)
    return P.articles(
        rows,
        "douban",
        keep=F.col("platform_id") != "",
        platform_id=_first(r, GROUP_LINK, 2),
        title=X.trim_space(_first(r, GROUP_LINK, 3)),
        url=_first(r, GROUP_LINK, 1),
        author=X.trim_space(_first(r, GROUP_AUTHOR)),
        comment_count=F.coalesce(_first(r, GROUP_REPLIES).try_cast("bigint"), F.lit(0).cast("bigint")),
        publish_time=F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"),
    )


_HIT_SCHEMA = "payload_id BIGINT, pos INT, title STRING, href STRING, author STRING, stamp STRING"


def _text(node: D.Node | None, strip: bool = False) -> str:
    return node.text("", strip) if node else ""


def _weixin_hits(page: str) -> Iterator[tuple[str, str, str, str]]:
    root = D.parse(page)
    for item in D.below(root, D.selector(".news-list"), D.selector("li")):
        link = next(iter(D.below(item, D.selector("h3"), D.selector("a"))), None)
        if link is None or not link.attrs.get("href"):
            continue
        by = item.first(D.selector(".account")) or next(iter(D.below(item, D.selector(".s-p"), D.selector("a"))), None)
        when = item.first(D.selector(".s-p")) or item.first(D.selector(".s2"))
        yield _text(link), link.attrs["href"], _text(by), when.attrs.get("t", "") if when else ""


def _baidu_hits(page: str) -> Iterator[tuple[str, str, str, str]]:
    root = D.parse(page)
    for box in root.all(D.any_of(".c-container, [class*=result]")):
        headed = {id(a) for a in D.below(box, D.any_of("h3, .t"), D.selector("a"))}
        link = box.first(lambda n: n.name == "a" and ("href" in n.attrs or id(n) in headed))
        if link is None or not _text(link, True) or not link.attrs.get("href"):
            continue
        by = box.first(D.any_of(".c-color-gray, .source, [class*=author], [class*=source]"))
        when = box.first(D.any_of(".c-color-gray2, .newTimeFactor_before, [class*=time]"))
        yield _text(link, True), link.attrs["href"], _text(by, True), _text(when, True)


def _hits(pages: DataFrame, read) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key, pos, *hit)
                for key, page in zip(batch["payload_id"], batch["payload"])
                for pos, hit in enumerate(read(page or ""))
            ]
            yield pd.DataFrame(rows, columns=["payload_id", "pos", "title", "href", "author", "stamp"])

    return pages.select("payload_id", "payload").mapInPandas(run, _HIT_SCHEMA)


def weixin_results(pages: DataFrame) -> DataFrame:
    """Search hits with a link; verification pages give none."""
    host = "https://weixin.sogou.com"
    href = F.col("href")
    url = F.when(href.startswith("http"), href).when(href.startswith("/"), F.concat(F.lit(host), href)).otherwise(
        F.concat(F.lit(host + "/"), href)
    )
    stamp = F.when(F.col("stamp").rlike(r"^\d+$"), S.epoch_seconds(F.col("stamp").try_cast("bigint")))
    hits = _hits(pages.where(~library.captcha_page(F.col("payload"))), _weixin_hits)
    return P.articles(
        hits,
        "weixin_sogou",
        keep=F.lit(True),
        platform_id=F.md5(url),
        title=X.clean_text(F.col("title")),
        url=url,
        author=X.clean_text(F.col("author")),
        publish_time=F.coalesce(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.lit("")),
    )


def baidu_results(pages: DataFrame, host: str = "baijiahao.baidu.com") -> DataFrame:
    """Search hits on the given host, the first per url and page."""
    hits = _hits(pages, _baidu_hits).where(library.host_contains(F.col("href"), host))
    once = first_seen_wins(hits, ["payload_id", "href"], ["pos"])
    return P.articles(
        once,
        "baidu_baijiahao",
        keep=F.lit(True),
        platform_id=F.md5("href"),
        title=F.col("title"),
        url=F.col("href"),
        author=F.col("author"),
        publish_time=F.col("stamp"),
    )


def _relevant(articles: DataFrame) -> DataFrame:
    return articles.where(library.keyword_relevant(F.col("title"), F.col("summary")))


def embedded_articles(pages: DataFrame) -> DataFrame:
    """Articles of the first script that assigns page state."""
    scripts = F.regexp_extract_all("payload", F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1))
    with_state = F.filter(scripts, lambda x: x.contains("__NUXT__") | x.contains("__INITIAL_STATE__"))
    state = _first(F.try_element_at(with_state, F.lit(1)), PAGE_STATE)
    found = pages.select("payload_id", state.alias("payload")).where("payload <> ''")
    return _relevant(P.huxiu_articles(P.unnest(found, *STATE_LISTS, final=frozenset(f"$.{k}" for k in STATE_KEYS))))


_CARD_SCHEMA = "payload_id BIGINT, pos INT, title STRING, href STRING, author STRING, summary STRING"


def _cards(page: str) -> Iterator[tuple[str, str, str, str]]:
    for card in D.parse(page).all(D.any_of(CARD_SELECTOR)):
        title = card.first(D.any_of("h2, h3, h4, a.article-title, .title"))
        link = card.first(D.selector("a[href*='/article/']")) or card
        by = card.first(D.any_of(".author-name, .author, .user-name"))
        about = card.first(D.any_of(".article-summary, .description, p"))
        yield _text(title, True), link.attrs.get("href", ""), _text(by, True), _text(about, True)


def card_articles(pages: DataFrame) -> DataFrame:
    """Article cards of pages without usable state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key, pos, *card)
                for key, page in zip(batch["payload_id"], batch["payload"])
                for pos, card in enumerate(_cards(page or ""))
            ]
            yield pd.DataFrame(rows, columns=["payload_id", "pos", "title", "href", "author", "summary"])

    cards = pages.select("payload_id", "payload").mapInPandas(run, _CARD_SCHEMA)
    pid = _first(F.col("href"), r"/article/(\d+)")
    return _relevant(
        P.articles(
            cards,
            "huxiu",
            platform_id=pid,
            title=F.col("title"),
            url=S.absolute_url("href", "https://www.huxiu.com"),
            author=F.col("author"),
            summary=F.col("summary"),
        )
    )


def front_page_articles(pages: DataFrame) -> DataFrame:
    """Page state where it yields articles, cards elsewhere."""
    stated = embedded_articles(pages)
    rest = pages.join(stated.select("payload_id").distinct(), "payload_id", "left_anti")
    return stated.unionByName(card_articles(rest))


def triplet_articles(pages: DataFrame) -> DataFrame:
    """Repeated (url, title, source) triplets of a search page script."""
    found = [F.regexp_extract_all("payload", F.lit(TRIPLET), F.lit(g)) for g in (1, 2, 3)]
    rows = pages.select("payload_id", *[f.alias(n) for f, n in zip(found, "utm")]).select(
        "payload_id", F.posexplode(F.arrays_zip("u", "t", "m")).alias("pos", "hit")
    )
    plain = F.replace(F.replace(F.col("hit.u"), F.lit("\\u002F"), F.lit("/")), F.lit("\\/"), F.lit("/"))
    url = S.absolute_url(plain, "https://www.toutiao.com")
    return P.articles(
        rows,
        "toutiao",
        keep=F.lit(True),
        platform_id=F.coalesce(S.id_from_url(url, "toutiao"), F.md5(url)),
        title=F.col("hit.t"),
        url=url,
        author=F.col("hit.m"),
    )


# --- feeds -----------------------------------------------------------------

_ITEMS = (
    "ARRAY<STRUCT<title: STRING, link: STRING, guid: STRUCT<_VALUE: STRING, _isPermaLink: STRING>, author: STRING, "
    "`dc:creator`: STRING, pubDate: STRING, `dc:date`: STRING, description: STRING, `content:encoded`: STRING>>"
)
# RDF feeds have their items beside the channel, RSS has them inside.
_RSS = f"channel STRUCT<title: STRING, item: {_ITEMS}>, item {_ITEMS}"
_ATOM = (
    "title STRING, entry ARRAY<STRUCT<title: STRING, id: STRING, "
    "link: ARRAY<STRUCT<_href: STRING, _rel: STRING, _type: STRING>>, author: STRUCT<name: STRING>, "
    "published: STRING, updated: STRING, created: STRING, summary: STRING, content: STRING>>"
)


# The zone names of RFC 822.
_ZONES = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
    "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def feed_time(text: Column) -> Column:
    """RFC 822 or ISO dates as ISO text in UTC; anything else as it stands."""
    t = F.trim(text)
    day = F.regexp_replace(t, r"^[A-Za-z]{3,9},\s*", "")
    zones = F.create_map(*[F.lit(x) for pair in _ZONES.items() for x in pair])
    offset = F.try_element_at(zones, F.regexp_extract(day, r"\s([A-Z]{1,3})$", 1))
    numeric = F.when(offset.isNull(), day).otherwise(F.concat(F.regexp_replace(day, "[A-Z]{1,3}$", ""), offset))
    instant = F.coalesce(
        F.try_to_timestamp(numeric, F.lit("d MMM yyyy HH:mm[:ss] Z")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX")),
    )
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
    return F.coalesce(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), t, F.lit(""))


def feed_entries(feeds: DataFrame) -> DataFrame:
    """Entries of RSS, RDF and Atom documents; the first entry per link wins.

    Without a link an RSS item goes by its guid, unless that is declared to be no link,
    and an Atom entry without an ``alternate`` link by its id.
    """
    xml = F.col("payload")
    rss = feeds.where(xml.contains("<rss") | xml.contains("<rdf:RDF")).select("payload_id", F.from_xml(xml, _RSS).alias("d"))
    rss = rss.select("payload_id", F.col("d.channel.title").alias("feed"), F.posexplode(F.coalesce("d.channel.item", "d.item")).alias("pos", "e"))
    e = F.col("e")
    blank = S.blank_to_null
    guid = F.when(F.coalesce(e["guid"]["_isPermaLink"], F.lit("true")) == "true", e["guid"]["_VALUE"])
    alternate = F.filter(
        e["link"],
        lambda x: (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        & F.coalesce(x["_type"], F.lit("text/html")).isin("text/html", "application/xhtml+xml"),
    )
    rss = rss.select(
        "payload_id",
        "pos",
        "feed",
        e["title"].alias("title"),
        F.coalesce(blank(e["link"]), guid).alias("link"),
        F.coalesce(blank(e["author"]), blank(e["dc:creator"])).alias("author"),
        F.coalesce(blank(e["pubDate"]), blank(e["dc:date"])).alias("published"),
        e["content:encoded"].alias("body"),
        e["description"].alias("about"),
    )
    atom = feeds.where(xml.contains("<feed")).select("payload_id", F.from_xml(xml, _ATOM).alias("d"))
    atom = atom.select("payload_id", F.col("d.title").alias("feed"), F.posexplode("d.entry").alias("pos", "e")).select(
        "payload_id",
        "pos",
        "feed",
        e["title"].alias("title"),
        F.coalesce(blank(F.get(alternate, 0)["_href"]), e["id"]).alias("link"),
        blank(e["author"]["name"]).alias("author"),
        F.coalesce(blank(e["published"]), blank(e["updated"]), blank(e["created"])).alias("published"),
        e["content"].alias("body"),
        e["summary"].alias("about"),
    )
    link = F.trim(F.coalesce("link", F.lit("")))
    raw_html = F.coalesce(blank("body"), blank("about"), F.lit(""))
    content = X.node_text(raw_html)
    entries = (
        rss.unionByName(atom)
        .withColumn("link", link)
        .where((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.col("link") != ""))
    )
    entries = first_seen_wins(entries, ["link"], ["payload_id", "pos"]).withColumn("content", content)
    return P.articles(
        entries,
        "rss_generic",
        extra=["content"],
        keep=F.lit(True),
        platform_id=F.md5("link"),
        title=F.trim("title"),
        url=F.col("link"),
        author=F.trim(F.coalesce("author", "feed", F.lit(""))),
        publish_time=feed_time(F.col("published")),
        summary=F.coalesce(blank(F.trim("about")), F.left("content", F.lit(200))),
    )
