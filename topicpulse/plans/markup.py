"""HTML, script-state, feed and detail readers as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse.plans.adapters_sql import register_cte
from topicpulse.plans.cleaning import sql_html, sql_space
from topicpulse.plans.library import SQL_TOPICAL
from topicpulse.plans.payload_data import K, pick
from topicpulse.plans.registry import query
from topicpulse.plans.scalars import sql_chain
from topicpulse.functions import text as X
from topicpulse.functions.scalars import bind
from topicpulse.sources import details as D
from topicpulse.sources import markup as M
from topicpulse.sources.tables import SampleStore as Store

ZERO = "CAST(0 AS BIGINT)"
_COUNTS = f"{ZERO} AS view_count, {ZERO} AS like_count, {ZERO} AS share_count"
_NO_COUNTS = f"{_COUNTS}, {ZERO} AS comment_count"


def _pages(s: Store, sql: str) -> DataFrame:
    return s.spread("part", "p_partkey").select(F.col("p_partkey").alias("payload_id"), F.expr(sql).alias("payload"))


_GROUP = f"""concat('<table><tr class="th"><td>x</td></tr><tr id="r" class=""><td class="title"><a href="https://www.douban.com/group/topic/', {K}, '/" title=" ', p_name, ' ">t</a></td>',
 '<td nowrap="nowrap"><a href="https://www.douban.com/people/u1/">', p_brand, '</a></td><td nowrap="nowrap" class="r-count ">', CAST(p_size AS STRING), '</td><td nowrap="nowrap" class="time">',
 {pick(4, "'03-07 08:09'", "'2023-11-02 10:11'", "'2022-01-05'", "'today'")}, '</td></tr><tr id="z" class=""><td>no link</td></tr></table>')"""


@query(
    "src11_rows_from_group_html",
    f"""SELECT p_partkey AS payload_id, {ZERO} AS pos, 'douban' AS platform, {K} AS platform_id, p_name AS title,
        concat('https://www.douban.com/group/topic/', p_partkey, '/') AS url, p_brand AS author, {_COUNTS}, p_size::BIGINT AS comment_count,
        NULL::VARCHAR AS publish_time, NULL::VARCHAR AS summary FROM part""",
)
def rows_from_group_html(s: Store) -> DataFrame:
    """The reply count is the first nowrap cell, so it takes the place of the time here."""
    return M.group_topics(_pages(s, _GROUP), s.as_of)


_GROUP_TIMED = f"""concat('<table><tr id="r" class=""><td class="title"><a href="https://www.douban.com/group/topic/', {K}, '/" title="', p_name, '">t</a></td><td class="r-count ">',
 CAST(p_size AS STRING), '</td><td nowrap="nowrap" class="time">', {pick(4, "'03-07 08:09'", "'2023-11-02 10:11'", "'2022-01-05'", "'today'")}, '</td></tr></table>')"""


@query(
    "src11_group_html_times",
    f"""SELECT p_partkey AS payload_id, {K} AS platform_id, p_size::BIGINT AS comment_count,
        {pick(4, "'2024-03-07 08:09:00'", "'2023-11-02 10:11:00'", "'2022-01-05 00:00:00'", "NULL")} AS publish_time FROM part""",
)
def group_html_times(s: Store) -> DataFrame:
    return M.group_topics(_pages(s, _GROUP_TIMED), s.as_of).select("payload_id", "platform_id", "comment_count", "publish_time")


_WEIXIN = f"""concat('<html><body>', CASE WHEN p_partkey % 9 = 0 THEN '<p>请输入验证码</p>' ELSE '' END, '<ul class="news-list"><li><div class="txt-box"><h3><a href="', {pick(3, f"concat('/link?url=', {K})", f"concat('http://w.example/', {K})", f"concat('rel/', {K})")},
 '"><em>', p_name, '</em> ', p_type, '</a></h3><div class="s-p" t="', CAST(1700000000 + p_partkey AS STRING), '"><a class="account">', p_brand, '</a></div></div></li><li><h3><a>no href</a></h3></li></ul></body></html>')"""
_WURL = pick(3, f"concat('https://weixin.sogou.com/link?url=', {K})", f"concat('http://w.example/', {K})", f"concat('https://weixin.sogou.com/rel/', {K})")


@query(
    "src12_rows_from_search_html",
    f"""SELECT p_partkey AS payload_id, {ZERO} AS pos, 'weixin_sogou' AS platform, md5({_WURL}) AS platform_id, concat(p_name, ' ', p_type) AS title, {_WURL} AS url,
        p_brand AS author, {_NO_COUNTS}, strftime(make_timestamp((1700000000 + p_partkey) * 1000000), '%Y-%m-%d %H:%M:%S') AS publish_time, NULL::VARCHAR AS summary
        FROM part WHERE p_partkey % 9 <> 0""",
)
def rows_from_search_html(s: Store) -> DataFrame:
    return M.weixin_results(_pages(s, _WEIXIN))


_BAIDU = f"""concat('<div class="result c-container"><h3 class="t"><a href="', {pick(3, f"concat('https://baijiahao.baidu.com/s?id=', {K})", f"concat('https://other.example/', {K})", f"concat('http://baijiahao.baidu.com/x/', {K})")},
 '">', p_name, ' <em>!</em></a></h3><span class="c-color-gray">', p_brand, '</span><span class="c-color-gray2"> 3天前 </span></div><div class="c-container"><b>none</b></div>',
 '<div class="c-container"><a href="https://baijiahao.baidu.com/s?id=', {K}, '">again</a></div>')"""


@query(
    "src12_rows_from_search_html_host",
    f"""SELECT payload_id, title, url, md5(url) AS platform_id, author, publish_time FROM (
          SELECT p_partkey AS payload_id, concat(p_name, '!') AS title, {pick(3, f"concat('https://baijiahao.baidu.com/s?id=', {K})", "NULL", f"concat('http://baijiahao.baidu.com/x/', {K})")} AS url,
            p_brand AS author, '3天前' AS publish_time FROM part
          UNION ALL SELECT p_partkey, 'again', concat('https://baijiahao.baidu.com/s?id=', {K}), '', '' FROM part WHERE p_partkey % 3 <> 0) WHERE url IS NOT NULL""",
)
def rows_from_search_html_host(s: Store) -> DataFrame:
    return M.baidu_results(_pages(s, _BAIDU)).select("payload_id", "title", "url", "platform_id", "author", "publish_time")


_TOPICAL = SQL_TOPICAL.format(title="p_name", key="p_partkey")
_STATE_ITEM = f"""concat('{{"aid":', {K}, ',"title":"', {_TOPICAL}, '","summary":"s"}}')"""
_FRONT = f"""concat('<html><script>var a = 1;</script><script>window.', {pick(2, "'__NUXT__'", "'__INITIAL_STATE__'")}, ' = ',
 {pick(4, f"concat('{{\"data\":[', {_STATE_ITEM}, ']}}')", f"concat('{{\"state\":{{\"articleList\":[', {_STATE_ITEM}, ']}}}}')", f"concat('{{\"hotList\":{{\"list\":[', {_STATE_ITEM}, ']}}}}')", f"concat('{{\"data\":[],\"hotList\":[', {_STATE_ITEM}, ']}}')")},
 ';</script><div class="article-item"><h3>', {_TOPICAL}, ' card</h3><a href="/article/9', {K}, '.html">x</a><span class="author">', p_brand, '</span><p>about</p></div></html>')"""
_RELEVANT = "(p_partkey % 5 = 0 OR p_partkey % 5 = 1)"


@query(
    "src13_rows_from_embedded_state",
    f"""SELECT p_partkey AS payload_id, {K} AS platform_id, {_TOPICAL} AS title, concat('https://www.huxiu.com/article/', {K}, '.html') AS url, '' AS author, 's' AS summary
        FROM part WHERE p_partkey % 4 < 3 AND p_partkey <> 0 AND {_RELEVANT}
        UNION ALL SELECT p_partkey, concat('9', {K}), concat({_TOPICAL}, ' card'), concat('https://www.huxiu.com/article/9', {K}, '.html'), p_brand, 'about'
        FROM part WHERE (p_partkey % 4 = 3 OR p_partkey = 0) AND {_RELEVANT}""",
)
def rows_from_embedded_state(s: Store) -> DataFrame:
    return M.front_page_articles(_pages(s, _FRONT)).select("payload_id", "platform_id", "title", "url", "author", "summary")


_TRIPLETS = f"""concat('<script>{{"a":[{{"article_url":"', {pick(2, f"concat('http:', chr(92), '/', chr(92), '/toutiao.com', chr(92), '/group', chr(92), '/', {K}, chr(92), '/')", f"concat(chr(92), 'u002Fplain', {K})")},
 '", "x":1, "title" : "', p_name, '","media_name":"', p_brand, '"}},{{"article_url":"https://www.toutiao.com/a/77', {K}, '","title":"two","media_name":"m2"}}]}}</script>')"""
_TRI_URL = pick(2, f"concat('http://toutiao.com/group/', {K}, '/')", f"concat('https://www.toutiao.com/plain', {K})")


@query(
    "src14_rows_from_html_triplets",
    f"""SELECT p_partkey AS payload_id, {ZERO} AS pos, 'toutiao' AS platform, {pick(2, K, f"md5({_TRI_URL})")} AS platform_id, p_name AS title, {_TRI_URL} AS url,
          p_brand AS author, {_NO_COUNTS}, NULL::VARCHAR AS publish_time, NULL::VARCHAR AS summary FROM part
        UNION ALL SELECT p_partkey, 1, 'toutiao', concat('77', {K}), 'two', concat('https://www.toutiao.com/a/77', {K}), 'm2', 0, 0, 0, 0, NULL, NULL FROM part""",
)
def rows_from_html_triplets(s: Store) -> DataFrame:
    return M.triplet_articles(_pages(s, _TRIPLETS))


_FEED = f"""CASE WHEN p_partkey % 2 = 0 THEN concat('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>feed ', p_brand, '</title>',
 '<item><title> ', p_name, ' </title><link>http://f.example/', {K}, '</link>', CASE WHEN p_partkey % 4 = 0 THEN '<dc:creator>ann</dc:creator>' ELSE '' END,
 '<pubDate>Tue, 0', CAST(1 + p_partkey % 9 AS STRING), ' Mar 2024 10:20:30 +0200</pubDate><description>&lt;p&gt;about ', p_type, '&lt;/p&gt;</description></item>',
 '<item><title>shared</title><link>http://f.example/shared</link><content:encoded>&lt;b&gt;x&lt;/b&gt; y</content:encoded></item><item><title>no link</title></item>',
 '<item><title>by guid</title><guid>http://f.example/g', {K}, '</guid><pubDate>Mon, 04 Mar 2024 10:20:30 EST</pubDate></item><item><title>opaque</title><guid isPermaLink="false">x1</guid></item></channel></rss>')
 WHEN p_partkey % 5 = 0 THEN concat('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel rdf:about="c"><title>rdf ', p_brand, '</title></channel>',
 '<item rdf:about="u"><title>', p_name, '</title><link>http://r.example/', {K}, '</link><dc:date>2024-01-0', CAST(1 + p_partkey % 9 AS STRING), 'T05:06:07.503Z</dc:date><description>plain ', p_type, '</description></item></rdf:RDF>')
 ELSE concat('<feed xmlns="http://www.w3.org/2005/Atom"><title>atom ', p_brand, '</title><entry><title>', p_name, '</title><id>urn:', {K}, '</id><link rel="alternate" href="http://a.example/', {K}, '"/><link rel="replies" href="http://a.example/replies"/>',
 '<author><name>bob</name></author><updated>2024-02-0', CAST(1 + p_partkey % 9 AS STRING), 'T01:02:03.500+01:00</updated><content type="html">&lt;h1&gt;T&lt;/h1&gt; &lt;p&gt; body ', p_type, ' &lt;/p&gt;</content></entry></feed>') END"""


@query(
    "src15_feed_entries",
    f"""SELECT p_partkey AS payload_id, 'rss_generic' AS platform, md5(url) AS platform_id, * EXCLUDE (p_partkey) FROM (
          SELECT p_partkey, p_name AS title, concat('http://f.example/', {K}) AS url, CASE WHEN p_partkey % 4 = 0 THEN 'ann' ELSE concat('feed ', p_brand) END AS author,
            concat('2024-03-0', 1 + p_partkey % 9, 'T08:20:30') AS publish_time, concat('<p>about ', p_type, '</p>') AS summary, concat('about ', p_type) AS content FROM part WHERE p_partkey % 2 = 0
          UNION ALL SELECT p_partkey, 'shared', 'http://f.example/shared', concat('feed ', p_brand), '', 'x' || chr(10) || 'y', 'x' || chr(10) || 'y' FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part WHERE p_partkey % 2 = 0)
          UNION ALL SELECT p_partkey, p_name, concat('http://a.example/', {K}), 'bob', concat('2024-02-0', 1 + p_partkey % 9, 'T00:02:03'), concat('T', chr(10), 'body ', p_type), concat('T', chr(10), 'body ', p_type) FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 5 <> 0
          UNION ALL SELECT p_partkey, 'by guid', concat('http://f.example/g', {K}), concat('feed ', p_brand), '2024-03-04T15:20:30', '', '' FROM part WHERE p_partkey % 2 = 0
          UNION ALL SELECT p_partkey, p_name, concat('http://r.example/', {K}), concat('rdf ', p_brand), concat('2024-01-0', 1 + p_partkey % 9, 'T05:06:07'), concat('plain ', p_type), concat('plain ', p_type) FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 5 = 0)""",
)
def feed_entries(s: Store) -> DataFrame:
    return M.feed_entries(_pages(s, _FEED)).select(
        "payload_id", "platform", "platform_id", "title", "url", "author", "publish_time", "summary", "content"
    )


# --- details ----------------------------------------------------------------

# Detail payloads embed whole document texts as JSON strings.
register_cte("doc_json", "SELECT doc_id, lang, text, to_json(text) AS js FROM documents")


def _doc_payload(s: Store, head: str, tail: str) -> DataFrame:
    """Document texts as JSON strings between ``head`` and ``tail``."""
    listed = F.to_json(F.array(F.col("text")))
    js = bind(listed, lambda j: F.substring(j, F.lit(2), F.length(j) - 2))
    return s.spread("documents", "doc_id").select(F.col("doc_id").alias("payload_id"), F.concat(F.lit(head), js, F.lit(tail)).alias("payload"))


_SHORT = "CASE WHEN length({c}) > 200 THEN concat(substr({c}, 1, 200), '...') ELSE {c} END"
_BARE = "regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '\\A\\s+|\\s+\\z', '', 'g')"
_CLEAN = f"SELECT doc_id, t FROM (SELECT doc_id, {sql_space('b')} AS t FROM (SELECT doc_id, __BOILER__ AS b FROM (SELECT doc_id, __ADS__ AS a FROM (SELECT doc_id, {sql_html('text')} AS h FROM documents))))"


def _clean_documents() -> str:
    from topicpulse.plans.cleaning import sql_ads, sql_boiler

    return _CLEAN.replace("__BOILER__", sql_boiler("a")).replace("__ADS__", sql_ads("h"))


register_cte("clean_documents", _clean_documents())
_MD = f"regexp_replace({sql_chain('text', [r[:2] for r in X.MARKDOWN_RULES])}, '\\A\\s+|\\s+\\z', '', 'g')"


@query(
    "src17_detail_fields",
    f"""SELECT 'zhihu_answer' AS platform, doc_id AS payload_id, md5(t) AS content_key, substr(t, 1, 200) AS summary FROM clean_documents
        UNION ALL SELECT 'zhihu_question', doc_id, md5(t), 'given' FROM clean_documents
        UNION ALL SELECT 'maimai', doc_id, md5(t), regexp_replace(substr(t, 1, 200), '\\A\\s+|\\s+\\z', '', 'g') FROM clean_documents
        UNION ALL SELECT 'juejin', doc_id, md5(m), substr(m, 1, 200) FROM (SELECT doc_id, {_MD} AS m FROM documents)
        UNION ALL SELECT 'toutiao', doc_id, md5(b), {_SHORT.format(c="b")} FROM (SELECT doc_id, {_BARE.format(c="text")} AS b FROM documents WHERE text <> '')
        UNION ALL SELECT 'xiaohongshu', doc_id, md5(x), {_SHORT.format(c="x")} FROM (SELECT doc_id, concat('note', chr(10), chr(10), text) AS x FROM documents)""",
)
def detail_fields(s: Store) -> DataFrame:
    payloads = {
        "zhihu_answer": ('{"content":', ',"excerpt":""}'),
        "zhihu_question": ('{"detail":', ',"excerpt":"given"}'),
        "maimai": ('{"data":{"gossip":{"text":', "}}}"),
        "juejin": ('{"data":{"article_info":{"brief_content":"","mark_content":', "}}}"),
        "toutiao": ('{"data":{"content":', "}}"),
        "xiaohongshu": ('{"data":{"items":[{"note_card":{"title":"note","desc":', "}}]}}"),
    }
    out = None
    for platform, (head, tail) in payloads.items():
        rows = D.detail_fields(platform, _doc_payload(s, head, tail)).select(
            F.lit(platform).alias("platform"), "payload_id", F.md5("content").alias("content_key"), "summary"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


_WRAPPED = """CASE page_id % 3 WHEN 0 THEN replace(replace(html, '<article>', '<div class="topic-content">'), '</article>', '</div>')
 WHEN 1 THEN replace(replace(html, '<article>', '<div class="article-content" id="read">'), '</article>', '</div>') ELSE html END"""
_ARTICLE_RE = "regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)"


@query(
    "src17_detail_pages_regex",
    f"""WITH w AS (SELECT page_id, html, {_WRAPPED} AS page FROM pages),
        b AS (SELECT 'toutiao_page' AS platform, page_id AS payload_id, {_BARE.format(c=_ARTICLE_RE)} AS c FROM w
          UNION ALL SELECT 'bilibili', page_id, CASE WHEN page_id % 3 = 1 THEN {_BARE.format(c="regexp_extract(page, '(?s)<div\\s+class=\"article-content\"[^>]*>(.*?)</div>', 1)")} ELSE {_BARE.format(c="page")} END FROM w
          UNION ALL SELECT 'douban', page_id, regexp_replace({_BARE.format(c="regexp_extract(page, '(?s)<div\\s+class=\"topic-content\"[^>]*>(.*?)</div>', 1)")}, '\\s+', ' ', 'g') FROM w)
        SELECT platform, payload_id, md5(c) AS content_key, {_SHORT.format(c="c")} AS summary FROM b""",
)
def detail_pages_regex(s: Store) -> DataFrame:
    plain = s.spread("pages", "page_id").select(F.col("page_id").alias("payload_id"), F.col("html").alias("payload"))
    wrapped = s.spread("pages", "page_id").select(F.col("page_id").alias("payload_id"), F.expr(_WRAPPED).alias("payload"))
    out = None
    for platform, rows in (("toutiao_page", plain), ("bilibili", wrapped), ("douban", wrapped)):
        got = D.detail_fields(platform, rows).select(
            F.lit(platform).alias("platform"), "payload_id", F.md5("content").alias("content_key"), "summary"
        )
        out = got if out is None else out.unionByName(got)
    return out


_STATEFUL = """CASE page_id % 4
 WHEN 0 THEN concat('<script>window.initialState={"articleDetail":{"articleDetailData":{"data":{"widgetContent":"state body ', CAST(page_id AS STRING), '","summary":"about"}}}};</script>', html)
 WHEN 1 THEN concat('<meta name="description" content="described ', CAST(page_id AS STRING), '">', replace(replace(html, '<article>', '<div class="article-content">'), '</article>', '</div>'))
 WHEN 2 THEN concat('<script>window.__INITIAL_STATE__ = {"data":{"articleDetail":{"content":"hx body","description":"hx about"}}};</script>', html)
 ELSE replace(replace(html, '<article>', '<div id="js_content">'), '</article>', '</div>') END"""


@query("src17_detail_pages")
def detail_pages(s: Store) -> DataFrame:
    rows = s.spread("pages", "page_id").select(F.col("page_id").alias("payload_id"), F.expr(_STATEFUL).alias("payload"))
    out = None
    for platform in ("kr36", "huxiu", "weixin_sogou", "baidu_baijiahao", "rss_generic"):
        got = D.detail_fields(platform, rows).select(F.lit(platform).alias("platform"), "payload_id", "content", "summary")
        out = got if out is None else out.unionByName(got)
    return out


_REPLIES = f"""concat('<ul><li id="c" class="clearfix comment-item"><a class="reply-doc x"><i>i</i><span class="n"> ', p_brand, ' </span></a><p class="reply-content">', p_name, '<br>!</p>',
 CASE WHEN p_partkey % 2 = 0 THEN concat('<span class="comment-vote lnk">', CAST(p_size AS STRING), '</span>') ELSE '' END, '</li><li class="comment-item"><b>no text</b></li></ul>',
 '<div class="comment-list"><div class="comment-item"><b class="user-name">', p_brand, '</b><p class="content">', p_type, '</p><i class="praise">', CAST(p_size AS STRING), '.5万</i></div><div class="comment-item"></div></div>')"""


@query(
    "src16_page_comments",
    f"""SELECT 'douban' AS platform, p_partkey AS payload_id, {ZERO} AS pos, p_brand AS commenter, concat(p_name, '!') AS content,
          CASE WHEN p_partkey % 2 = 0 THEN p_size::BIGINT ELSE 0 END AS like_count FROM part
        UNION ALL SELECT 'baidu_baijiahao', p_partkey, 0, p_brand, p_type, p_size * 10000 + 5000 FROM part""",
)
def page_comments(s: Store) -> DataFrame:
    pages = _pages(s, _REPLIES)
    douban = D.page_replies(pages).select(F.lit("douban").alias("platform"), "*")
    return douban.unionByName(D.baidu_comments(pages).select(F.lit("baidu_baijiahao").alias("platform"), "*"))
