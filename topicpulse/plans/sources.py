"""Platform payload normalisers as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse.operators.ingest import union_sources
from topicpulse.plans.adapters_sql import register_cte
from topicpulse.plans.payload_data import COMMENTS, comments, payloads
from topicpulse.plans.registry import CATALOGUE, query
from topicpulse.schemas import ARTICLE_MODEL
from topicpulse.sources import payloads as N
from topicpulse.sources.tables import SampleStore as Store

_FALSY = ", ".join(f"'{v}'" for v in ["null", '""', "0", "0.0", "false", "[]", "{}"])


def _items(source: str, *paths: str) -> str:
    first = ", ".join(f"CASE WHEN len(json_extract(payload, '{p}[*]')) > 0 THEN json_extract(payload, '{p}[*]') END" for p in paths)
    return f"""SELECT payload_id, unnest(l) AS item, generate_subscripts(l, 1) - 1 AS pos
      FROM (SELECT payload_id, coalesce({first}) AS l FROM {source})"""


def _s(path: str) -> str:
    return f"json_extract_string(item, '$.{path}')"


def _t(*paths: str) -> str:
    return "coalesce(" + ", ".join(
        f"CASE WHEN CAST(json_extract(item, '$.{p}') AS VARCHAR) NOT IN ({_FALSY}) THEN {_s(p)} END" for p in paths
    ) + ", NULL)"


def _n(path: str) -> str:
    return f"coalesce(TRY_CAST({_s(path)} AS BIGINT), 0)"


def _type(path: str) -> str:
    return f"coalesce(json_type(item, '$.{path}'), '')"


def _mixed(paths: list[str], per_second: int) -> str:
    arms = " ".join(
        f"WHEN {_t(p)} IS NOT NULL THEN CASE WHEN {_type(p)} = 'VARCHAR' THEN {_s(p)} ELSE "
        f"strftime(make_timestamp(CAST(CAST({_s(p)} AS DOUBLE) * {1000000 // per_second} AS BIGINT)), '%Y-%m-%d %H:%M:%S') END"
        for p in paths
    )
    return f"CASE {arms} END"


def _iso(path: str) -> str:
    number = f"TRY_CAST({_s(path)} AS BIGINT)"
    return f"CASE WHEN {number} <> 0 THEN strftime(make_timestamp({number} * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END"


def _select(platform: str, items: str, where: str = "true", **cols: str) -> str:
    zero = "CAST(0 AS BIGINT)"
    default = dict(author="''", view_count=zero, like_count=zero, comment_count=zero, share_count=zero,
                   publish_time="NULL::VARCHAR", summary="NULL::VARCHAR")
    shown = ", ".join(f"{sql} AS {name}" for name, sql in {**default, **cols}.items())
    return f"SELECT * FROM (SELECT payload_id, pos, '{platform}' AS platform, {shown} FROM ({items})) WHERE {where}"


_FILLED = "coalesce(platform_id, '') <> '' AND coalesce(title, '') <> ''"
_KR36 = _items("payload_kr36", "$.data.hotRankList", "$.data.data.hotRankList", "$.data.itemList", "$.data.data.itemList")
_KR36 = f"SELECT payload_id, pos, coalesce(json_extract(item, '$.templateMaterial'), item) AS item FROM ({_KR36})"
_KID = _t("itemId", "id", "articleId")
_KURL = f"concat('https://www.36kr.com/p/', {_KID})"

_SQL_KR36 = _select(
    "kr36", _KR36, _FILLED,
    platform_id=_KID,
    title=f"trim({_t('title', 'widgetTitle')})",
    url=f"CASE WHEN {_t('url')} IS NULL THEN {_KURL} WHEN starts_with({_s('url')}, 'http') THEN {_s('url')} WHEN starts_with({_s('url')}, '/') THEN concat('https://www.36kr.com', {_s('url')}) ELSE {_KURL} END",
    author=f"CASE WHEN {_type('author')} = 'OBJECT' THEN coalesce({_t('authorName')}, {_s('author.name')}, '') ELSE coalesce({_s('author')}, '') END",
    view_count=_n("viewCount"), like_count=_n("likeCount"), comment_count=_n("commentCount"), share_count=_n("shareCount"),
    publish_time=_mixed(["publishTime", "publicTime", "formatDate"], 1000),
    summary=f"coalesce({_s('summary')}, '')",
)


@query("src01_normalize_kr36", _SQL_KR36)
def normalize_kr36(s: Store) -> DataFrame:
    return N.normalize("kr36", payloads(s, "kr36"))


_HUXIU = _items("payload_huxiu", "$.data.datalist", "$.data.data", "$.data")
_HID = _t("aid", "article_id", "id")
_HURL = f"concat('https://www.huxiu.com/article/', {_HID}, '.html')"


@query(
    "src02_normalize_huxiu",
    _select(
        "huxiu", _HUXIU, _FILLED,
        platform_id=_HID,
        title=f"trim(coalesce({_s('title')}, ''))",
        url=f"CASE WHEN {_t('url')} IS NULL THEN {_HURL} WHEN starts_with({_s('url')}, 'http') THEN {_s('url')} WHEN starts_with({_s('url')}, '/') THEN concat('https://www.huxiu.com', {_s('url')}) ELSE {_HURL} END",
        author=f"CASE {_type('author')} WHEN 'OBJECT' THEN coalesce({_t('author.username')}, {_s('author.name')}, '') WHEN 'VARCHAR' THEN {_s('author')} ELSE coalesce({_s('user_info.username')}, '') END",
        view_count=_n("view_count"), like_count=_n("like_count"), comment_count=_n("comment_count"), share_count=_n("share_count"),
        publish_time=_mixed(["publish_time", "formatDate", "dateline"], 1),
        summary=f"coalesce({_s('summary')}, {_s('description')}, '')",
    ),
)
def normalize_huxiu(s: Store) -> DataFrame:
    return N.normalize("huxiu", payloads(s, "huxiu"))


_ZHIHU = _items("payload_zhihu", "$.data")
_ITSELF = f"({_s('target.type')} = 'question' OR json_extract(item, '$.target.question') IS NULL)"


def _asked(field: str) -> str:
    return f"CASE WHEN {_ITSELF} THEN {_s('target.' + field)} ELSE {_s('target.question.' + field)} END"


_ANSWER = f"CASE WHEN {_s('target.type')} = 'answer' THEN nullif({_s('target.id')}, '') END"


@query(
    "src03_normalize_zhihu_hot",
    _select(
        "zhihu", f"SELECT * FROM ({_ZHIHU}) WHERE coalesce({_asked('id')}, '') <> ''", _FILLED,
        platform_id=f"coalesce({_ANSWER}, {_asked('id')})",
        title=_asked("title"),
        url=f"concat('https://www.zhihu.com/question/', {_asked('id')}, CASE WHEN {_ANSWER} IS NOT NULL THEN concat('/answer/', {_ANSWER}) ELSE '' END)",
        author=f"coalesce({_s('target.author.name')}, '')",
        view_count=f"coalesce(TRY_CAST({_asked('visit_count')} AS BIGINT), 0)",
        like_count=_n("target.voteup_count"), comment_count=_n("target.comment_count"),
        publish_time=_iso("target.created_time"),
    ),
)
def normalize_zhihu_hot(s: Store) -> DataFrame:
    return N.normalize("zhihu", payloads(s, "zhihu"))


_VOTED = f"SELECT * FROM ({_ZHIHU}) WHERE {_s('target.type')} IN ('answer', 'article') AND {_n('target.voteup_count')} >= 100"
_QID, _AID = f"nullif({_s('target.question.id')}, '')", f"nullif({_s('target.id')}, '')"


@query(
    "src04_normalize_zhihu_topic",
    _select(
        "zhihu", _VOTED,
        platform_id=f"coalesce({_AID}, {_QID}, '')",
        title=f"coalesce({_s('target.question.title')}, {_s('target.title')}, '')",
        url=f"CASE WHEN {_QID} IS NOT NULL AND {_AID} IS NOT NULL THEN concat('https://www.zhihu.com/question/', {_QID}, '/answer/', {_AID}) ELSE coalesce({_s('target.url')}, '') END",
        author=f"coalesce({_s('target.author.name')}, '')",
        view_count=_n("target.question.visit_count"), like_count=_n("target.voteup_count"), comment_count=_n("target.comment_count"),
        publish_time=_iso("target.created_time"),
    ),
)
def normalize_zhihu_topic(s: Store) -> DataFrame:
    return N.normalize("zhihu_topic", payloads(s, "zhihu"))


@query("fil08_min_upvotes", f"SELECT payload_id, pos, {_s('target.type')} AS kind FROM ({_VOTED})")
def min_upvotes(s: Store) -> DataFrame:
    kept = N.min_upvotes(N.unnest(payloads(s, "zhihu"), "$.data"))
    return kept.select("payload_id", F.col("pos").cast("bigint").alias("pos"), N.get(F.col("item"), "$.target.type").alias("kind"))


@query(
    "src05_normalize_juejin",
    _select(
        "juejin", _items("payload_juejin", "$.data"), "platform_id <> ''",
        platform_id=f"coalesce({_s('article_info.article_id')}, '')",
        title=f"coalesce({_s('article_info.title')}, '')",
        url=f"concat('https://juejin.cn/post/', {_s('article_info.article_id')})",
        author=f"coalesce({_s('author_user_info.user_name')}, '')",
        view_count=_n("article_info.view_count"), like_count=_n("article_info.digg_count"),
        comment_count=_n("article_info.comment_count"), share_count=_n("article_info.collect_count"),
        publish_time=_iso("article_info.ctime"),
    ),
)
def normalize_juejin(s: Store) -> DataFrame:
    return N.normalize("juejin", payloads(s, "juejin"))


_TURL = f"nullif(coalesce(nullif({_s('article_url')}, ''), {_s('url')}), '')"
_TABS = f"CASE WHEN starts_with({_TURL}, 'http') THEN {_TURL} ELSE concat('https://www.toutiao.com', {_TURL}) END"
_TTIME = _t("publish_time", "behot_time")


@query(
    "src06_normalize_toutiao",
    _select(
        "toutiao", f"SELECT * FROM ({_items('payload_toutiao', '$.data')}) WHERE {_TURL} IS NOT NULL", _FILLED,
        platform_id=f"coalesce({_t('group_id')}, nullif({_s('item_id')}, ''), md5({_TABS}))",
        title=f"trim(coalesce({_s('title')}, ''))",
        url=_TABS,
        author=f"coalesce({_s('media_name')}, '')",
        view_count=_n("read_count"), like_count=_n("like_count"), comment_count=_n("comment_count"), share_count=_n("share_count"),
        publish_time=f"CASE WHEN TRY_CAST({_TTIME} AS BIGINT) <> 0 THEN strftime(make_timestamp(TRY_CAST({_TTIME} AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') END",
    ),
)
def normalize_toutiao(s: Store) -> DataFrame:
    return N.normalize("toutiao", payloads(s, "toutiao"))


@query(
    "src07_normalize_bilibili",
    _select(
        "bilibili", f"SELECT * FROM ({_items('payload_bilibili', '$.data.result')}) WHERE nullif({_s('id')}, '') IS NOT NULL",
        platform_id=f"concat('bilibili_', {_s('id')})",
        title=f"regexp_replace(coalesce({_s('title')}, ''), '<[^>]+>', '', 'g')",
        url=f"concat('https://www.bilibili.com/read/cv', {_s('id')})",
        author=f"coalesce({_s('author')}, '')",
        view_count=_n("view"), like_count=_n("like"), comment_count=_n("reply"), share_count=_n("coin"),
        publish_time=f"coalesce({_s('pub_date')}, '')",
    ),
)
def normalize_bilibili(s: Store) -> DataFrame:
    return N.normalize("bilibili", payloads(s, "bilibili"))


@query(
    "src08_normalize_xiaohongshu",
    _select(
        "xiaohongshu", f"SELECT * FROM ({_items('payload_xiaohongshu', '$.data.items')}) WHERE nullif({_s('id')}, '') IS NOT NULL",
        platform_id=f"concat('xhs_', {_s('id')})",
        title=f"coalesce({_s('note_card.display_title')}, '')",
        url=f"concat('https://www.xiaohongshu.com/explore/', {_s('id')})",
        author=f"coalesce({_s('note_card.user.nickname')}, '')",
        view_count=_n("note_card.interact_info.view_count"), like_count=_n("note_card.interact_info.liked_count"),
        comment_count=_n("note_card.interact_info.comment_count"), share_count=_n("note_card.interact_info.collected_count"),
        publish_time=f"coalesce({_s('note_card.time')}, '')",
    ),
)
def normalize_xiaohongshu(s: Store) -> DataFrame:
    return N.normalize("xiaohongshu", payloads(s, "xiaohongshu"))


_LINE = f"substr(split_part(coalesce({_s('text')}, ''), chr(10), 1), 1, 50)"


@query(
    "src09_normalize_maimai",
    _select(
        "maimai", _items("payload_maimai", "$.data.feeds"), _FILLED,
        platform_id=f"coalesce({_s('id')}, '')",
        title=f"trim(regexp_replace(regexp_replace(regexp_replace({_LINE}, '(?:<[^>]+>)+', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), concat(' ', chr(10)))",
        url=f"concat('https://maimai.cn/gossip_detail?gid=', {_s('id')})",
        author=f"coalesce({_s('user.name')}, '匿名用户')",
        like_count=_n("likes"), comment_count=_n("comment_count"),
        publish_time=f"coalesce({_s('created_at')}, '')",
    ),
)
def normalize_maimai(s: Store) -> DataFrame:
    return N.normalize("maimai", payloads(s, "maimai"))


@query(
    "src10_unnest_with_fallback",
    f"""SELECT 'kr36' AS platform, payload_id, pos, {_t("title", "widgetTitle")} AS title FROM ({_KR36})
        UNION ALL SELECT 'huxiu', payload_id, pos, {_t("title")} FROM ({_HUXIU})""",
)
def unnest_with_fallback(s: Store) -> DataFrame:
    i = F.col("item")
    cols = ["payload_id", F.col("pos").cast("bigint").alias("pos")]
    kr36 = N.kr36_items(payloads(s, "kr36")).select(F.lit("kr36").alias("platform"), *cols, N.truthy(i, "$.title", "$.widgetTitle").alias("title"))
    huxiu = N.huxiu_items(payloads(s, "huxiu")).select(F.lit("huxiu").alias("platform"), *cols, N.truthy(i, "$.title").alias("title"))
    return kr36.unionByName(huxiu)


def _comment_sql(platform: str, paths: list[str], who: str, body: str, likes: str, where: str = "true") -> str:
    return f"""SELECT '{platform}' AS platform, payload_id, pos, {who} AS commenter, {body} AS content, {_n(likes)} AS like_count
      FROM ({_items(f"(SELECT * FROM comments_{platform} WHERE {where})", *paths)})"""


_PLAIN = "coalesce({}, '')".format
_COMMENT_SQL = [
    _comment_sql("kr36", ["$.data.data.commentList"], f"coalesce({_s('authorName')}, {_s('author.name')}, '')", _PLAIN(_s("content")), "likeCount"),
    _comment_sql("huxiu", ["$.data.data", "$.data"], f"coalesce({_t('username', 'user.username', 'user.nick_name')}, '')", _PLAIN(_s("content")), "like_count"),
    _comment_sql("zhihu", ["$.data"], f"coalesce({_s('author.member.name')}, '匿名用户')", _PLAIN(_s("content")), "like_count"),
    _comment_sql("juejin", ["$.data"], f"coalesce({_s('user_info.user_name')}, '匿名用户')", _PLAIN(_s("comment_info.comment_content")), "comment_info.digg_count"),
    _comment_sql("toutiao", ["$.data.comments"], _PLAIN(_s("user.name")), _PLAIN(_s("text")), "digg_count", "json_extract_string(payload, '$.message') = 'success'"),
    _comment_sql("bilibili", ["$.data.replies"], _PLAIN(_s("member.uname")), _PLAIN(_s("content.message")), "like", "json_extract_string(payload, '$.code') = '0'"),
    _comment_sql("xiaohongshu", ["$.data.comments"], _PLAIN(_s("user_info.nickname")), _PLAIN(_s("content")), "like_count"),
    "SELECT * FROM (" + _comment_sql("maimai", ["$.data.comments"], f"coalesce({_s('user.name')}, '匿名用户')",
        f"replace(trim(regexp_replace({_s('text')}, '(?:<[^>]+>)+', chr(10), 'g'), chr(10)), concat(chr(10), '  '), chr(10))", "likes") + ") WHERE coalesce(content, '') <> ''",
]


@query("src16_normalize_comments", " UNION ALL ".join(_COMMENT_SQL))
def normalize_comments(s: Store) -> DataFrame:
    out = None
    for platform in COMMENTS:
        rows = N.normalize_comments(platform, comments(s, platform)).select(F.lit(platform).alias("platform"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


_NORMALISED = {
    "src01_normalize_kr36": normalize_kr36,
    "src02_normalize_huxiu": normalize_huxiu,
    "src03_normalize_zhihu_hot": normalize_zhihu_hot,
    "src04_normalize_zhihu_topic": normalize_zhihu_topic,
    "src05_normalize_juejin": normalize_juejin,
    "src06_normalize_toutiao": normalize_toutiao,
    "src07_normalize_bilibili": normalize_bilibili,
    "src08_normalize_xiaohongshu": normalize_xiaohongshu,
    "src09_normalize_maimai": normalize_maimai,
}
_MODEL = ", ".join(["payload_id", "pos", *ARTICLE_MODEL])


@query(
    "set01_union_normalized",
    " UNION ALL ".join(f"SELECT '{n}' AS origin, {_MODEL} FROM ({CATALOGUE[n].oracle})" for n in _NORMALISED),
)
def union_normalized(s: Store) -> DataFrame:
    """Articles of all platforms in one model, as their normalisers give them."""
    frames = [fn(s).withColumn("origin", F.lit(name)) for name, fn in _NORMALISED.items()]
    return union_sources(frames).select("origin", "payload_id", "pos", *ARTICLE_MODEL)
