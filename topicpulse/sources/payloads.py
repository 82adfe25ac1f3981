"""Platform payloads (JSON text) to the article model.

Every normaliser takes a frame with ``payload_id`` and ``payload`` and returns
``payload_id``, ``pos`` and the article columns. Payloads are parsed once into a
VARIANT and read by path, so absent or oddly typed fields read as NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicpulse.functions import scalars as S
from topicpulse.functions import text as X
from topicpulse.schemas import ARTICLE_MODEL

ANONYMOUS = "匿名用户"
_FALSY = ["null", '""', "0", "0.0", "false", "[]", "{}"]


def get(doc: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(doc, path, kind)


def raw(doc: Column, path: str) -> Column:
    """The JSON text of a value, so that 0 and "0" stay apart."""
    return F.to_json(get(doc, path, "variant"))


def truthy(doc: Column, *paths: str) -> Column:
    """First value that is neither absent, null, empty, zero nor false, as text."""
    return F.coalesce(*[F.when(~raw(doc, p).isin(_FALSY), get(doc, p)) for p in paths])


def text(doc: Column, path: str) -> Column:
    return F.coalesce(get(doc, path), F.lit(""))


def count(doc: Column, path: str) -> Column:
    """A count given as number or numeric text; absent is zero."""
    return F.coalesce(get(doc, path).try_cast("bigint"), F.lit(0).cast("bigint"))


def _mixed_time(doc: Column, paths: list[str], convert: Callable[[Column], Column]) -> Column:
    """Numbers are epochs, texts are kept as they are."""
    first = F.coalesce(
        *[
            F.when(~raw(doc, p).isin(_FALSY), F.struct(raw(doc, p).alias("raw"), get(doc, p).alias("text")))
            for p in paths
        ]
    )
    stamp = F.date_format(convert(first["text"].try_cast("decimal(21,3)")), "yyyy-MM-dd HH:mm:ss")
    return F.when(first["raw"].rlike(r"^-?\d"), stamp).otherwise(first["text"])


def unnest(payloads: DataFrame, *paths: str, final: frozenset[str] = frozenset()) -> DataFrame:
    """One row per item of the first non-empty list among ``paths``; at a ``final`` path an empty one ends the search."""
    parsed = payloads.select("payload_id", F.try_parse_json("payload").alias("doc"))
    lists = [get(F.col("doc"), p, "array<variant>") for p in paths]
    first = F.coalesce(*[x if p in final else F.when(F.size(x) > 0, x) for p, x in zip(paths, lists, strict=True)])
    return parsed.select("payload_id", F.posexplode(first).alias("pos", "item"))


def articles(
    items: DataFrame, platform: str, keep: Column | None = None, extra: list[str] | None = None, **fields: Column
) -> DataFrame:
    """Fill the article model; rows lacking an id or a title go, unless ``keep`` says otherwise."""
    zero = F.lit(0).cast("bigint")
    default = {
        "author": F.lit(""),
        "view_count": zero,
        "like_count": zero,
        "comment_count": zero,
        "share_count": zero,
        "publish_time": F.lit(None).cast("string"),
        "summary": F.lit(None).cast("string"),
    }
    cols = {"platform": F.lit(platform), **default, **fields}
    out = items.select("payload_id", F.col("pos").cast("bigint").alias("pos"), *[cols[c].alias(c) for c in ARTICLE_MODEL], *(extra or []))
    filled = (F.coalesce("platform_id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")
    return out.where(filled if keep is None else keep)


def kr36_items(payloads: DataFrame) -> DataFrame:
    """Hot lists and search lists; search items may be wrapped in a template."""
    items = unnest(
        payloads, "$.data.hotRankList", "$.data.data.hotRankList", "$.data.itemList", "$.data.data.itemList"
    )
    inner = get(F.col("item"), "$.templateMaterial", "variant")
    return items.withColumn("item", F.coalesce(inner, F.col("item")))


def normalize_kr36(payloads: DataFrame) -> DataFrame:
    """The author name counts only beside an author object; a plain author is used as is."""
    i = F.col("item")
    pid = truthy(i, "$.itemId", "$.id", "$.articleId")
    base = F.concat(F.lit("https://www.36kr.com/p/"), pid)
    is_object = raw(i, "$.author").startswith("{")
    return articles(
        kr36_items(payloads),
        "kr36",
        platform_id=pid,
        title=F.trim(truthy(i, "$.title", "$.widgetTitle")),
        url=F.coalesce(S.absolute_url(truthy(i, "$.url"), "https://www.36kr.com", base), base),
        author=F.when(is_object, F.coalesce(truthy(i, "$.authorName"), text(i, "$.author.name"))).otherwise(
            text(i, "$.author")
        ),
        view_count=count(i, "$.viewCount"),
        like_count=count(i, "$.likeCount"),
        comment_count=count(i, "$.commentCount"),
        share_count=count(i, "$.shareCount"),
        publish_time=_mixed_time(i, ["$.publishTime", "$.publicTime", "$.formatDate"], S.epoch_millis),
        summary=text(i, "$.summary"),
    )


def huxiu_items(payloads: DataFrame) -> DataFrame:
    return unnest(payloads, "$.data.datalist", "$.data.data", "$.data")


def huxiu_articles(items: DataFrame) -> DataFrame:
    i = F.col("item")
    pid = truthy(i, "$.aid", "$.article_id", "$.id")
    base = F.concat(F.lit("https://www.huxiu.com/article/"), pid, F.lit(".html"))
    author = raw(i, "$.author")
    return articles(
        items,
        "huxiu",
        platform_id=pid,
        title=F.trim(text(i, "$.title")),
        url=F.coalesce(S.absolute_url(truthy(i, "$.url"), "https://www.huxiu.com", base), base),
        author=F.when(author.startswith("{"), F.coalesce(truthy(i, "$.author.username"), text(i, "$.author.name")))
        .when(author.startswith('"'), get(i, "$.author"))
        .otherwise(text(i, "$.user_info.username")),
        view_count=count(i, "$.view_count"),
        like_count=count(i, "$.like_count"),
        comment_count=count(i, "$.comment_count"),
        share_count=count(i, "$.share_count"),
        publish_time=_mixed_time(i, ["$.publish_time", "$.formatDate", "$.dateline"], S.epoch_seconds),
        summary=F.coalesce(get(i, "$.summary"), text(i, "$.description")),
    )


def normalize_huxiu(payloads: DataFrame) -> DataFrame:
    return huxiu_articles(huxiu_items(payloads))


def _zhihu_time(item: Column) -> Column:
    return S.iso_utc(S.epoch_text(get(item, "$.target.created_time")))


def normalize_zhihu_hot(payloads: DataFrame) -> DataFrame:
    i = F.col("item")
    kind = text(i, "$.target.type")
    itself = (kind == "question") | get(i, "$.target.question", "variant").isNull()

    def asked(field: str) -> Column:
        return F.when(itself, get(i, f"$.target.{field}")).otherwise(get(i, f"$.target.question.{field}"))

    qid = asked("id")
    answer = F.when(kind == "answer", S.blank_to_null(get(i, "$.target.id")))
    question_url = F.concat(F.lit("https://www.zhihu.com/question/"), qid)
    return articles(
        unnest(payloads, "$.data").where(F.coalesce(qid, F.lit("")) != ""),
        "zhihu",
        platform_id=F.coalesce(answer, qid),
        title=asked("title"),
        url=F.when(answer.isNotNull(), F.concat(question_url, F.lit("/answer/"), answer)).otherwise(question_url),
        author=text(i, "$.target.author.name"),
        view_count=F.coalesce(asked("visit_count").try_cast("bigint"), F.lit(0).cast("bigint")),
        like_count=count(i, "$.target.voteup_count"),
        comment_count=count(i, "$.target.comment_count"),
        publish_time=_zhihu_time(i),
    )


def min_upvotes(items: DataFrame, least: int = 100) -> DataFrame:
    """Answers and articles with enough votes."""
    i = F.col("item")
    kept = text(i, "$.target.type").isin("answer", "article")
    return items.where(kept & (count(i, "$.target.voteup_count") >= least))


def normalize_zhihu_topic(payloads: DataFrame, least: int = 100) -> DataFrame:
    i = F.col("item")
    qid, aid = S.blank_to_null(get(i, "$.target.question.id")), S.blank_to_null(get(i, "$.target.id"))
    both = qid.isNotNull() & aid.isNotNull()
    url = F.concat(F.lit("https://www.zhihu.com/question/"), qid, F.lit("/answer/"), aid)
    return articles(
        min_upvotes(unnest(payloads, "$.data"), least),
        "zhihu",
        keep=F.lit(True),
        platform_id=F.coalesce(aid, qid, F.lit("")),
        title=F.coalesce(get(i, "$.target.question.title"), text(i, "$.target.title")),
        url=F.when(both, url).otherwise(text(i, "$.target.url")),
        author=text(i, "$.target.author.name"),
        view_count=count(i, "$.target.question.visit_count"),
        like_count=count(i, "$.target.voteup_count"),
        comment_count=count(i, "$.target.comment_count"),
        publish_time=_zhihu_time(i),
    )


def normalize_juejin(payloads: DataFrame) -> DataFrame:
    i = F.col("item")
    pid = text(i, "$.article_info.article_id")
    return articles(
        unnest(payloads, "$.data"),
        "juejin",
        keep=F.col("platform_id") != "",
        platform_id=pid,
        title=text(i, "$.article_info.title"),
        url=F.concat(F.lit("https://juejin.cn/post/"), pid),
        author=text(i, "$.author_user_info.user_name"),
        view_count=count(i, "$.article_info.view_count"),
        like_count=count(i, "$.article_info.digg_count"),
        comment_count=count(i, "$.article_info.comment_count"),
        share_count=count(i, "$.article_info.collect_count"),
        publish_time=S.iso_utc(S.epoch_text(get(i, "$.article_info.ctime"))),
    )


def normalize_toutiao(payloads: DataFrame) -> DataFrame:
    i = F.col("item")
    given = S.blank_to_null(F.coalesce(S.blank_to_null(get(i, "$.article_url")), get(i, "$.url")))
    url = S.absolute_url(given, "https://www.toutiao.com")
    group = F.coalesce(truthy(i, "$.group_id"), S.blank_to_null(get(i, "$.item_id")))
    stamp = S.epoch_text(truthy(i, "$.publish_time", "$.behot_time"))
    return articles(
        unnest(payloads, "$.data").where(given.isNotNull()),
        "toutiao",
        platform_id=F.coalesce(group, F.md5(url)),
        title=F.trim(text(i, "$.title")),
        url=url,
        author=text(i, "$.media_name"),
        view_count=count(i, "$.read_count"),
        like_count=count(i, "$.like_count"),
        comment_count=count(i, "$.comment_count"),
        share_count=count(i, "$.share_count"),
        publish_time=F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"),
    )


def normalize_bilibili(payloads: DataFrame) -> DataFrame:
    i = F.col("item")
    pid = S.blank_to_null(get(i, "$.id"))
    return articles(
        unnest(payloads, "$.data.result").where(pid.isNotNull()),
        "bilibili",
        keep=F.lit(True),
        platform_id=F.concat(F.lit("bilibili_"), pid),
        title=F.regexp_replace(text(i, "$.title"), "<[^>]+>", ""),
        url=F.concat(F.lit("https://www.bilibili.com/read/cv"), pid),
        author=text(i, "$.author"),
        view_count=count(i, "$.view"),
        like_count=count(i, "$.like"),
        comment_count=count(i, "$.reply"),
        share_count=count(i, "$.coin"),
        publish_time=text(i, "$.pub_date"),
    )


def normalize_xiaohongshu(payloads: DataFrame) -> DataFrame:
    i = F.col("item")
    pid = S.blank_to_null(get(i, "$.id"))
    return articles(
        unnest(payloads, "$.data.items").where(pid.isNotNull()),
        "xiaohongshu",
        keep=F.lit(True),
        platform_id=F.concat(F.lit("xhs_"), pid),
        title=text(i, "$.note_card.display_title"),
        url=F.concat(F.lit("https://www.xiaohongshu.com/explore/"), pid),
        author=text(i, "$.note_card.user.nickname"),
        view_count=count(i, "$.note_card.interact_info.view_count"),
        like_count=count(i, "$.note_card.interact_info.liked_count"),
        comment_count=count(i, "$.note_card.interact_info.comment_count"),
        share_count=count(i, "$.note_card.interact_info.collected_count"),
        publish_time=text(i, "$.note_card.time"),
    )


def normalize_maimai(payloads: DataFrame) -> DataFrame:
    """The title is the cleaned head of the first line."""
    i = F.col("item")
    first_line = F.left(F.split_part(text(i, "$.text"), F.lit("\n"), F.lit(1)), F.lit(50))
    pid = text(i, "$.id")
    return articles(
        unnest(payloads, "$.data.feeds", "$.data.list", "$.data"),
        "maimai",
        platform_id=pid,
        title=X.clean_text(first_line),
        url=F.concat(F.lit("https://maimai.cn/gossip_detail?gid="), pid),
        author=F.coalesce(get(i, "$.user.name"), F.lit(ANONYMOUS)),
        like_count=count(i, "$.likes"),
        comment_count=count(i, "$.comment_count"),
        publish_time=text(i, "$.created_at"),
    )


NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "kr36": normalize_kr36,
    "huxiu": normalize_huxiu,
    "zhihu": normalize_zhihu_hot,
    "zhihu_topic": normalize_zhihu_topic,
    "juejin": normalize_juejin,
    "toutiao": normalize_toutiao,
    "bilibili": normalize_bilibili,
    "xiaohongshu": normalize_xiaohongshu,
    "maimai": normalize_maimai,
}


def register(platform: str, normalizer: Callable[[DataFrame], DataFrame]) -> None:
    """Plug in another source: payload frame in, article frame out."""
    NORMALIZERS[platform] = normalizer


def normalize(platform: str, payloads: DataFrame) -> DataFrame:
    return NORMALIZERS[platform](payloads)


# --- comments --------------------------------------------------------------


def _comments(
    payloads: DataFrame, *paths: str, name: str, content: str, likes: str, anonymous: str | None = None,
    clean: bool = False, names: tuple[str, ...] = (),
) -> DataFrame:
    i = F.col("item")
    if names:
        who = F.coalesce(truthy(i, *names), F.lit(""))
    else:
        who = F.coalesce(get(i, name), F.lit(anonymous or ""))
    items = unnest(payloads, *paths)
    if clean:
        items = items.where(text(i, content) != "")
    body = X.clean_text(text(i, content)) if clean else text(i, content)
    return items.select(
        "payload_id",
        F.col("pos").cast("bigint").alias("pos"),
        who.alias("commenter"),
        body.alias("content"),
        count(i, likes).alias("like_count"),
    )


def _comments_kr36(payloads: DataFrame) -> DataFrame:
    """A present author name wins even when empty, else the nested one."""
    i = F.col("item")
    who = F.coalesce(get(i, "$.authorName"), text(i, "$.author.name"))
    return unnest(payloads, "$.data.data.commentList").select(
        "payload_id", F.col("pos").cast("bigint").alias("pos"), who.alias("commenter"),
        text(i, "$.content").alias("content"), count(i, "$.likeCount").alias("like_count"),
    )


COMMENT_READERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "kr36": _comments_kr36,
    "huxiu": lambda p: _comments(
        p, "$.data.data", "$.data", name="", content="$.content", likes="$.like_count",
        names=("$.username", "$.user.username", "$.user.nick_name"),
    ),
    "zhihu": lambda p: _comments(
        p, "$.data", name="$.author.member.name", content="$.content", likes="$.like_count", anonymous=ANONYMOUS
    ),
    "juejin": lambda p: _comments(
        p, "$.data", name="$.user_info.user_name", content="$.comment_info.comment_content",
        likes="$.comment_info.digg_count", anonymous=ANONYMOUS,
    ),
    "toutiao": lambda p: _comments(p, "$.data.comments", name="$.user.name", content="$.text", likes="$.digg_count"),
    "bilibili": lambda p: _comments(
        p, "$.data.replies", name="$.member.uname", content="$.content.message", likes="$.like"
    ),
    "xiaohongshu": lambda p: _comments(
        p, "$.data.comments", name="$.user_info.nickname", content="$.content", likes="$.like_count"
    ),
    "maimai": lambda p: _comments(
        p, "$.data.comments", name="$.user.name", content="$.text", likes="$.likes", anonymous=ANONYMOUS, clean=True
    ),
}


def normalize_comments(platform: str, payloads: DataFrame) -> DataFrame:
    """``(payload_id, pos, commenter, content, like_count)`` of a comment payload."""
    ok = payloads
    doc = F.try_parse_json("payload")
    if platform == "toutiao":
        ok = payloads.where(get(doc, "$.message") == "success")
    if platform == "bilibili":
        ok = payloads.where(get(doc, "$.code") == "0")
    return COMMENT_READERS[platform](ok)
