"""Scalar building blocks: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAT_WEIGHTS = (0.3, 0.4, 0.2, 0.1)
HEAT_MAXIMA = (1_000_000, 100_000, 10_000, 50_000)
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Apply ``body`` to a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(_col(value), F.lit(""))


def epoch_seconds(value: Column | str) -> Column:
    """Seconds since 1970 to TIMESTAMP_NTZ, whatever the session time zone."""
    seconds = _col(value).cast("decimal(18,6)")
    return F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def epoch_millis(value: Column | str) -> Column:
    return epoch_seconds(_col(value).cast("decimal(21,3)") / F.lit(1000).cast("decimal(5,0)"))


def epoch_text(value: Column | str, millis: bool = False) -> Column:
    """Numeric text to TIMESTAMP_NTZ; NULL, empty, zero and non-numbers give NULL."""
    number = F.trim(_col(value)).try_cast("bigint")
    convert = epoch_millis if millis else epoch_seconds
    return F.when(number != 0, convert(number))


def iso_utc(value: Column) -> Column:
    """ISO-8601 text with the UTC offset."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def heat_score(
    view: Column | str = "view_count",
    like: Column | str = "like_count",
    comment: Column | str = "comment_count",
    share: Column | str = "share_count",
    maxima: tuple[float, float, float, float] = HEAT_MAXIMA,
) -> Column:
    """Weighted logarithmic popularity, 100 when every count reaches its maximum."""
    total = F.lit(0.0)
    for weight, count, top in zip(HEAT_WEIGHTS, (view, like, comment, share), maxima):
        if top > 0:
            part = F.ln(1 + _col(count)) / F.ln(F.lit(1 + top)) * F.lit(100.0)
            total = total + F.lit(weight) * part
    return F.round(total, 2)


def parse_count(text: Column | str) -> Column:
    """Counts such as ``1.2万`` or ``3亿``; anything unreadable is zero."""
    t = F.trim(_col(text))
    digits = F.regexp_replace(t, r"(?U)[^\d]", "").try_cast("bigint")

    def scaled(mark: str, factor: int) -> Column:
        number = F.trim(F.replace(t, F.lit(mark), F.lit(""))).try_cast("double")
        return (number * factor).cast("bigint")

    value = (
        F.when(t.contains("万"), scaled("万", 10_000))
        .when(t.contains("亿"), scaled("亿", 100_000_000))
        .otherwise(digits)
    )
    return F.coalesce(value, F.lit(0).cast("bigint"))


def parse_datetime(text: Column | str, as_of: Column) -> Column:
    """``yyyy-MM-dd HH:mm``, ``MM-dd HH:mm`` (year of ``as_of``) or ``yyyy-MM-dd``."""
    t = F.trim(_col(text))
    dated = F.concat(F.year(as_of).cast("string"), F.lit("-"), t)

    def attempt(value: Column, fmt: str) -> Column:
        return F.try_to_timestamp(value, F.lit(fmt)).cast("timestamp_ntz")

    return F.coalesce(
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$"), attempt(t, "yyyy-M-d H:m")),
        F.when(t.rlike(r"^\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$"), attempt(dated, "yyyy-M-d H:m")),
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), attempt(t, "yyyy-M-d")),
    )


# How each platform writes an article number into its urls.
URL_ID_PATTERNS: dict[str, str] = {
    "kr36": r"/p/(\d+)",
    "huxiu": r"/article/(\d+)",
    "juejin": r"/post/(\d+)",
    "zhihu_answer": r"/answer/(\d+)",
    "zhihu_question": r"/question/(\d+)",
    "toutiao": r"/(?:article|a|i|group)/(\d+)",
}


def id_from_url(url: Column | str, platform: str) -> Column:
    """The article id inside a url, NULL when there is none."""
    u = _col(url)
    if platform in URL_ID_PATTERNS:
        return blank_to_null(F.regexp_extract(u, URL_ID_PATTERNS[platform], 1))
    if platform == "bilibili":
        marked = blank_to_null(F.regexp_extract(u, r"cv(\d+)", 1))
        bare = F.trim(u)
        return F.coalesce(marked, F.when(bare.rlike(r"^\d+$"), bare))
    if platform == "maimai":
        query_id = blank_to_null(F.regexp_extract(u, r"[?&]gid=([^&#]+)", 1))
        path = F.regexp_replace(F.regexp_replace(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
        last_number = blank_to_null(F.regexp_extract(path, r"(?:^|.*/)(\d+)(?=/|$)", 1))
        return F.when(u.rlike(r"^\d+$"), u).otherwise(F.coalesce(query_id, last_number))
    if platform == "xiaohongshu":
        return blank_to_null(F.element_at(F.split(F.rtrim(u, F.lit("/")), "/"), -1))
    raise ValueError(f"no url id rule for {platform}")


def absolute_url(url: Column | str, host: str, fallback: Column | None = None) -> Column:
    """Prefix ``host`` to a path; other non-http values become ``fallback``."""
    u = _col(url)
    joined = F.concat(F.lit(host), u)
    if fallback is None:
        return F.when(u.startswith("http"), u).otherwise(joined)
    return F.when(u.startswith("http"), u).when(u.startswith("/"), joined).otherwise(fallback)


def text_prefix(text: Column | str, length: int = 200) -> Column:
    return F.left(_col(text), F.lit(length))


def make_summary(
    content: Column | str,
    *given: Column,
    length: int = 200,
    ellipsis: bool = False,
) -> Column:
    """First non-empty of ``given``, else the head of the content."""
    c = _col(content)
    head = text_prefix(c, length)
    if ellipsis:
        head = F.when(F.length(c) > length, F.concat(head, F.lit("..."))).otherwise(head)
    return F.coalesce(*[blank_to_null(g) for g in given], head)


def url_key(url: Column | str) -> Column:
    return F.md5(_col(url))


def json_list(tags: Column | str) -> Column:
    """Tags column to ARRAY<STRING>; NULL when it is not a JSON array."""
    t = _col(tags)
    return F.when(F.ltrim(t).startswith("["), F.from_json(t, "array<string>"))


def tags_text(tags: Column | str) -> Column:
    """Tags for a flat export: joined, or the raw text when malformed."""
    return F.coalesce(F.array_join(json_list(tags), ", "), _col(tags), F.lit(""))


def comma_list(text: Column | str) -> Column:
    parts = F.transform(F.split(_col(text), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def tags_array(tags: Column | str) -> Column:
    """JSON list, else comma separated text, without blanks."""
    t = _col(tags)
    return F.when(t.isNull(), F.array().cast("array<string>")).otherwise(
        F.coalesce(json_list(t), comma_list(t))
    )


def clamp_score(score: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), _col(score).cast("double")))


def pct_text(part: Column, whole: Column) -> Column:
    """``12.3%``; ``0%`` for an empty whole."""
    return F.when(whole > 0, F.format_string("%.1f%%", F.round(part / whole * 100.0, 1))).otherwise("0%")
