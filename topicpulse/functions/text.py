"""Text cleaning as chains of JVM regular expressions."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicpulse.functions.scalars import bind

# Unicode-aware classes; only a newline ends a line.
_FLAGS = "(?Ud)"

# White space other than the plain blank and the newline.
_ODD_SPACE = r"\t\x0b\f\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same for the JVM, whose test of a character is short: a bit set, then a single range for all others.
_ODD_SPACES = (
    r"[\t\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]+"
)
_SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if re.fullmatch(f"[ \\n{_ODD_SPACE}]", chr(c)))

# Advertisement patterns, applied in this order.
AD_PATTERNS = [
    r"[★☆❤✦✧►▶→]?\s*(点击)?(关注|点赞|转发|收藏|分享|订阅|在看|三连)[一下我们本号吧哦呀啊!！\s]*",
    r"(关注|扫码关注|长按识别|搜索)(公众号|微信号|服务号|订阅号)[「【\s]*\S{0,20}[」】]?\s*",
    r"扫[一]?码(关注|添加|领取|下载)[^\n]{0,30}",
    r"(限时(优惠|免费|特价|折扣)|点击(购买|领取|下载|报名)|免费(领取|试[用听看]|课程)|立即(购买|报名|领取|下载)|(优惠|活动|福利)(仅限|截止|即将|最后))[^\n]{0,40}",
    r"(下载|安装|打开)\s*(APP|App|app|客户端|应用)[^\n]{0,30}",
    r"(?m)^[\s]*(广告|推广|赞助|商业推广|品牌合作)\s*$",
    r"""https?://[^\s<>"')\]]+""",
    r"(微博|抖音号?|快手号?|小红书号?|B站)\s*[：:@]\s*\S{1,30}",
    r"@[\w\u4e00-\u9fff]{1,30}",
]

# Boilerplate patterns, applied in this order.
BOILERPLATE_PATTERNS = [
    r"(?iu)(©|&copy;|版权所有|Copyright)\s*[\d\-—–\s]*\S{0,50}",
    r"All [Rr]ights [Rr]eserved[.\s]*",
    r"(本文(转载自|来自|来源[：:]|选自|摘自|首发[于在]))[^\n]{0,60}",
    r"(来源|出处|作者|编辑|责编|责任编辑)\s*[：:]\s*\S{1,30}",
    r"(免责声明|声明[：:]|侵权请联系|如有侵权|如需转载|转载请注明|本[文平台号站]仅|不代表本[平台号站]|仅供(参考|学习|交流))[^\n]{0,100}",
    r"(上一篇|下一篇|相关(文章|阅读|推荐)|猜你喜欢)\s*[：:]?\s*\S{0,50}",
    r"(阅读|查看|点击)\s*原文[^\n]{0,20}",
]

# Markdown syntax and what replaces it, applied in this order; last, what
# a text must hold for the pattern to match at all.
MARKDOWN_RULES = [
    (r"```[\s\S]*?```", "", ["```"]),
    (r"`[^`]+`", "", ["`"]),
    (r"!\[[^\]]*\]\([^)]+\)", "", ["!["]),
    (r"\[([^\]]+)\]\([^)]+\)", "$1", ["]("]),
    (r"(?m)^#{1,6}\s+", "", ["#"]),
    (r"\*{1,3}([^*]+)\*{1,3}", "$1", ["*"]),
    (r"_{1,3}([^_]+)_{1,3}", "$1", ["_"]),
    (r"(?m)^>\s?", "", [">"]),
    (r"(?m)^[-*_]{3,}\s*$", "", ["-", "*", "_"]),
    (r"\n{3,}", "\n\n", ["\n\n\n"]),
]

_SPACE_RULES = [
    (" {2,}", " ", ["  "]),
    (" +\n *|\n +", "\n", [" \n", "\n "]),
    ("\n{3,}", "\n\n", ["\n\n\n"]),
]
_TAG_RUN = r"(?:<[^>]+>)+"
_HIDDEN = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->"


# What a text must hold for the pattern of the same position to match at all.
_AD_HINTS = [
    ["关注", "点赞", "转发", "收藏", "分享", "订阅", "在看", "三连"],
    ["公众号", "微信号", "服务号", "订阅号"],
    ["扫码", "扫一码"],
    ["限时", "点击", "免费", "立即", "优惠", "活动", "福利"],
    ["下载", "安装", "打开"],
    ["广告", "推广", "赞助", "品牌合作"],
    ["http"],
    ["微博", "抖音", "快手", "小红书", "B站"],
    ["@"],
]
_BOILERPLATE_HINTS = [
    # Letters without special case folding stand for the whole word.
    ["©", "版权所有", "~copyr", "~&copy"],
    ["eserved"],
    ["本文"],
    ["来源", "出处", "作者", "编辑", "责编"],
    ["声明", "侵权", "如需转载", "转载请注明", "仅", "不代表"],
    ["一篇", "相关", "猜你喜欢"],
    ["原文"],
]


def _replace_all(text: Column, rules: Iterable[tuple[str, str, list[str]]]) -> Column:
    """Apply ``(pattern, replacement, words)`` in turn; texts without the words skip the regex.

    A word after ``~`` is looked for in any case.
    """

    def step(t: Column, rule: tuple[str, str, list[str]]) -> Column:
        pattern, to, words = rule

        def holds(x: Column, some: list[str]) -> Column:
            return reduce(lambda a, b: a | b, [x.contains(w) for w in some])

        def guarded(x: Column) -> Column:
            exact, folded = [w for w in words if w[0] != "~"], [w[1:] for w in words if w[0] == "~"]
            has = [holds(x, exact)] if exact else []
            has += [bind(F.lower(x), lambda low: holds(low, folded))] if folded else []
            hit = reduce(lambda a, b: a | b, has)
            return F.when(hit, F.regexp_replace(x, _FLAGS + pattern, to)).otherwise(x)

        return bind(t, guarded)

    return reduce(step, rules, text)


_HAN = "[\u4e00-\u9fff]"


def _remove(text: Column, patterns: list[str], hints: list[list[str]]) -> Column:
    """Take the patterns out in turn; a text without Chinese characters can only hold the other words.

    Removals add no character, so the text is asked once, and one of ASCII alone by its size.
    """
    rules = [(p, "", h) for p, h in zip(patterns, hints)]
    others = [(p, to, [w for w in h if not re.search(_HAN, w)]) for p, to, h in rules]
    others = [r for r in others if r[2]]

    def chosen(t: Column) -> Column:
        han = (F.octet_length(t) > F.length(t)) & t.rlike(_HAN)
        return F.when(han, _replace_all(t, rules)).otherwise(_replace_all(t, others))

    return bind(text, chosen)


# Rows of an Arrow batch that a Python worker holds as objects at a time.
SLICE_ROWS = 256


def in_slices(batches: Iterable[pa.Array], each: Callable[[list], pa.Array]) -> Iterator[pa.Array]:
    """``each`` over a few rows at a time, so that a batch of long texts is never held twice."""
    for batch in batches:
        for start in range(0, len(batch), SLICE_ROWS):
            yield each(batch.slice(start, SLICE_ROWS).to_pylist())


def _decoded(texts: pa.Array, decode: Callable[[str], str]) -> pa.Array:
    parts = in_slices([texts], lambda some: pa.array([None if t is None else decode(t) for t in some], pa.string()))
    return pa.chunked_array(parts, pa.string()).combine_chunks()


@F.arrow_udf(T.StringType())
def _unescape(text: pa.Array) -> pa.Array:
    return _decoded(text, html.unescape)


@F.arrow_udf(T.StringType())
def _unescape_twice(text: pa.Array) -> pa.Array:
    return _decoded(text, lambda t: html.unescape(html.unescape(t)))


def unescape(text: Column, twice: bool = False) -> Column:
    """Decode HTML entities; only rows holding an ampersand travel to Python."""
    decode = _unescape_twice if twice else _unescape
    return F.coalesce(decode(F.when(text.contains("&"), text)), text)


def trim_space(text: Column) -> Column:
    """Strip all white space on both ends."""
    return F.trim(text, F.lit(_SPACE_CHARS))


def strip_html(text: Column) -> Column:
    """Text of the visible nodes, one node per line, entities decoded twice."""
    t = F.coalesce(text, F.lit(""))

    def visible(x: Column) -> Column:
        shown = F.regexp_replace(x, _HIDDEN, "<x>")
        # A tag run at either end leaves no line break behind.
        marked = F.regexp_replace(shown, rf"\A{_TAG_RUN}|{_TAG_RUN}\z", "")
        return F.when(x.contains("<"), F.regexp_replace(marked, _TAG_RUN, "\n")).otherwise(x)

    return unescape(bind(t, visible), twice=True)


def node_text(text: Column) -> Column:
    """Visible text nodes, each trimmed, empty ones dropped, one per line."""
    shown = F.regexp_replace(F.coalesce(text, F.lit("")), _HIDDEN, "<x>")
    nodes = F.split(F.regexp_replace(shown, _TAG_RUN, "\x01"), "\x01")
    kept = F.filter(F.transform(nodes, trim_space), lambda n: n != "")
    return unescape(F.array_join(kept, "\n"))


def strip_tags(text: Column, collapse: bool = False) -> Column:
    """Drop tags without a trace; optionally squeeze white space to one blank."""
    bare = bind(text, lambda t: F.when(t.contains("<"), F.regexp_replace(t, "<[^>]+>", "")).otherwise(t))
    bare = trim_space(bare)
    return F.regexp_replace(bare, f" *[\n{_ODD_SPACE}][ \n{_ODD_SPACE}]*|  +", " ") if collapse else bare


def remove_ads(text: Column) -> Column:
    return _remove(text, AD_PATTERNS, _AD_HINTS)


def remove_boilerplate(text: Column) -> Column:
    return _remove(text, BOILERPLATE_PATTERNS, _BOILERPLATE_HINTS)


def normalize_whitespace(text: Column) -> Column:
    """One blank between words, trimmed lines, at most one empty line in a row."""
    squeezed = _replace_all(F.regexp_replace(text, _ODD_SPACES, " "), _SPACE_RULES)
    return F.trim(squeezed, F.lit(" \n"))


def clean_stages(text: Column) -> list[tuple[str, Column]]:
    """The cleaning steps in order, each applied to the one before."""
    a = strip_html(text)
    b = remove_ads(a)
    c = remove_boilerplate(b)
    return [("html", a), ("ads", b), ("boilerplate", c), ("space", normalize_whitespace(c))]


def clean_text(text: Column) -> Column:
    return clean_stages(text)[-1][1]


def markdown_to_text(md: Column) -> Column:
    return trim_space(_replace_all(F.coalesce(md, F.lit("")), MARKDOWN_RULES))
