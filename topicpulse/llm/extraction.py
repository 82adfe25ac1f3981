"""Main text of pages by consensus host paths.

First pass: a page's containers are scored by the running text they hold outside links and
page furniture. From the best one up, the outermost container that adds text of the article
(headline, lead, further sections) has the page's vote for its generalised tag-class path.
Spark adds the votes up by host. Second pass: a page is cut along the best path of its host
that it has, up to the container that holds the whole article there; a page with none of
them uses its own best.

Defined cases: a null or empty html has an empty text; a null url or one without host
belongs to the host ``''``; repeated rows and ids vote and are extracted row by row; an
empty table gives no rows; other columns are ignored. Whatever the markup (unclosed,
misnested, cut off), a page is read once from front to back.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicpulse.llm.words import blocks
from topicpulse.session import saved, ship_package

PATHS_PER_HOST = 8  # best-voted paths a page is tried with before its own best one
PATH_DEPTH = 6  # a path names the nearest containers
PROSE_CHARS = 100  # running text from which a block beside page furniture counts as a paragraph

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"|</?([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")

CONTAINERS = frozenset("html body article main section div td th tr table tbody center header aside nav footer form".split())
_BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address hr head fieldset details summary "
    "thead tfoot caption option select button dialog menu hgroup search".split()
)
_VOID = frozenset("br hr img meta link input area base col embed source track wbr".split())
_FURNITURE = {
    **dict.fromkeys("form dialog menu fieldset search".split(), 1), **dict.fromkeys("nav footer aside".split(), 2),
    **dict.fromkeys("head select button option".split(), 3),
}
_CONTROLS = frozenset("input select button textarea".split())
CONTROL_CHARS = 80  # running text for each control from which a form is more than its controls
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FURNITURE_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription share sharing social "
    "sidebar side aside widget related recommended recommendations menu nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments respond replies reply discussion disqus pagination pager login signin "
    "signup search form toolbar copyright legal skip".split()
)
_PAGE_PARTS = frozenset("sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead".split())
# A token is furniture by one part if the others only place or wrap it: content-sidebar-wrap and has-sidebar are not.
_NEUTRAL_PARTS = frozenset(
    "left right top bottom upper lower primary secondary site page global inner outer box block area container wrapper wrap "
    "list item items link links bar section panel group row col column unit slot body text title heading post posts article "
    "articles entry story stories icon icons button buttons".split()
)
_HEADER_PARTS = frozenset(["header", "masthead"])
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
_ITEM_WALLS = frozenset("ul ol dl table body article div section".split())


class Node:
    """An element: its container path, own mark and what its blocks add up to.

    Marks: 0 none, 1 furniture as an article may hold, 2 furniture of the page, 3 never text.
    """

    __slots__ = ("container", "controls", "hidden", "in_article", "mark", "off", "parent", "path", "running", "tag")

    def __init__(self, tag: str, parent: Node | None, path: str | None, mark: int):
        self.tag, self.parent, self.path, self.mark = tag, parent, path, mark
        self.container = self if path or parent is None else parent.container
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        self.running = self.controls = 0
        self.hidden, self.off = False, 0


class Block:
    """A run of text between block borders: its text, characters inside links, its element."""

    __slots__ = ("link", "node", "text")

    def __init__(self, text: str, link: int, node: Node):
        self.text, self.link, self.node = text, link, node

    @property
    def furniture(self) -> bool:
        return self.node.off > 0


def _token_mark(token: str, tag: str, in_article: bool) -> int:
    """Mark of a class or id as a whole."""
    words = [w for w in _PART.findall(token) if not w.isdigit()]
    own = [w for w in words if w in _FURNITURE_PARTS or not in_article and w in _HEADER_PARTS]
    if not own or any(w not in own and w not in _NEUTRAL_PARTS for w in words) or tag == own[0] == "form":
        return 0
    return 1 + (not _PAGE_PARTS.isdisjoint(own))


def _traits(tag: str, attributes: str, in_article: bool) -> tuple[str, int]:
    """Generalised name of an element, and the mark that its attributes give it."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return tag, 0
    name, mark = tag, 0
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "class":
            parts = sorted(value.split())
            name = ".".join([tag, *(_DIGITS.sub("#", x) for x in parts)])
        if key in ("class", "id"):
            mark = max([mark, *(_token_mark(x, tag, in_article) for x in value.split())])
        elif key == "role":
            mark = max(mark, 2 * (value in _FURNITURE_ROLES and value != tag))
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            mark = 3
        elif key == "style" and "display:none" in value.replace(" ", ""):
            mark = 3
    return name, mark


def _settle(nodes: list[Node], lift: bool, most: float) -> None:
    """Furniture or not, by element: its own mark or that of an element around it.

    With ``lift``, what a page without another article has as main, as article or as most of
    its running text is not furniture for where it stands.
    """
    shown = any(n.tag in ("article", "main") and n.running and not n.off for n in nodes) if lift else False
    for n in nodes[1:]:
        up = n.parent
        if lift and n.mark in (1, 2) and not up.off and not shown and n.running > most:
            n.mark = 0
        n.hidden = up.hidden or n.mark == 3
        n.off = max(up.off, n.mark)
        if lift and n.off and not n.mark and not n.hidden and not n.in_article:
            if n.tag == "main" or n.tag == "article" and (not shown or n.running > most):
                n.off = 0


def _mark(nodes: list[Node], found: list[Block]) -> None:
    for b in found:
        b.node.running += max(len(b.text) - b.link, 0)
    for n in reversed(nodes[1:]):
        n.parent.running += n.running
        n.parent.controls += n.controls
        # A form around a page is no furniture.
        if n.tag == "form" and n.mark == 1 and n.running >= CONTROL_CHARS * n.controls:
            n.mark = 0
    most = nodes[0].running / 2
    _settle(nodes, False, most)
    inside = any(n.off and n.tag in ("article", "main") and not n.mark and not n.hidden and not n.in_article for n in nodes)
    if inside:
        _settle(nodes, True, float("inf") if any(b.node.tag == "h1" and not b.node.off for b in found) else most)
    elif not any(b.node.tag == "h1" and not b.node.off for b in found):
        _settle(nodes, True, most)


def _ends_open(m: re.Match) -> bool:
    """Whether a comment or an element of raw text goes on to the end of the page."""
    if m[1]:
        return not re.search(rf"</{m[1]}\s*>\Z", m[0], re.I)
    return m[0].startswith("<!--") and not m[0].endswith("-->")


def page_blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order."""
    out: list[Block] = []
    nodes = [Node("html", None, "html", 0)]
    stack = nodes[:]
    text: list[str] = []
    link, in_link, at, unclosed = 0, 0, 0, False

    def flush() -> None:
        nonlocal link
        if text:
            joined = "".join(text)
            joined = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
            if joined:
                out.append(Block(joined, min(link, len(joined)), stack[-1]))
            text.clear()
        link = 0

    still_open: Counter[str] = Counter()

    def pop() -> str:
        tag = stack.pop().tag
        still_open[tag] -= 1
        return tag

    def close(tag: str, walls: frozenset[str] = frozenset()) -> None:
        # A stray end tag does not walk the elements that are open.
        if not still_open[tag]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                while len(stack) > k:
                    pop()
                return
            if stack[k].tag in walls:
                return

    def opened(tag: str, path: str | None, mark: int) -> None:
        nodes.append(Node(tag, stack[-1], path, mark))
        stack.append(nodes[-1])
        still_open[tag] += 1

    # No tag ends behind the last ">", so none is looked for there.
    limit = page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, limit):
        start = m.start()
        if start > at:
            piece = page[at:start]
            text.append(piece)
            if in_link:
                link += len(piece)
        at = m.end()
        tag = m[3] or m[5]
        unclosed = not tag and at == limit and _ends_open(m)
        if not tag:
            stack[-1].controls += (m[1] or "").lower() == "textarea"
            continue
        tag = tag.lower()
        ending = m[2] == "/" or (m[5] is not None and m[0][1] == "/")
        attributes = m[4] or ""
        if tag in _CONTROLS and not ending:
            stack[-1].controls += not ("hidden" in attributes.lower() and tag == "input")
        if tag == "a":
            in_link = 0 if ending else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in _BLOCKS:
            if tag in _VOID or not (ending or attributes):
                continue
            if ending:
                if any(tag == s.tag for s in stack[-4:]):
                    flush()
                    close(tag)
            elif not attributes.endswith("/") and (mark := _traits(tag, attributes, True)[1]):
                flush()
                opened(tag, None, mark)
            continue
        flush()
        if ending:
            close(tag)
            continue
        in_link = in_link if tag in ("div", "p", "h1", "h2", "h3", "h4", "section", "article", "figure") else 0
        if stack[-1].tag == "p" or stack[-1].tag in _HEADINGS:
            pop()
        for sibling in _CLOSES.get(tag, ()):
            close(sibling, _ITEM_WALLS)
        if tag in _VOID or _SELF_CLOSED.search(attributes):
            continue
        in_article = stack[-1].in_article or stack[-1].tag in ("article", "main")
        name, mark = _traits(tag, attributes, in_article)
        if tag in ("html", "body"):
            mark = 0
        elif tag == "header":
            mark = max(mark, 2 * (not in_article))
        mark = max(mark, _FURNITURE.get(tag, 0))
        path = None
        if tag in CONTAINERS and tag != "html":
            path = ">".join(stack[-1].container.path.split(">")[-PATH_DEPTH + 1 :] + [name])
        opened(tag, path, mark)
    if not unclosed:
        # A comment that nothing ends hides the rest.
        text.append(page[at:].partition("<!--")[0])
    flush()
    _mark(nodes, out)
    return out


class Sums:
    """What a container holds: running text, text in links, in paragraphs, in the page's furniture, in headlines."""

    __slots__ = ("far", "headline", "link", "prose", "running", "score", "weight")

    def __init__(self):
        self.running = self.link = self.prose = self.far = self.headline = 0
        self.weight = self.score = 0.0


def containers(found: list[Block]) -> dict[Node, Sums]:
    """Each container with text and its sums, outer ones first; the score halves with every level up."""
    sums: dict[Node, Sums] = {}
    for b in found:
        chain, n = [], b.node.container
        while n is not None and n not in sums:
            chain.append(n)
            n = n.parent and n.parent.container
        sums.update((n, Sums()) for n in reversed(chain))
        own = sums[b.node.container]
        if b.furniture:
            own.far += len(b.text) * (b.node.off == 2)
            continue
        running = len(b.text) - b.link
        own.running += running
        own.link += b.link
        own.weight += running
        own.prose += running * (running >= PROSE_CHARS)
        own.headline += running * (b.node.tag == "h1")
    for n, own in reversed(sums.items()):
        own.score = own.weight * (3.0 if n.tag in ("article", "main") else 1.0)
        if n.parent is not None:
            up = sums[n.parent.container]
            up.weight += own.weight / 2
            for name in ("running", "link", "prose", "far", "headline"):
                setattr(up, name, getattr(up, name) + getattr(own, name))
    return sums


def whole(n: Node, sums: dict[Node, Sums]) -> Node:
    """The outermost container around ``n`` that adds more of the article.

    All of an article element is, nothing outside a main is. Above, links that outweigh the running text end it, and so does
    furniture of the page unless a headline or, without an article element, paragraphs come with it.
    """
    article, up = n.tag == "article", n
    while up.parent is not None:
        up = up.parent.container
        if up.tag == "article":
            n, article = up, True
    at = n
    while at.parent is not None and at.tag != "main":
        up = at.parent.container
        old, new = sums[at], sums[up]
        running = new.running - old.running
        if new.link - old.link > running:
            break
        if new.far > old.far and new.headline == old.headline and (article or new.prose == old.prose):
            break
        at = up
        if running:
            n = up
    return n


def best_container(sums: dict[Node, Sums], path: str | None = None) -> Node | None:
    """The container, of ``path`` if given, with the highest score; the first of equal ones."""
    own = [n for n, s in sums.items() if s.score > 0 and path in (None, n.path)]
    return max(own, key=lambda n: sums[n].score, default=None)


def vote(page: str) -> str | None:
    """Path of the container that holds the page's whole article."""
    sums = containers(page_blocks(page))
    best = best_container(sums)
    return best and whole(best, sums).path


def cut(found: list[Block], paths: list[str]) -> str:
    """The article's text, from the first of ``paths`` that the page has, else from its own best container."""
    sums = containers(found)
    have = {n.path for n, s in sums.items() if s.running + s.link}
    path = next((p for p in paths if p in have), None)
    best = best_container(sums, path)
    top = best and whole(best, sums)
    inside: dict[Node, bool] = {}
    for n in sums:
        inside[n] = path is top is None or n is top or n.path == path or n.parent is not None and inside[n.parent.container]
    return " ".join(b.text for b in found if not b.furniture and inside[b.node.container])


def host_of(url) -> F.Column:
    host = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def host_paths(pages: DataFrame, keep: int = PATHS_PER_HOST) -> DataFrame:
    """(host, paths): each host's best-voted container paths, best first."""
    ship_package(pages.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "html"):
            votes: dict[tuple[str, str], float] = defaultdict(float)
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                path = vote(page or "")
                if path is not None:
                    votes[host, path] += 1
            rows = [pa.array([k[i] for k in votes], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(votes.values(), pa.float64())], names=["host", "path", "vote"])

    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    votes = votes.mapInArrow(count, "host string, path string, vote double").groupBy("host", "path")
    votes = votes.agg(F.sum("vote").alias("vote"))
    best = Window.partitionBy("host").orderBy(F.desc("vote"), "path")
    ranked = votes.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= keep)
    return ranked.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "path")))["path"].alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    paths = saved(host_paths(pages), "host-paths")
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "html"):
            texts = [
                cut(page_blocks(page or ""), paths or [])
                for page, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)
            ]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    joined = pages.join(paths, "host", "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract(spark.read.parquet(f"{folder}/pages.parquet"))


QUERIES = {"op9_extraction": op9_extraction}
ORACLE_SQL: dict[str, str] = {}
