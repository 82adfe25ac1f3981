"""A small element tree over ``html.parser``, for picking the main text of a page.

Runs inside tasks on Arrow batches; see :mod:`topicpulse.functions.page_text`.
"""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

_VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr".split()
)
_QUIET = frozenset(["script", "style", "template"])


class Node:
    __slots__ = ("name", "attrs", "parent", "children")

    def __init__(self, name: str, attrs: dict[str, str], parent: "Node | None") -> None:
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []

    def walk(self):
        """Elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def _strings(self):
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.name not in _QUIET:
                stack.extend(reversed(item.children))

    def text(self, separator: str = "", strip: bool = False) -> str:
        parts = self._strings()
        if strip:
            parts = (p for p in (s.strip() for s in parts) if p)
        return separator.join(parts)

    def markup(self) -> str:
        """The element as HTML again."""
        out: list[str] = []
        todo: list[tuple[Node | str, bool]] = [(self, False)]
        while todo:
            item, done = todo.pop()
            if isinstance(item, str):
                out.append(item if done else escape(item, quote=False))
            elif item.name in _VOID:
                out.append(f"<{item.name}{item._shown()}/>")
            else:
                out.append(f"<{item.name}{item._shown()}>")
                todo.append((f"</{item.name}>", True))
                todo.extend((c, item.name in _QUIET) for c in reversed(item.children))
        return "".join(out)

    def _shown(self) -> str:
        return "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())

    def drop(self, names: frozenset[str]) -> None:
        """Remove elements with these names, with all they hold."""
        todo = [self]
        while todo:
            node = todo.pop()
            node.children = [c for c in node.children if isinstance(c, str) or c.name not in names]
            todo.extend(c for c in node.children if isinstance(c, Node))

    def first(self, test) -> "Node | None":
        return next((n for n in self.walk() if test(n)), None)

    def all(self, test) -> "list[Node]":
        return [n for n in self.walk() if test(n)]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("[document]", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.top)
        self.top.children.append(node)
        if tag not in _VOID:
            self.top = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        while self.open.get(tag):
            closed = self.top
            self.open[closed.name] -= 1
            self.top = closed.parent
            if closed.name == tag:
                break

    def handle_data(self, data):
        siblings = self.top.children
        if siblings and isinstance(siblings[-1], str):
            siblings[-1] += data
        else:
            siblings.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def selector(css: str):
    """A test for one simple selector: tag, .class, #id, [attr=value], [attr*=value]."""
    tag, rest = css, ""
    for mark in ".#[":
        if mark in css:
            tag, rest = css[: css.index(mark)], css[css.index(mark) :]
            break

    def has(node: Node) -> bool:
        if tag and node.name != tag:
            return False
        if not rest:
            return True
        if rest[0] == ".":
            return rest[1:] in node.attrs.get("class", "").split()
        if rest[0] == "#":
            return node.attrs.get("id") == rest[1:]
        name, _, value = rest[1:-1].partition("=")
        value = value.strip("'\"")
        if name.endswith("*"):
            return value in node.attrs.get(name[:-1], "")
        return node.attrs.get(name) == value if value else name in node.attrs

    return has


def any_of(css: str):
    """A test for a comma separated selector list."""
    tests = [selector(part.strip()) for part in css.split(",")]
    return lambda node: any(t(node) for t in tests)


def below(node: Node, outer, inner) -> "list[Node]":
    """Descendant pairs: nodes passing ``inner`` under a node passing ``outer``."""
    found, seen = [], set()
    for box in node.all(outer):
        for hit in box.all(inner):
            if id(hit) not in seen:
                seen.add(id(hit))
                found.append(hit)
    return found
