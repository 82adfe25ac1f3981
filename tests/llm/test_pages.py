"""Malformed pages take time in proportion to their length."""

import time

from topicpulse.llm import extraction


def _text(page):
    return extraction.cut(extraction.page_blocks(page), [])


def test_malformed_pages_are_linear():
    for make in (
        lambda n: "<a " * n,
        lambda n: "<div>" * (n // 5) + "x</section>" * (n // 5),
        lambda n: "<div" * (n // 4) + ">" + "<!--" * (n // 4) + "<script>" * (n // 8),
        lambda n: "<a \"'" * (n // 5) + ">" + "<p>x" * (n // 4),
    ):
        started = time.time()
        _text(make(300_000))
        assert time.time() - started < 20


def test_what_nothing_closes():
    assert _text("<p>one</p><!-- two > three") == "one" and _text("<p>one</p><!-- two") == "one"
    assert _text("<p>one</p><script>two <b> three") == "one" and _text("<p>one</p><script>x</script>two") == "one two"
    assert _text("<p>one</p> two <b") == "one two <b" and _text("<!-- a --><p>one") == "one"
