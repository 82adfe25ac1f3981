"""Cases that an operator saw only a part of."""

import zlib

import corpus_pipeline
from topicpulse.llm import extraction, pii

SCHEMA = "doc_id long, text string, source string"
PLAIN = "the of and for with from that this was are not but had".split()


def test_names_far_from_an_entity_and_in_other_texts(spark):
    far = " ".join(PLAIN)
    texts = [f"note{i} Quimby {far} jo@x.org {far} Quimby" for i in range(6)]
    texts += [f"other{i} {far}" for i in range(24)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    rows += [(None, f"Here {far} (Quimby)", "s"), (90, f"Then al@y.org {far} Quimby", "s"), (90, f"So al@y.org {far} of", "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = {(r.doc_id, r.n_email): r.spans for r in pii.span_digests(pii.disclosures(docs)).collect()}
    last = texts[0].rindex("Quimby")
    assert "term:6:12" in marks[0, 1] and f"term:{last}:{last + 6}" in marks[0, 1]
    clean = [r.text for r in pii.sanitise(docs).collect()]
    assert len(clean) == len(rows) and not any("Quimby" in t for t in clean)
    assert f"Here {far} ([NAME])" in clean and sum(far in t for t in clean) == len(rows)


def test_shared_lines_and_rare_names_reveal(spark):
    far = " ".join(PLAIN)
    line = "signed Wexford of signed jo@x.org of signed"
    texts = [f"{w} {far} {line} {far}" for w in PLAIN] + [f"{far} {w} signed" for w in PLAIN * 2]
    texts += [f"Mail Orlofsky {far} al@y.org"] + [f"Copied Tamsin {far} eve@z.org"] * 5 + [f"Tamsin {far} {w}" for w in PLAIN]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any("Wexford" in t or "Orlofsky" in t for t in clean.values())
    # One text and its copies beside twelve others do not tie a name to an entity.
    assert sum("Tamsin" in t for t in clean.values()) == 5 + len(PLAIN)
    assert sum(far in t for t in clean.values()) == len(texts)


def _text(page: str) -> str:
    return extraction.cut(extraction.page_blocks(page), [])


def test_articles_in_wrappers_that_look_like_furniture():
    body = "<p>" + "plain words of an article that runs on, " * 8 + "</p>"
    want = " ".join(body[3:-4].split())
    for name in ("content-sidebar-wrap", "has-sidebar", "no-comments", "post with-ads"):
        assert _text(f"<body><nav><a href=x>menu</a></nav><div class='{name}'>{body}</div><footer>f</footer>") == want
    assert _text(f"<body><form id='form1' action=x><input type=hidden name=s><div>{body}</div><input type=submit></form>") == want
    assert _text(f"<body><div class=widget><main>{body}</main></div><div>short</div>") == want
    assert _text(f"<body><div class=sidebar><article>{body}</article></div>") == want
    assert _text(f"<body><div class=widget><div class=x>{body}</div></div><footer>f</footer>") == want
    assert _text(f"<body><div class='ad'/><div class=post>{body}</div><footer>f</footer>") == want
    page = f"<body><article>{body}</article><div class='ad-7'>buy</div><aside><article>{body}</article></aside><form><p>Mail<input><input></p></form>"
    assert _text(page) == want
    assert _text(f"<body><div class=post><h1>T</h1>{body}<div class=comments><div>{body * 3}</div></div></div>") == f"T {want}"


def test_articles_that_are_not_flat():
    body = "<p>" + "plain words of an article that runs on, " * 8 + "</p>"
    want = " ".join(body[3:-4].split())
    menu, foot = "<nav><a href=x>menu</a></nav>", "<footer>f</footer>"
    page = f"<body>{menu}<div class='post'><h1>T</h1><div class='lead'>Lead</div><div class='body'>{body}</div><div class=share>S</div></div>{foot}"
    assert _text(page) == f"T Lead {want}"
    assert extraction.cut(extraction.page_blocks(page), ["html>body>div.post>div.body"]) == f"T Lead {want}"
    assert _text(f"<body>{menu}<article><header><h1>T</h1></header><div class=e><div class=i>{body}</div></div></article>{foot}") == f"T {want}"
    assert _text(f"<body>{menu}<main><h1>T</h1><article>{body}</article><aside>a</aside></main>{foot}") == f"T {want}"
    assert _text(f"<body>{menu}<section class=a>{body}</section><section class=b>{body}{body}</section>{foot}") == " ".join([want] * 3)
    deep = "<div>" * 9 + "Deep" + "</div>" * 9
    assert _text(f"<body>{menu}<article>{body}{deep}</article>{foot}") == f"{want} Deep"
    links = "<div class=more>" + "<a href=x>other article</a> " * 9 + "</div>"
    assert _text(f"<body>{menu}<div class=a>{body}</div>{links}{foot}") == want


def test_the_pipeline_ends_in_token_ids(spark):
    docs = spark.createDataFrame([(1, "one two three", "a"), (2, None, "b"), (3, "naïve 日本", "a")], SCHEMA)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in rows} == {1, 2, 3}
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
