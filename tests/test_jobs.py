"""Streaming in several batches, updates, sinks and page text."""

import csv
import datetime as dt
import os
import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F

from topicpulse.functions import html_dom
from topicpulse.functions import page_text as P
from topicpulse.operators import ingest, ranges, reports, updates
from topicpulse.operators import relations as R
from topicpulse.plans import streaming as PS
from topicpulse.session import new_folder
from topicpulse.sources.tables import SampleStore, crawl_logs_of
from topicpulse.streaming import jobs as J

LOG = "id bigint, platform string, start_time timestamp_ntz, status string"


def _log(ids_and_states, platform="hot"):
    start = dt.datetime(2024, 1, 1)
    return [(i, platform, start + dt.timedelta(hours=i), s) for i, s in ids_and_states]


def _staged(spark, parts):
    """One file per part, in arrival order."""
    folder = new_folder(spark, "staged")
    for rows in parts:
        rows.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    return folder


def _running(rows):
    """Brute force: the streak after each row, in order of (start_time, id) by platform."""
    runs, n = {}, {}
    for i, platform, at, status in sorted(rows, key=lambda r: (r[2], r[0])):
        n[platform] = 0 if status == "completed" else n.get(platform, 0) + 1
        runs[i] = n[platform]
    return runs


def test_streak_is_carried_over_batches(spark):
    """Rows late by less than the delay count in their place; later ones are dropped and counted."""
    import random

    rng = random.Random(3)
    rows = _log([(i, rng.choice(["failed", "failed", "failed", "completed"])) for i in range(200)])
    rows += [(1000 + i, "other", r[2], "failed") for i, r in enumerate(rows)]
    # Hour h arrives in batch h // 50, every fifth row one batch (50 hours) late.
    batch = lambda r: min(int((r[2] - dt.datetime(2024, 1, 1)).total_seconds() // 3600) // 50 + (r[0] % 5 == 1), 4)
    parts = [[r for r in rows if batch(r) == n] for n in range(5)]
    too_late = (5000, "hot", dt.datetime(2024, 1, 1, 0, 30), "completed")
    parts[4].append(too_late)
    folder = _staged(spark, [spark.createDataFrame(p, LOG) for p in parts])
    stream = J.failure_streak_stream(J.read_stream(spark, folder, files_per_batch=1), delay="101 hours")
    out, late = J.run_counted(stream)
    passed = dt.datetime(2024, 1, 1) + dt.timedelta(hours=199 - 101)
    want = {i for i, n in _running(rows).items() if n == 5}
    times = {r[0]: r[2] for r in rows}
    assert {r.id for r in out.collect()} == {i for i in want if times[i] < passed}
    assert late == 1


def test_a_platform_of_one_day_fills_all_ranges(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "hot", start + dt.timedelta(seconds=i // 3), "completed" if i % 37 == 5 else "failed") for i in range(20_000)]
    rows += [(30_000 + i, None if i % 2 else "b", None if i == 4 else start, "failed") for i in range(6)]
    logs = spark.createDataFrame(rows, LOG)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = ranges.in_ranges(logs.repartition(8), ["platform", "start_time", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in cut.groupBy("_part").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 2 * sum(sizes) / len(sizes)
    got = {r.id: r.streak for r in ingest.failure_streaks(logs, F.col("status") != "completed").collect()}
    assert len(got) == len(rows)
    assert {i: n for i, n in got.items() if i < 30_000} == {i: n for i, n in _running(rows[:20_000]).items()}
    assert sorted(n for i, n in got.items() if i >= 30_000) == [1, 1, 2, 2, 3, 3]


def test_running_sum_by_key(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice([None, "a", "a", "a", "b"]), rng.choice([None, 1, 2, 3])) for i in range(500)]
    frame = spark.createDataFrame(rows, "i bigint, k string, v bigint").repartition(8)
    want, sums = {}, {}
    for i, k, v in rows:
        sums[k] = sums.get(k, 0) + (v or 0)
        want[i] = sums[k]
    got = ranges.running_sum(frame, ["k"], ["i"], F.col("v"), "s")
    assert got.columns == ["i", "k", "v", "s"]
    assert {r.i: r.s for r in got.collect()} == want
    assert ranges.running_sum(frame.limit(0), ["k"], ["i"], F.col("v"), "s").collect() == []


def test_streaks_do_not_depend_on_the_segments(spark):
    import random

    rng = random.Random(7)
    rows = _log([(i, rng.choice(["failed", "failed", "failed", "completed"])) for i in range(300)])
    logs = spark.createDataFrame(rows, LOG)
    failed = F.col("status") != "completed"
    runs, n = {}, 0
    for i, _, _, s in rows:
        n = n + 1 if s != "completed" else 0
        runs[i] = n
    for segment in (None, F.date_trunc("month", "start_time"), F.col("start_time")):
        got = {r.id: r.streak for r in ingest.failure_streaks(logs, failed, segment=segment).collect()}
        assert got == runs


def test_stream_upsert_is_idempotent_over_batches(spark):
    schema = "id bigint, platform string, platform_id string, title string, ord bigint"
    one = spark.createDataFrame([(1, "p", "a", "old", 1), (2, "p", None, "loose", 2)], schema)
    two = spark.createDataFrame([(9, "p", "a", "new", 3), (3, "p", "b", "b", 4)], schema)
    folder = _staged(spark, [one, two])
    log = J.ChangeLog(spark, new_folder(spark, "t"), "id bigint, platform string, platform_id string, title string")
    J.upsert_stream(J.read_stream(spark, folder, files_per_batch=1), log, "ord")
    want = {(1, "a", "new"), (2, None, "loose"), (3, "b", "b")}
    shown = lambda df: {(r.id, r.platform_id, r.title) for r in df.collect()}
    assert shown(log.latest()) == want
    # The last batch run again gives the same table.
    log.write(two, 1, "ord")
    assert shown(log.latest()) == want


def test_change_log_equals_one_upsert_after_another(spark):
    """Ten batches with missing values, a repeated batch and folding in between."""
    rng = random.Random(3)
    schema = "id bigint, platform string, platform_id string, title string, ord bigint"
    log = J.ChangeLog(spark, new_folder(spark, "t"), "id bigint, platform string, platform_id string, title string", buckets=4)
    stored: dict = {}
    loose = []
    for n in range(10):
        rows = []
        for k in range(rng.choice([0, 3, 8]) if n else 8):
            key = rng.choice(["a", "b", "c", "d", "e", "f", "", None])
            rows.append((100 * n + k, rng.choice("pq"), key, rng.choice([None, f"t{n}-{k}"]), k))
        batch: dict = {}
        for i, platform, key, title, _ in rows:
            if not key:
                loose.append((i, platform, key, title))
                continue
            before = batch.get((platform, key), (None, None))
            batch[platform, key] = (i, title if title is not None else before[1])
        for k, (i, title) in batch.items():
            old = stored.get(k)
            stored[k] = (old[0] if old else i, title if title is not None else old and old[1])
        frame = spark.createDataFrame(rows, schema)
        log.write(frame, n, "ord")
        if n in (3, 4, 7):
            log.compact()
        if n in (4, 8):
            log.write(frame, n, "ord")
    got = sorted(map(repr, ((r.id, r.platform, r.platform_id, r.title) for r in log.latest().collect())))
    assert got == sorted(map(repr, [*loose, *((i, p, k, t) for (p, k), (i, t) in stored.items())]))


def test_a_small_batch_writes_little(spark):
    columns = "id bigint, platform string, platform_id string, title string"
    path = new_folder(spark, "t")
    log = J.ChangeLog(spark, path, columns)
    big = spark.range(20_000).selectExpr("id", "'p' AS platform", "string(id) AS platform_id", "sha2(string(id), 256) AS title", "id AS ord")
    log.write(big, 0, "ord")
    log.write(big.where("id = 7").withColumn("title", F.lit("new")), 1, "ord")
    size = lambda n: sum(f.stat().st_size for f in pathlib.Path(f"{path}/changes/batch={n}").rglob("*.parquet"))
    assert size(1) * 100 < size(0)
    log.compact()
    folded = {p.name for p in pathlib.Path(f"{path}/folded").glob("bucket=*")}
    assert len(folded) == 1
    assert log.latest().where("title = 'new'").count() == 1 and log.latest().count() == 20_000


def test_late_rows_are_dropped_after_the_watermark(spark):
    schema = "demand_id bigint, seen_at timestamp_ntz"
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    # A batch judges lateness by the watermark the batch before it started with.
    parts = [[(1, day(0)), (1, day(1)), (1, day(120))], [(2, day(121))], [(1, day(2)), (1, day(240))]]
    folder = _staged(spark, [spark.createDataFrame(p, schema) for p in parts])
    out = J.run_to_table(J.weekly_snapshots(J.read_stream(spark, folder, files_per_batch=1)))
    got = {(r.snapshot_date, r.frequency) for r in out.collect()}
    assert (dt.date(2024, 1, 1), 2) in got and (dt.date(2024, 1, 1), 3) not in got


def test_copies_far_apart_arrive_once(spark):
    schema = "platform string, platform_id string, crawl_time timestamp"
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    parts = [[("p", "a", day(0)), ("p", "b", day(0))], [("p", "c", day(40))], [("p", "a", day(80)), ("p", "d", day(80))]]
    folder = _staged(spark, [spark.createDataFrame(p, schema) for p in parts])
    out = J.run_to_table(J.first_arrivals(J.read_stream(spark, folder, files_per_batch=1)))
    assert sorted(r.platform_id for r in out.collect()) == ["a", "b", "c", "d"]


def test_digest_of_a_crowded_article_is_one_row(spark):
    rows = [(i * 1000, 1, "u", f"c{i}", i) for i in range(25_000)] + [(100, 2, None, "x", 0)]
    comments = spark.createDataFrame(rows, "id bigint, article_id bigint, commenter string, content string, like_count bigint")
    got = {r.article_id: r for r in R.comment_digest(comments.repartition(8)).collect()}
    assert {k: r.n_comments for k, r in got.items()} == {1: 25_000, 2: 1}
    assert got[1].comments.split("\n") == [f"[u] (👍{i}): c{i}" for i in range(25_000)]


def _in_turn(demands, links, merges):
    """Brute force: one request after another. Returns demands, links and rejected requests."""
    demands, links = {i: [f, "new", None] for i, f in demands}, dict(links)
    gone, rejected = set(), set()
    for source, target, notes, ord_ in sorted(merges, key=lambda m: m[3]):
        if source == target or source in gone or source not in demands or target not in demands:
            rejected.add(ord_)
            continue
        gone.add(source)
        for article, at in [k for k in links if k[1] == source]:
            score = links.pop((article, at))
            links.setdefault((article, target), score)
        demands[target][0] += demands[source][0]
        demands[source][1:] = ["merged", f"Merged into demand #{target}" + (f" — {notes}" if notes else "")]
    return {(i, *v) for i, v in demands.items()}, {(*k, v) for k, v in links.items()}, rejected


def _merged(spark, demands, links, merges):
    d = spark.createDataFrame([(i, "t", f, "new") for i, f in demands], "id bigint, title string, frequency bigint, status string")
    m = spark.createDataFrame(merges, "source bigint, target bigint, notes string, ord bigint")
    k = spark.createDataFrame([(*k, v) for k, v in links.items()], "article_id bigint, demand_id bigint, relevance_score double")
    plan, rejected = updates.merge_plan(m, d)
    after = updates.merge_demands_into(d, plan)
    return (
        {(r.id, r.frequency, r.status, r.notes) for r in after.collect()},
        {(r.article_id, r.demand_id, r.relevance_score) for r in updates.merge_links(k, plan).collect()},
        {r.ord for r in rejected.collect()},
    )


def test_merge_chains_and_cycles(spark):
    demands = [(i, 10**i) for i in range(8)]
    links = {(a, d): a + d / 10 for a in range(3) for d in range(8) if (a + d) % 3}
    # a chain in order, a chain against it, a cycle; unknown, own and repeated sources
    merges = [(0, 1, "x", 1), (1, 2, None, 2), (4, 5, None, 4), (3, 4, "", 5), (6, 7, None, 6), (7, 6, None, 7)]
    merges += [(9, 1, None, 8), (2, 9, None, 9), (2, 2, None, 10), (0, 3, None, 11)]
    got = _merged(spark, demands, links, merges)
    assert got == _in_turn(demands, links, merges)
    assert got[2] == {8, 9, 10, 11}


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_equal_requests_in_turn(spark, seed):
    import random

    rng = random.Random(seed)
    demands = [(i, rng.randint(1, 9)) for i in range(60)]
    links = {(rng.randrange(12), rng.randrange(60)): float(i) for i in range(250)}
    merges = [(rng.randrange(60), rng.randrange(12 if seed == 1 else 60), None, o) for o in range(120)]
    # one long chain on top
    merges += [(i, i + 1, None, 200 + i) for i in range(59)]
    assert _merged(spark, demands, links, merges) == _in_turn(demands, links, merges)


def test_no_merge_requests(spark):
    demands, links = [(1, 5), (2, 6)], {(1, 1): 0.5, (1, 2): 0.25}
    assert _merged(spark, demands, links, []) == _in_turn(demands, links, [])


def test_the_last_supplied_change_counts(spark):
    demands = spark.createDataFrame([(1, "a", "new"), (2, "b", "new")], "id bigint, category string, status string")
    changes = spark.createDataFrame(
        [(1, None, "confirmed", 1), (1, "x", None, 2), (1, "y", None, 3)], "id bigint, category string, status string, ord bigint"
    )
    assert sorted(map(tuple, updates.update_fields(demands, changes).collect())) == [(1, "y", "confirmed"), (2, "b", "new")]


def test_purge_is_strict(spark):
    at = dt.datetime(2024, 1, 31)
    rows = [(1, at - dt.timedelta(days=10), "x"), (2, at - dt.timedelta(days=10, seconds=1), "x"), (3, None, "x")]
    articles = spark.createDataFrame(rows, "id bigint, crawl_time timestamp_ntz, raw_html string")
    got = updates.purge_raw_html(articles, F.lit(at).cast("timestamp_ntz"), 10).collect()
    assert {r.id for r in got if r.purged} == {2}


def test_csv_starts_with_a_byte_order_mark(spark):
    from conftest import SAMPLE

    from topicpulse.sources.tables import SampleStore

    path = new_folder(spark, "csv")
    reports.write_csv(reports.export_rows(SampleStore(spark, SAMPLE).demands).coalesce(1), path)
    local = path.replace("file:", "")
    first = next(os.path.join(local, n) for n in sorted(os.listdir(local)) if n.startswith("part-"))
    with open(first, "rb") as f:
        assert f.read(3) == b"\xef\xbb\xbf"


def test_report_lines_read_in_order(spark):
    from conftest import SAMPLE

    from topicpulse.sources.tables import SampleStore

    s = SampleStore(spark, SAMPLE)
    path = new_folder(spark, "report")
    reports.write_report(reports.weekly_report(s.articles, s.demands, s.as_of, s.articles_as_of), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    heads = [x for x in lines if x.startswith("#")]
    assert heads == ["# 职场需求周报 (2024-03-31)", "## 本周概览", "## 新发现的需求", "## 趋势上升 TOP 10", "## 热门文章 TOP 10", "## 分类统计"]


PAGE = """<html><head><style>p{}</style></head><body><nav>menu</nav><!-- x --><div class="content">
<p>First <b>bold</b> &amp; more<p>Second</div><footer>end</footer></body></html>"""


def _main_texts(spark, rule, *pages):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id bigint, html string")
    got = {r.id: r.text for r in P.with_main_text(rows, "html", "text", rule).collect()}
    return [got[i] for i in range(len(pages))]


def test_main_text_keeps_the_nesting_of_open_paragraphs(spark):
    boxed = "<body><div><div class='x post-body y'><p>a</p><div><p>b <i>c</i></p></div></div><p>out</p></div></body>"
    plain = "<body>one<div id='js_content'>two<br/>3 < 4</div></body>"
    got = _main_texts(spark, "article", PAGE, "<p>only</p>", "", None, boxed, plain, "<p>only</p>", "bare &amp;lt; text")
    assert got == ["First bold & more Second\nSecond", "only", "", "", "a\nb c", "two\n3 < 4", "only", "bare < text"]


def test_feed_text_wants_a_long_container(spark):
    short = "<body><article>tiny</article><div>rest</div></body>"
    long = "<body><article>" + "x" * 101 + "</article><div>rest</div></body>"
    second = "<body><article>tiny</article><main id=content>" + "<p>y</p>" * 60 + "</main></body>"
    nested = "<article><article>a</article>" + "b" * 101 + "</article>c</article>d"
    got = _main_texts(spark, "feed", short, long, second, nested)
    assert got == ["tiny\nrest", "x" * 101, "\n".join("y" * 60), "a\n" + "b" * 101]


def test_baijiahao_takes_the_longest_block(spark):
    known = "<div>aaaaaaaaa</div><p class='my-article-content'>b</p>"
    got = _main_texts(spark, "baijiahao", "<div>aa</div><div>aaaa</div><div>aaab</div>", known, "none", "<div>a<div>b</div></div>")
    assert got == ["aaaa", "b", "", "a\nb"]


def test_deep_nesting_does_not_recurse():
    root = html_dom.parse("<p>x" * 5000)
    root.drop(frozenset(["nav"]))
    assert root.markup().count("<p>") == 5000


_DEMANDS = """id bigint, title string, category string, subcategory string, frequency bigint, importance_score double, trend string,
    status string, first_seen timestamp_ntz, last_seen timestamp_ntz, tags string"""


def _some_demands(spark):
    at = dt.datetime(2024, 1, 2)
    rows = [(i, f't "{i}", x\\', ["a", "", None][i % 3], None, i % 7, 1.234, "rising", None, at, None, '["x","y"]') for i in range(40)]
    return spark.createDataFrame(rows, _DEMANDS)


def test_exports_come_back_in_order_with_their_mark(spark):
    path = new_folder(spark, "export")
    rows = reports.export_rows(_some_demands(spark))
    reports.write_csv(rows, path)
    assert sorted(map(repr, reports.read_csv(spark, path).collect())) == sorted(map(repr, rows.collect()))
    files = sorted(pathlib.Path(path).glob("part-*.csv"))
    read = []
    for f in files:
        with f.open(encoding="utf-8", newline="") as lines:
            table = list(csv.reader(lines))
        assert table[0][0] == "\ufeffID"
        read += [(-int(r[4]), int(r[0])) for r in table[1:]]
    assert read == sorted((-(i % 7), i) for i in range(40))


def test_documents_come_back(spark):
    path = new_folder(spark, "documents")
    documents = reports.property_documents(_some_demands(spark))
    reports.write_documents(documents, path)
    assert sorted(map(tuple, reports.read_documents(spark, path).collect())) == sorted(map(tuple, documents.collect()))


def test_a_failed_export_leaves_no_file(spark):
    path = new_folder(spark, "documents")
    broken = F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise(F.col("properties"))
    documents = reports.property_documents(_some_demands(spark).repartition(4)).withColumn("properties", broken)
    with pytest.raises(Exception, match="broken"):
        reports.write_documents(documents, path)
    assert not [f for f in pathlib.Path(path).rglob("*") if f.name.startswith("part-") or f.name == "_SUCCESS"]


@pytest.mark.parametrize("parts", [1, 3])
def test_a_streamed_table_may_be_a_folder_of_files(spark, parts):
    folder = new_folder(spark, "tables")
    spark.range(9).repartition(parts).write.parquet(f"{folder}/ids.parquet")
    spark.range(5).write.parquet(f"{folder}/other.parquet")
    out = J.run_to_table(J.read_stream(spark, folder, "ids.parquet"))
    assert sorted(r.id for r in out.collect()) == list(range(9))


def test_a_streamed_table_may_be_one_file(spark):
    folder = new_folder(spark, "tables")
    spark.range(9).coalesce(1).write.parquet(f"{folder}/made")
    made = next(pathlib.Path(folder, "made").glob("*.parquet"))
    made.rename(pathlib.Path(folder, "ids.parquet"))
    out = J.run_to_table(J.read_stream(spark, folder, "ids.parquet"))
    assert sorted(r.id for r in out.collect()) == list(range(9))


@pytest.mark.parametrize("file_rows", [3, 1000])
def test_arrivals_are_cut_once_and_streaks_hold_over_them(spark, file_rows, monkeypatch):
    folder, start = new_folder(spark, "tables"), dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=3 * i), 7, "error" if i % 9 else "click", 1.5, "{}") for i in range(240)]
    rows.append((999, None, 7, "error", 1.5, "{}"))
    columns = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, columns).repartition(4).write.parquet(f"{folder}/events.parquet")
    monkeypatch.setattr(J, "_BLOCK_ROWS", 2)
    stream = PS._arrivals(SampleStore(spark, folder), "events", "ts", "event_id", file_rows=file_rows)
    out = J.run_to_table(J.failure_streak_stream(crawl_logs_of(stream), delay="3 days"))
    last = start + dt.timedelta(hours=3 * 239) - dt.timedelta(days=3)
    runs = _running([(i, "p7", at, "failed" if kind == "error" else "completed") for i, at, _, kind, *_ in rows if at])
    want = sorted(i for i, n in runs.items() if n == 5 and rows[i][1] < last)
    assert sorted(r.id for r in out.collect()) == want


def test_an_upserted_table_is_staged_in_more_files_as_it_grows(spark, monkeypatch):
    folder, seen = new_folder(spark, "tables"), []
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id % 300) AS text", "'en' AS lang", "'s' AS source", "id % 5 AS n_chars")
    docs.repartition(24).write.option("maxRecordsPerFile", 10).parquet(f"{folder}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4kb")
    spark.conf.set("spark.sql.files.openCostInBytes", "1kb")
    read = J.read_stream
    monkeypatch.setattr(J, "read_stream", lambda spark, path, **kw: seen.append((path, kw)) or read(spark, path, **kw))
    try:
        got = PS.stream_upsert(SampleStore(spark, folder)).select("platform", "platform_id", "title").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (path, asked), = seen
    files = len(list(pathlib.Path(path).glob("part-*")))
    assert files > 4 and -(-files // asked["files_per_batch"]) == 4
    assert len(got) == docs.selectExpr("n_chars % 12", "md5(text)").distinct().count() == len(set(got))
