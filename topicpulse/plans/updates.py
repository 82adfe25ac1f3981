"""Updates as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse.operators import updates as U
from topicpulse.plans.registry import query
from topicpulse.sources.tables import SampleStore as Store


@query(
    "ups02_update_fields",
    """SELECT id, CASE WHEN id % 4 = 0 THEN 'archived' ELSE status END AS status,
       CASE WHEN id % 6 = 0 THEN 'moved' ELSE category END AS category, tags FROM demands""",
)
def update_fields(s: Store) -> DataFrame:
    i = F.col("id")
    changes = s.demands.select(
        "id",
        F.when(i % 4 == 0, "archived").alias("status"),
        F.when(i % 6 == 0, "moved").alias("category"),
        F.lit(None).cast("string").alias("tags"),
    )
    return U.update_fields(s.demands, changes).select("id", "status", "category", "tags")


@query("ups03_set_status", "SELECT id, CASE WHEN trend = 'declining' THEN 'archived' ELSE status END AS status FROM demands")
def set_status(s: Store) -> DataFrame:
    changes = s.demands.where("trend = 'declining'").select("id", F.lit("archived").alias("status"))
    return U.set_status(s.demands, changes).select("id", "status")


def _annotations(s: Store) -> DataFrame:
    i = F.col("id")
    action = F.when(i % 3 == 0, "confirm").when(i % 3 == 1, "reject").otherwise("maybe")
    moved = F.when(i % 50 == 0, -i).otherwise(i)
    return s.demands.select(moved.alias("id"), action.alias("action"), F.when(i % 2 == 0, "checked").alias("notes"))


def _with_notes(s: Store) -> DataFrame:
    return s.demands.withColumn("notes", F.lit(None).cast("string"))


_ANNOTATED = "(id % 50 <> 0 OR id = 0) AND id % 3 < 2"


@query(
    "ups04_annotate",
    f"""SELECT id, CASE WHEN {_ANNOTATED} THEN CASE id % 3 WHEN 0 THEN 'confirmed' ELSE 'rejected' END ELSE status END AS status,
        CASE WHEN {_ANNOTATED} AND id % 2 = 0 THEN 'checked' END AS notes FROM demands""",
)
def annotate(s: Store) -> DataFrame:
    return U.annotate(_with_notes(s), _annotations(s))[0].select("id", "status", "notes")


@query(
    "ups04_annotate_rejected",
    """SELECT CASE WHEN id % 50 = 0 THEN -id ELSE id END AS id, CASE WHEN id % 3 = 2 THEN 'action must be confirm or reject' ELSE 'demand not found' END AS reason
       FROM demands WHERE id % 3 = 2 OR (id % 50 = 0 AND id <> 0)""",
)
def annotate_rejected(s: Store) -> DataFrame:
    return U.annotate(_with_notes(s), _annotations(s))[1].select("id", "reason")


def _merges(s: Store) -> DataFrame:
    """Confirmed demands into their successors; some requests point nowhere."""
    i = F.col("id")
    target = F.when(i % 49 == 0, -1).otherwise(i + 1)
    return s.demands.where("status = 'confirmed'").select(
        i.alias("source"), target.alias("target"), F.when(i % 2 == 0, "same").alias("notes"), i.alias("ord")
    )


_SOURCE = "status = 'confirmed' AND id % 49 <> 0 AND id < (SELECT max(id) FROM demands)"


@query(
    "ups05_merge_demands",
    f"""SELECT d.id, d.frequency + coalesce(g.frequency, 0) AS frequency, CASE WHEN {_SOURCE.replace("status", "d.status").replace("id ", "d.id ").replace("max(d.id", "max(id")} THEN 'merged' ELSE d.status END AS status,
        CASE WHEN {_SOURCE.replace("status", "d.status").replace("id ", "d.id ").replace("max(d.id", "max(id")} THEN concat('Merged into demand #', d.id + 1, CASE WHEN d.id % 2 = 0 THEN ' — same' ELSE '' END) END AS notes
        FROM demands d LEFT JOIN (SELECT id + 1 AS id, frequency FROM demands WHERE {_SOURCE}) g ON g.id = d.id""",
)
def merge_demands(s: Store) -> DataFrame:
    plan, _ = U.merge_plan(_merges(s), s.demands)
    return U.merge_demands_into(s.demands, plan).select("id", "frequency", "status", "notes")


_MOVED_LINKS = f"""SELECT article_id, CASE WHEN s.id IS NULL THEN demand_id ELSE demand_id + 1 END AS demand_id, relevance_score, s.id IS NOT NULL AS moved
  FROM article_demand_relations l LEFT JOIN (SELECT id FROM demands WHERE {_SOURCE}) s ON s.id = l.demand_id"""


@query(
    "ups05_merge_annotation",
    f"""SELECT article_id, demand_id, relevance_score FROM (SELECT *, row_number() OVER (PARTITION BY article_id, demand_id ORDER BY moved) AS n
        FROM ({_MOVED_LINKS})) WHERE n = 1""",
)
def merge_annotation(s: Store) -> DataFrame:
    plan, _ = U.merge_plan(_merges(s), s.demands)
    return U.merge_links(s.article_demand_relations, plan)


def _chained(s: Store) -> DataFrame:
    """Chains of up to four requests, in and against their order, some closed to a cycle."""
    i = F.col("id")
    target = F.when(i % 10 == 5, i - 4).when(i % 5 != 0, i + 1)
    rows = s.demands.select(i.alias("source"), target.alias("target"), F.lit(None).cast("string").alias("notes"), (i % 3 * 1_000_000_000 + i).alias("ord"))
    return rows.where("target IS NOT NULL")


# Where the links of each demand go, hop by hop; ``path`` holds the requests, last one first.
_WALK = """WITH RECURSIVE req AS (SELECT source, target, ord FROM (SELECT id AS source, CASE WHEN id % 10 = 5 THEN id - 4 WHEN id % 5 <> 0 THEN id + 1 END AS target,
    id % 3 * 1000000000 + id AS ord FROM demands) r WHERE target IN (SELECT id FROM demands)),
  walk AS (SELECT id AS origin, id AS place, CAST(-1 AS BIGINT) AS ord, CAST([] AS BIGINT[]) AS path FROM demands
    UNION ALL SELECT w.origin, r.target, r.ord, list_prepend(r.ord, w.path) FROM walk w JOIN req r ON r.source = w.place AND r.ord > w.ord)"""


@query(
    "ups05_merge_chains",
    f"""SELECT * FROM ({_WALK} SELECT d.id, CAST(d.frequency + coalesce(g.f, 0) AS BIGINT) AS frequency, CASE WHEN r.source IS NULL THEN d.status ELSE 'merged' END AS status,
        CASE WHEN r.source IS NOT NULL THEN concat('Merged into demand #', r.target) END AS notes FROM demands d LEFT JOIN req r ON r.source = d.id
        LEFT JOIN (SELECT w.place, sum(o.frequency) AS f FROM walk w JOIN demands o ON o.id = w.origin WHERE len(w.path) > 0 GROUP BY 1) g ON g.place = d.id)""",
)
def merge_chains(s: Store) -> DataFrame:
    plan, _ = U.merge_plan(_chained(s), s.demands)
    return U.merge_demands_into(s.demands, plan).select("id", "frequency", "status", "notes")


@query(
    "ups05_chained_links",
    f"""SELECT article_id, demand_id, relevance_score FROM ({_WALK}, ends AS (SELECT origin, arg_max(place, len(path)) AS place, arg_max(path, len(path)) AS path FROM walk GROUP BY 1)
        SELECT l.article_id, e.place AS demand_id, l.relevance_score, row_number() OVER (PARTITION BY l.article_id, e.place ORDER BY e.path) AS n
        FROM article_demand_relations l JOIN ends e ON e.origin = l.demand_id) WHERE n = 1""",
)
def chained_links(s: Store) -> DataFrame:
    plan, _ = U.merge_plan(_chained(s), s.demands)
    return U.merge_links(s.article_demand_relations, plan)


@query(
    "joi10_link_conflict",
    f"""SELECT m.article_id, m.demand_id FROM ({_MOVED_LINKS}) m WHERE moved AND NOT EXISTS
        (SELECT 1 FROM article_demand_relations l WHERE l.article_id = m.article_id AND l.demand_id = m.demand_id)""",
)
def link_conflict(s: Store) -> DataFrame:
    """Moved links that do not collide with a link of the target."""
    plan, _ = U.merge_plan(_merges(s), s.demands)
    p = plan.select(F.col("source").alias("demand_id"), "target")
    links = s.article_demand_relations.select("article_id", "demand_id")
    moved = links.join(p, "demand_id").select("article_id", F.col("target").alias("demand_id"))
    return moved.join(links, ["article_id", "demand_id"], "left_anti")


@query(
    "ups06_purge_raw_html",
    """SELECT id, CASE WHEN NOT purged THEN raw_html END AS raw_html, purged FROM (SELECT *, coalesce(crawl_time < (SELECT max(crawl_time) FROM articles) - INTERVAL 20 DAY
       AND raw_html IS NOT NULL, false) AS purged FROM (SELECT id, crawl_time, CASE WHEN id % 4 <> 0 THEN md5(content) END AS raw_html FROM articles))""",
)
def purge_raw_html(s: Store) -> DataFrame:
    rows = s.articles.select("id", "crawl_time", F.when(F.col("id") % 4 != 0, F.md5("content")).alias("raw_html"))
    return U.purge_raw_html(rows, s.articles_as_of, 20).select("id", "raw_html", "purged")


@query(
    "ups07_mark_analyzed",
    """SELECT id, article_id, is_analyzed OR coalesce(article_id IN (SELECT id FROM articles WHERE is_analyzed), false) AS is_analyzed FROM hot_comments""",
)
def mark_analyzed(s: Store) -> DataFrame:
    done = s.articles.where("is_analyzed").select("id")
    return U.mark_analyzed(s.hot_comments, done, "article_id").select("id", "article_id", "is_analyzed")
