"""Joins between articles, demands, comments, logs and the similarity graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def article_demands(links: DataFrame, demands: DataFrame) -> DataFrame:
    """Demands of every article."""
    d = demands.select(F.col("id").alias("demand_id"), "title", "category", "frequency")
    return links.select("article_id", "demand_id").join(d, "demand_id")


def demand_articles(links: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles of every demand."""
    a = articles.select(F.col("id").alias("article_id"), "title", "platform", "url")
    return links.select("article_id", "demand_id").join(a, "article_id")


def related_demands(edges: DataFrame, demands: DataFrame) -> DataFrame:
    """Neighbours in either direction, once each, that still exist."""
    a, b = F.col("demand_id_a"), F.col("demand_id_b")
    both = F.array(
        F.struct(a.alias("demand_id"), b.alias("related_id")),
        F.struct(b.alias("demand_id"), a.alias("related_id")),
    )
    pairs = edges.select(F.explode(both).alias("p")).select("p.*").distinct()
    names = demands.select(F.col("id").alias("related_id"), F.col("title").alias("related_title"))
    return pairs.join(names, "related_id")


def last_run_per_platform(logs: DataFrame) -> DataFrame:
    """The newest run of each platform; runs tied on the start time all stay."""
    order = W.partitionBy("platform").orderBy(F.desc("start_time"))
    return logs.withColumn("_r", F.rank().over(order)).where("_r = 1").drop("_r")


def skip_known(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored; rows with a NULL key pass."""
    return incoming.join(stored.select(*keys).distinct(), keys, "left_anti")


def series_titles(snapshots: DataFrame, demands: DataFrame) -> DataFrame:
    names = demands.select(F.col("id").alias("demand_id"), "title")
    missing = F.concat(F.lit("Demand #"), F.col("demand_id").cast("string"))
    return snapshots.join(names, "demand_id", "left").withColumn("title", F.coalesce("title", missing))


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct ids on either end of an edge."""
    ends = edges.select(F.explode(F.array("demand_id_a", "demand_id_b")).alias("id"))
    return ends.distinct()


def graph_nodes(edges: DataFrame, demands: DataFrame) -> DataFrame:
    """Demands on at least one edge."""
    return demands.join(endpoints(edges), "id", "left_semi").select(
        "id", F.col("title").alias("label"), "category", "frequency"
    )


def graph_edges(edges: DataFrame) -> DataFrame:
    """All edges, dangling ones too."""
    return edges.select(
        F.col("demand_id_a").alias("from_id"),
        F.col("demand_id_b").alias("to_id"),
        F.col("similarity_score").alias("similarity"),
    )


def graph(edges: DataFrame, demands: DataFrame) -> DataFrame:
    """Nodes and edges in one frame, told apart by ``element``."""
    nodes = graph_nodes(edges, demands).withColumn("element", F.lit("node"))
    links = graph_edges(edges).withColumn("element", F.lit("edge"))
    return nodes.unionByName(links, allowMissingColumns=True)


def disallowed_paths(urls: DataFrame, rules: DataFrame, path: Column) -> DataFrame:
    """Drop urls whose path starts with a non-empty Disallow prefix of their host."""
    r = rules.where(F.col("prefix") != "").select(F.col("host").alias("_host"), F.col("prefix").alias("_prefix"))
    blocked = (F.col("host") == F.col("_host")) & F.startswith(path, F.col("_prefix"))
    return urls.join(r, blocked, "left_anti")


def disallow_rules(robots: DataFrame) -> DataFrame:
    """``(host, prefix)`` of the ``User-agent: *`` blocks of each robots text."""
    lines = robots.select("host", F.split("robots", r"\r\n|\n|\r").alias("lines"))
    folded = F.aggregate(
        "lines",
        F.struct(F.lit(False).alias("star"), F.array().cast("array<string>").alias("out")),
        _fold_robots_line,
        lambda s: s["out"],
    )
    return lines.select("host", F.explode(folded).alias("prefix")).where("prefix <> ''")


def _fold_robots_line(state: Column, line: Column) -> Column:
    text = F.trim(line)
    low = F.lower(text)
    value = F.trim(F.regexp_replace(text, "^[^:]*:", ""))
    is_agent = low.startswith("user-agent:")
    is_rule = state["star"] & low.startswith("disallow:")
    return F.struct(
        F.when(is_agent, value == "*").otherwise(state["star"]).alias("star"),
        F.when(~is_agent & is_rule, F.concat(state["out"], F.array(value)))
        .otherwise(state["out"])
        .alias("out"),
    )


def article_comments(articles: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments of the given articles that were not analysed yet."""
    ids = articles.select(F.col("id").alias("article_id"))
    return comments.where(~F.col("is_analyzed")).join(ids, "article_id", "left_semi")


def comment_digest(comments: DataFrame) -> DataFrame:
    """``(article_id, n_comments, comments)``: the lines of an article joined into one text, in id order."""
    name = F.coalesce(F.nullif("commenter", F.lit("")), F.lit("匿名"))
    line = F.concat(
        F.lit("["), name, F.lit("] (👍"), F.col("like_count").cast("string"), F.lit("): "), F.col("content")
    )
    # The result is one value per article, so its lines have to meet; nothing but them is carried.
    return (
        comments.select("article_id", "id", line.alias("line"))
        .groupBy("article_id")
        .agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("lines"))
        .select(
            "article_id",
            F.size("lines").cast("bigint").alias("n_comments"),
            F.array_join("lines.line", "\n").alias("comments"),
        )
    )


def orphans(child: DataFrame, key: str, parent: DataFrame, label: str) -> DataFrame:
    """Child rows whose parent id is gone."""
    gone = child.join(parent.select(F.col("id").alias(key)), key, "left_anti")
    return gone.select(F.lit(label).alias("child"), F.col(key).alias("missing_id"))
