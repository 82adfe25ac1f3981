"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse.session import new_folder


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, root): every id of an edge with the smallest id of its component.

    Alternates two steps until nothing changes: large stars hang the larger neighbours of a
    node on its smallest one, small stars do so with the smaller neighbours and the node
    itself. Paths shorten by halves, so the number of rounds grows with the logarithm of the
    longest; there is no limit on it. A node's smallest neighbour is found by an aggregate
    and joined back, so no node's neighbours meet in one task. Two folders are written in
    turn, so that only the last two rounds take space. Null ids take no part.
    """
    spark = edges.sparkSession
    folder = new_folder(spark, "components")
    turn = 0

    def keep(df: DataFrame) -> DataFrame:
        nonlocal turn
        turn += 1
        path = f"{folder}/{turn % 2}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    kind = edges.schema[left].dataType
    u, v = F.col(left).cast(kind), F.col(right).cast(kind)
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    now = keep(now.filter(u.isNotNull() & v.isNotNull()).distinct())
    ids = new_folder(spark, "component-ids")
    now.select(F.explode(F.array("u", "v")).alias("id")).distinct().write.parquet(ids)
    now = keep(now.filter("u <> v"))
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = keep(hung.distinct())
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        hung = now.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = keep(hung.union(least).distinct())
    known = spark.read.schema(f"id {kind.simpleString()}").parquet(ids)
    # Settled, every node that is not a root has one edge, to its root.
    return known.join(now, known["id"] == now["u"], "left").select("id", F.coalesce("v", "id").alias("root"))
