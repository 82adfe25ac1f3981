"""Keyword classification into the category tree, in one pass without a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicpulse import dims
from topicpulse.functions import scalars as S
from topicpulse.operators.library import valid_category

Keywords = list[tuple[str, str, list[str]]]


def _hits(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a + text.contains(w).cast("int"), words, F.lit(0))


def classify(title: Column, description: Column, keywords: Keywords | None = None) -> Column:
    """``struct(category, subcategory, score)`` of the first best keyword list.

    A list scores the number of its keywords found in the lower-cased text; on a tie
    the earlier list wins. Categories outside the tree become the fallback but keep
    their subcategory.
    """
    table = dims.KEYWORDS if keywords is None else keywords
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))

    def scored(t: Column) -> Column:
        return F.array(*[_hits(t, words) for _, _, words in table])

    def best(scores: Column) -> Column:
        top = F.array_max(scores)
        place = F.when(top > 0, F.array_position(scores, top).cast("int"))
        names = [F.array(*[F.lit(row[i]) for row in table]) for i in (0, 1)]
        return F.struct(
            valid_category(F.coalesce(F.get(names[0], place - 1), F.lit(dims.FALLBACK_CATEGORY))).alias("category"),
            F.coalesce(F.get(names[1], place - 1), F.lit(dims.FALLBACK_SUBCATEGORY)).alias("subcategory"),
            top.alias("score"),
        )

    return S.bind(S.bind(text, scored), best)


def batch_validate(demands: DataFrame) -> DataFrame:
    """Reclassify rows whose category is not exactly a valid one."""
    ok = F.coalesce(F.col("category").isin(dims.VALID_CATEGORIES), F.lit(False))
    found = demands.withColumn("_c", F.when(~ok, classify(F.col("title"), F.col("description"))))
    return (
        found.withColumn("category", F.coalesce("_c.category", "category"))
        .withColumn("subcategory", F.when(F.col("_c").isNotNull(), F.col("_c.subcategory")).otherwise(F.col("subcategory")))
        .drop("_c")
    )


def taxonomy_lookup(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Examples of each row's category and whether its subcategory belongs there."""
    examples = taxonomy.groupBy("category").agg(
        F.first("examples").alias("examples"), F.count(F.lit(1)).alias("n_subcategories")
    )
    members = taxonomy.select("category", "subcategory", F.lit(True).alias("_in"))
    return (
        rows.join(examples, "category", "left")
        .join(members, ["category", "subcategory"], "left")
        .withColumn("belongs", F.coalesce("_in", F.lit(False)))
        .drop("_in")
    )
