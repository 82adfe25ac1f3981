"""Running values over ordered rows, spread over ranges instead of one task per key.

Rows are sorted into ranges of about equal size. A range works on its own rows; what it
hands on to the next ones is one small row per key. So a key that owns most rows is worked
on by as many tasks as it fills ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicpulse.session import saved


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with the number ``_part`` of their range in ``order``, ascending, NULLs first.

    ``order`` should name a row, else equal rows stay together. The rows are written once:
    both reads of a running value must see the same ranges.
    """
    cut = rows.repartitionByRange(*[F.asc_nulls_first(c) for c in order])
    return saved(cut.withColumn("_part", F.spark_partition_id()), "ranges")


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the same keys up to this one.

    NULL keys form a key of their own, NULL values count as zero, and rows equal in ``order`` come in any order.
    """
    cut = in_ranges(rows.withColumn("_v", F.coalesce(value, F.lit(0))), [*keys, *order])
    inside = W.partitionBy("_part", *keys).orderBy(*[F.asc_nulls_first(c) for c in order])
    local = cut.withColumn("_s", F.sum("_v").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # One row per key and range.
    parts = cut.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p")).agg(F.sum("_v").alias("_t"))
    before = W.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_c", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(parts, same).withColumn(name, F.col("_s") + F.col("_c")).select(*rows.columns, name)
