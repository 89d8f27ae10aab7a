"""Places in an order, without one task ever holding a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def by_range(df: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows cut into ranges of equal size along (group, order), the range in ``_part``.

    The cut is written out: it is sampled, and every reader has to see the same one."""
    n = df.sparkSession.sparkContext.defaultParallelism
    cut = df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id())
    return stage(cut, "ranges")


def starts(parts: DataFrame, group: Sequence[str], amount: Column, out: str) -> DataFrame:
    """(group…, _part, out): what the ranges before this one add up to in the group. One row per
    group and range, so the window sees as many rows as there are ranges."""
    before = Window.partitionBy(*group, F.lit(0)).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    return parts.groupBy(*group, "_part").agg(amount.alias("_amount")).select(
        *group, "_part", F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias(out))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
             out: str) -> DataFrame:
    """row_number() of each row in its group, 1-based."""
    parts = by_range(df, group, order)
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    return (parts.withColumn("_i", F.row_number().over(inside))
            .join(starts(parts, group, F.count("*"), "_start"), [*group, "_part"])
            .withColumn(out, (F.col("_start") + F.col("_i")).cast("int"))
            .drop("_part", "_i", "_start"))
