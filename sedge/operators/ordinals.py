"""Global ordinals and exact ranks without gathering all rows in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import cut


def with_ordinal(rows: DataFrame, name: str, *order: str | Column, start: int = 0) -> DataFrame:
    """rows with their place in a total order: sorted by ranges, numbered inside each, then shifted by the ranges before.

    Only one count per range is summed up in order; the sorted rows are written once, so that both passes see the same
    ranges.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shifts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", inside).join(F.broadcast(shifts), "_range").withColumn(name, F.col("_place") + F.col("_shift") + start).drop("_range", "_place", "_shift")


def running_sum(rows: DataFrame, name: str, amount: str | Column, groups: list[str], *order: str | Column) -> DataFrame:
    """rows with name: the sum of amount over the rows before it in its group (null groups are one).

    Rows are sorted by ranges of group and order, so that one large group is spread over many tasks. Sums inside a range are
    shifted by what the ranges before hold of the same group. A range continues one group at most, which bounds the shifts
    by the number of ranges.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(rows.repartitionByRange(parts, *groups, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range", *groups).agg(F.sum(amount).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.withColumn("_shift", F.sum("_n").over(earlier)).where("_shift IS NOT NULL")
    named = shifts.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], "_shift")
    same = F.col("_range") == F.col("_r")
    for k, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    inside = F.sum(amount).over(Window.partitionBy("_range", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    met = ranged.withColumn("_inside", inside).join(F.broadcast(named), same, "left")
    return met.withColumn(name, F.coalesce("_inside", F.lit(0)) + F.coalesce("_shift", F.lit(0))).drop("_range", "_inside", *named.columns)


def numbered(rows: DataFrame, name: str, groups: list[str], *order: str | Column) -> DataFrame:
    """rows with name: their place in their group, from 1."""
    return running_sum(rows, name, F.lit(1), groups, *order).withColumn(name, F.col(name) + 1)


def lower_ranks(rows: DataFrame, column: str, quantiles: list[float]) -> DataFrame:
    """q and value: the value at floor((n - 1) * q) of the sorted column, exactly.

    Equal values are counted before anything is sorted; the value wanted is the last one whose smaller values are no more
    than its rank.
    """
    counts = cut(rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_count")))
    n = counts.agg(F.sum("_count")).first()[0] or 0
    ranked = running_sum(counts, "_smaller", "_count", [], column)
    found = [F.struct(F.lit(q).alias("q"), F.max(F.when(F.col("_smaller") <= math.floor((n - 1) * q), F.col(column))).alias("value")) for q in quantiles]
    return ranked.agg(F.array(*found).alias("_found")).where(F.lit(n > 0)).select(F.inline("_found"))


def running_cap(rows: DataFrame, amount: str, cap: int, *order: str) -> DataFrame:
    """rows with `granted`: their amount in order as long as the total stays within the cap; the last one gets the rest, others are left out.

    Totals before each range of rows come from one number per range, so that the running sum is not one task's work.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum(amount).alias("_n"))
    shifts = sums.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.col("_inside") + F.col("_shift")
    found = ranged.withColumn("_inside", inside).join(F.broadcast(shifts), "_range").where(before < cap)
    return found.withColumn("granted", F.least(F.col(amount), F.lit(cap) - before)).drop("_range", "_inside", "_shift")
