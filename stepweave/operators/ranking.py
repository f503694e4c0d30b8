"""Ranks over groups that may be far larger than one task can hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.runtime import cut, shuffle_partitions


def distributed_row_number(df: DataFrame, part: Sequence[str], order: Sequence[Column], out: str, partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by part order by order)`` without a task for a whole group.

    Rows are range-partitioned by ``part`` and ``order``, so a hot group lies in many partitions. Each partition counts its rows of each group; the running sums of these counts (one row for each pair of partition and group) are added to the row numbers inside the partitions. ``order`` should end in a unique key: rows that are equal in ``part`` and ``order`` stay in one partition and get an arbitrary order. Rows whose ``part`` holds a null are left out; give them a value first if they count as a group.
    """
    spark = df.sparkSession
    df = df.dropna(subset=list(part))
    spread = df.repartitionByRange(partitions or shuffle_partitions(spark), *part, *order)
    spread = cut(spread.withColumn("__at", F.spark_partition_id()))
    counts = spread.groupBy("__at", *part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*part).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__at", *part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__at", *part).orderBy(*order)
    ranked = spread.join(offsets, ["__at", *part]).withColumn(out, F.row_number().over(inside) + F.col("__before"))
    return ranked.select(*df.columns, out)


def distributed_running_sum(df: DataFrame, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before each in ``order`` (which should end in a unique key), without a task for all rows: sums inside range partitions, and one row a partition for what comes before it."""
    spread = cut(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("__at", F.spark_partition_id()))
    before = Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("__at").agg(F.sum(value).alias("__n")).select("__at", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__at").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return spread.join(offsets, "__at").withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("__before")).select(*df.columns, out)
