"""Row numbers and running totals over whole tables in many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.scratch import checked, materialize


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` dealt by ranges of the order, with __range, as a written table: ranges stay fixed if an executor is lost."""
    return materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranks")


def _starts(totals: DataFrame) -> DataFrame:
    """(__range, __start): the sum of __total over the ranges before; only one row per range meets in one task."""
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))


def numbered(df: DataFrame, order: list[Column], into: str) -> DataFrame:
    """Add ``into``: the row's number from 1 in the order of ``order``, which has to tell rows apart.

    Each range of the order numbers its own rows and adds the count of those before it.
    """
    rows = _ranged(df, order)
    starts = _starts(rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__total")))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return rows.withColumn(into, own).join(checked(starts), "__range").withColumn(into, (F.col(into) + F.col("__start")).cast("bigint")).drop("__range", "__start")


def running_total(df: DataFrame, order: list[Column], value: str, into: str) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the earlier rows in the order of ``order``, which has to tell rows apart."""
    rows = _ranged(df, order)
    starts = _starts(rows.groupBy("__range").agg(F.sum(value).alias("__total")))
    own = F.sum(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(into, F.coalesce(own, F.lit(0))).join(checked(starts), "__range").withColumn(into, F.col(into) + F.col("__start")).drop("__range", "__start")
