"""Order statistics, ranks and curves as aggregate expressions and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.rank import running_total

INF = float("inf")


def conformal_rank(n: Column, alpha: float) -> Column:
    return F.ceil((1 - F.lit(alpha)) * (n + 1))


def conformal_quantiles(scores: DataFrame, keys: list[str], value: str, alpha: float, into: str) -> DataFrame:
    """Per key the ceil((1-alpha)(n+1))-th smallest value, infinite if that rank is above n; exact, by row numbers."""
    w = Window.partitionBy(*keys)
    ranked = scores.filter(F.col(value).isNotNull()).withColumns({"__r": F.row_number().over(w.orderBy(value)), "__n": F.count(F.lit(1)).over(w)})
    hit = F.min(F.when(F.col("__r") == conformal_rank(F.col("__n"), alpha), F.col(value)))
    return ranked.groupBy(*keys).agg(F.coalesce(hit, F.lit(INF)).alias(into), F.count(F.lit(1)).alias("m"))


def auroc(rows: DataFrame, positive: str, score: str) -> DataFrame:
    """One row, auroc: the rank sum with mid-ranks for ties; null unless both classes occur.

    Ties come from counts per distinct score and ranks from running totals over ranges of the scores.
    """
    per = rows.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(positive).cast("bigint")).alias("p"))
    ranked = running_total(per, [F.col(score)], "n", "before").withColumn("mid", F.col("before") + (F.col("n") + 1) / 2.0)
    total = ranked.agg(F.sum(F.col("p") * F.col("mid")).alias("s"), F.sum("p").cast("double").alias("pos"), F.sum(F.col("n") - F.col("p")).cast("double").alias("neg"))
    return total.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), (F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))).alias("auroc"))


def curve_reach(curve: DataFrame, order: str, budget: str, value: str, target: float) -> DataFrame:
    """One row, budget at which the curve first crosses the target, linear between points; null if it never does."""
    w = Window.orderBy(order)
    pair = curve.select(order, F.col(budget).alias("b0"), F.col(value).alias("v0"), F.lead(budget).over(w).alias("b1"), F.lead(value).over(w).alias("v1"))
    slope = F.when(F.col("v0").isNotNull() & (F.col("v0") != F.col("v1")), (F.lit(target) - F.col("v0")) / F.nullif(F.col("v1") - F.col("v0"), F.lit(0.0))).otherwise(1.0)
    at = F.when(F.col("v0") >= target, F.col("b0")).when(F.col("v1") >= target, F.col("b0") + slope * (F.col("b1") - F.col("b0")))
    return pair.filter(F.col("b1").isNotNull()).select(order, at.alias("at")).filter("at is not null").agg(F.min_by("at", order).alias("budget"))


def curve_at(curve: DataFrame, budget: str, value: str, at: float) -> DataFrame:
    """One row, the curve's value at a budget, linear between points and flat beyond its ends."""
    left = F.max(F.when(F.col(budget) <= at, F.struct(budget, value)))
    right = F.min(F.when(F.col(budget) >= at, F.struct(budget, value)))
    ends = curve.agg(left.alias("l"), right.alias("r"))
    span = F.col("r")[budget] - F.col("l")[budget]
    between = F.col("l")[value] + (F.lit(at) - F.col("l")[budget]) / F.nullif(span, F.lit(0.0)) * (F.col("r")[value] - F.col("l")[value])
    return ends.select(F.when(F.col("l").isNull(), F.col("r")[value]).when(F.col("r").isNull() | (span == 0), F.col("l")[value]).otherwise(between).alias("value"))
