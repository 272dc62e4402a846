"""Conformal radii, diagnostics and the scale of a view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import vectors as V
from driftline.functions.rank import numbered
from driftline.functions.stats import INF, conformal_quantiles, conformal_rank


def region_radii(pairs: DataFrame, regions: DataFrame, alpha: float) -> DataFrame:
    """(region, eps, gamma, dbar, m) from (region, qvec, mapped, exact): the distance and the vector radius.

    Regions without pairs have infinite radii, no mean distance and m = 0.
    """
    scored = pairs.withColumn("d_star", V.l2(F.col("qvec"), F.col("exact"))).withColumn("err", F.round(F.abs(V.l2(F.col("qvec"), F.col("mapped")) - F.col("d_star")), 6)).withColumn("off", V.l2(F.col("mapped"), F.col("exact")))
    eps = conformal_quantiles(scored, ["region"], "err", alpha, "eps").select("region", "eps", "m")
    gamma = conformal_quantiles(scored, ["region"], "off", alpha, "gamma").select("region", "gamma")
    mean = scored.groupBy("region").agg(F.avg("d_star").alias("dbar"))
    out = regions.select("region").join(eps, "region", "left").join(gamma, "region", "left").join(mean, "region", "left")
    return out.select("region", F.coalesce("eps", F.lit(INF)).alias("eps"), F.coalesce("gamma", F.lit(INF)).alias("gamma"), F.round("dbar", 12).alias("dbar"), F.coalesce("m", F.lit(0)).alias("m"))


def width_diagnostic(radii: DataFrame, tau: float) -> DataFrame:
    """One row: the median relative width over regions, and whether a full re-embedding is recommended."""
    width = F.when(F.col("m") > 0, F.col("eps") / F.col("dbar")).otherwise(INF)
    return radii.agg(F.round(F.median(width), 6).alias("median_relative_width")).withColumn("recommend_full_reembed", F.col("median_relative_width") > tau)


def query_scores(candidates: DataFrame) -> DataFrame:
    """(qid, score): the largest normalized error over a query's bridged candidates, 0 without any."""
    err = F.when(~F.col("exact"), V.normalized_error(F.col("d"), F.col("d_star"), F.col("eps")))
    return candidates.groupBy("qid").agg(F.coalesce(F.max(err), F.lit(0.0)).alias("score"))


def view_scale(scores: DataFrame, alpha: float) -> DataFrame:
    """One row, lam: the conformal quantile of the scores (qid, score); infinite without queries. Scores are ranked by
    ranges, so no task holds them all."""
    ranked = numbered(scores.filter(F.col("score").isNotNull()), [F.col("score"), F.col("qid")], "__r")
    n = ranked.agg(F.count(F.lit(1)).alias("m"))
    hit = F.max(F.when(F.col("__r") == conformal_rank(F.col("m"), alpha), F.col("score")))
    return ranked.join(F.broadcast(n)).agg(F.coalesce(hit, F.lit(INF)).alias("lam"), F.count(F.lit(1)).alias("m"))
