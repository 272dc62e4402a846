"""Samples and request streams; every random choice is an order by a hash, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.rank import numbered, running_total


def shuffled(key: Column, seed: int) -> Column:
    """A pseudorandom number in [0, 1) that both SQL engines compute alike."""
    return ((key.cast("bigint") * 7919 + seed * 104729) % 1009) / 1009.0


def stratified_split(items: DataFrame, per_region: int, fit: int, seed: int) -> DataFrame:
    """(item_id, region, part): up to ``per_region`` items of each region, the rounded share of them for fitting."""
    w = Window.partitionBy("region")
    taken = items.withColumn("r", F.row_number().over(w.orderBy(shuffled(F.col("item_id"), seed), "item_id"))).filter(F.col("r") <= per_region)
    cut = F.bround(F.count(F.lit(1)).over(w) * F.lit(fit / per_region))
    return taken.withColumn("part", F.when(F.col("r") <= cut, "fit").otherwise("cal")).select("item_id", "region", "part")


def zipf_stream(queries: int, draws: DataFrame, exponent: float, seed: int) -> DataFrame:
    """(seq, rank) from (seq): ranks with probability 1/rank^s, by inverting the cumulative weights.

    Weights are summed by ranges, and each draw meets the ranks that reach into its part of the unit interval, of
    which there are as many parts as ranks; neither side is held by one task.
    """
    spark = draws.sparkSession
    ranks = spark.range(1, queries + 1).select(F.col("id").alias("rank"), (1 / F.pow(F.col("id").cast("double"), F.lit(exponent))).alias("w"))
    summed = running_total(ranks, [F.col("rank")], "w", "before")
    total = summed.agg(F.sum("w").alias("total"))
    edges = summed.join(F.broadcast(total)).select("rank", F.round(F.col("before") / F.col("total"), 9).alias("low"), F.round((F.col("before") + F.col("w")) / F.col("total"), 9).alias("high"))
    part = lambda x: F.floor(x * queries).cast("bigint")
    spans = edges.withColumn("part", F.explode(F.sequence(part(F.col("low") - 2e-9), part(F.col("high")))))
    drawn = draws.select("seq", shuffled(F.col("seq"), seed).alias("u")).withColumn("part", part(F.col("u")))
    return drawn.join(spans, "part").filter("high > u AND low <= u + 2e-9").groupBy("seq").agg(F.min("rank").alias("rank"))


def workload(kind: str, truth: DataFrame, regions: DataFrame, heat: DataFrame, queries: DataFrame, size: int, seed: int) -> DataFrame:
    """(seq, qid): ``size`` requests of a kind over ``queries`` (qid): zipf (skewed), uniform (each in a hashed order,
    beginning anew at the end), or cold (those whose true neighbours all lie in the coldest regions)."""
    some = queries.select("qid")
    if kind == "cold":
        some = cold_queries(truth.join(regions, "item_id"), heat, heat.count())
    order = numbered(some, [shuffled(F.col("qid"), seed), F.col("qid")], "rank")
    seqs = queries.sparkSession.range(size).select(F.col("id").alias("seq"))
    n = order.count()
    if not n:
        return seqs.select("seq", F.lit(None).cast("bigint").alias("qid")).limit(0)
    drawn = zipf_stream(n, seqs, 1.0, seed) if kind == "zipf" else seqs.withColumn("rank", F.col("seq") % n + 1)
    return drawn.join(order, "rank").select("seq", "qid")


def cold_queries(truth: DataFrame, heat: DataFrame, regions: int) -> DataFrame:
    """(qid): queries all of whose true neighbours lie in the coldest tenth of regions; truth (qid, region)."""
    coldest = heat.orderBy("heat", "region").limit(max(1, regions // 10)).select("region", F.lit(True).alias("cold"))
    marked = truth.join(coldest, "region", "left")
    return marked.groupBy("qid").agg(F.bool_and(F.coalesce("cold", F.lit(False))).alias("cold")).filter("cold").select("qid")


def rare_entities(items: DataFrame, title: str) -> DataFrame:
    """(title, n) of the titles whose count is at most the lower decile of the counts."""
    counts = items.groupBy(F.col(title).alias("title")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    upto = ranked.withColumns({"upto": F.sum("k").over(Window.orderBy("n")), "all": F.sum("k").over(Window.partitionBy())})
    cut = upto.filter(F.col("upto") > F.floor(0.1 * (F.col("all") - 1))).agg(F.min("n").alias("cut"))
    return counts.join(F.broadcast(cut), F.col("n") <= F.col("cut")).select("title", "n")


def backfill_order(items: DataFrame, done: DataFrame) -> DataFrame:
    """(item_id, pos): the items not yet done by priority, then id."""
    rest = items.join(done.select("item_id"), "item_id", "left_anti")
    return numbered(rest, [F.desc("priority"), F.col("item_id")], "pos").select("item_id", "pos")


def recent_window(requests: DataFrame, size: int) -> DataFrame:
    """(key, seq): of the last ``size`` requests the latest of each key."""
    last = requests.orderBy(F.desc("seq")).limit(size)
    return last.groupBy("key").agg(F.max("seq").alias("seq"))


def probe_window(stream: DataFrame, at: int, size: int) -> DataFrame:
    """(j, query): ``size`` requests of the stream (pos, query) from position ``at`` on, beginning anew at its end."""
    spark = stream.sparkSession
    n = stream.agg(F.count(F.lit(1)).alias("n"))
    wanted = spark.range(size).select(F.col("id").alias("j")).join(F.broadcast(n)).withColumn("pos", (F.col("j") + at) % F.col("n"))
    return wanted.join(stream, "pos").select("j", "query")


def region_heat(items: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, heat): the heat of each region's items (region, heat); regions without items have 0."""
    summed = items.groupBy("region").agg(F.sum("heat").alias("heat"))
    return regions.select("region").join(summed, "region", "left").select("region", F.coalesce("heat", F.lit(0)).alias("heat"))


def cold_regions(heat: DataFrame, share: float = 0.1) -> DataFrame:
    """(region, heat): the coldest ``share`` of the regions, at least one; ties go to the smaller region."""
    ranked = numbered(heat, [F.col("heat"), F.col("region")], "__r")
    n = heat.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(share))).alias("__n"))
    return ranked.join(F.broadcast(n)).filter("__r <= __n").select("region", "heat")


def last_by_key(rows: DataFrame) -> DataFrame:
    """(key, first, value) from (key, seq, value): each key's last value and the place where it first came."""
    return rows.groupBy("key").agg(F.min("seq").alias("first"), F.max_by("value", "seq").alias("value"))


def calibration_sample(requests: DataFrame, seen: DataFrame, most: int, seed: int) -> DataFrame:
    """(key): up to ``most`` distinct keys of the requests that ``seen`` lacks, in a pseudorandom order by a hash."""
    fresh = requests.select("key").distinct().join(seen.select("key").distinct(), "key", "left_anti")
    return fresh.orderBy(shuffled(F.col("key"), seed), "key").limit(most)


def nearest_titles(nearest: DataFrame, titles: DataFrame, rare: DataFrame) -> DataFrame:
    """(qid, title): queries whose nearest item (qid, item_id) bears one of the rare titles."""
    return nearest.join(titles, "item_id").join(rare.select("title"), "title", "left_semi").select("qid", "title")
