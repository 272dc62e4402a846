"""Heat, priorities, batches, budgets and leases of re-embedding work."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import vectors as V
from driftline.functions.rank import numbered

LEGACY, BRIDGED, RESOLVING, NATIVE = 0, 1, 2, 3
#: Work categories, most urgent first.
CATEGORIES = ("resolution", "calibration", "calibration_query", "scheduled")


def heat(hits: DataFrame, half_life: float, now: int | None = None) -> DataFrame:
    """(item_id, heat) from (item_id, seq): each hit decays with the requests since, up to ``now`` (by default the last
    request); one sum, no recursion."""
    last = hits.agg((F.max("seq") if now is None else F.lit(now)).alias("__now"))
    return hits.join(F.broadcast(last)).groupBy("item_id").agg(F.sum(V.decay(F.col("__now") - F.col("seq"), half_life)).alias("heat"))


def warm_heat(candidates: DataFrame, half_life: float) -> DataFrame:
    """(item_id, heat) from the candidate lists (seq, items) of warm-up requests, which have no key."""
    return heat(candidates.select("seq", F.explode("items").alias("item_id")), half_life)


def in_degree(edges: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, deg): edges into each item, zeros kept."""
    counted = edges.groupBy(F.col("dst").alias("item_id")).agg(F.count(F.lit(1)).alias("deg"))
    return items.select("item_id").join(counted, "item_id", "left").select("item_id", F.coalesce("deg", F.lit(0)).alias("deg"))


def priority(order: str) -> Column:
    """The priority of a row (heat, eps, deg, noise) under an order; an infinite radius never revives a cold item."""
    if order == "utility":
        return F.when((F.col("heat") == 0) | (F.col("deg") == 0), 0.0).otherwise(F.col("heat") * F.col("eps") * F.col("deg"))
    return {"heat": F.col("heat"), "radius": F.col("eps"), "random": F.col("noise")}[order]


def pick(items: DataFrame, count: int, order: str = "utility") -> DataFrame:
    """(item_id, region, pos): the most urgent claimable items, then grouped by region in the order of urgency."""
    ready = items.filter(F.col("state").isin(LEGACY, BRIDGED) & ~F.col("deleted")).withColumn("p", priority(order))
    top = ready.orderBy(F.desc("p"), F.desc("eps"), "item_id").limit(count)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("p"), F.desc("eps"), "item_id")))
    return ranked.withColumn("pos", F.row_number().over(Window.orderBy("region", "rank"))).select("item_id", "region", "pos")


def region_batches(queue: DataFrame, size: int) -> DataFrame:
    """(category, region, item_id, batch) from (seq, category, region, item_id): batches never mix regions; they are
    taken by category, then by the first arrival of the region, then in order of arrival."""
    at = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    own = Window.partitionBy("category", "region")
    q = queue.withColumns({"prio": at, "first": F.min("seq").over(own), "k": F.floor((F.row_number().over(own.orderBy("seq")) - 1) / size)})
    batches = numbered(q.select("prio", "first", "region", "k").distinct(), [F.col("prio"), F.col("first"), F.col("region"), F.col("k")], "batch")
    return q.join(batches, ["prio", "first", "region", "k"]).select("category", "region", "item_id", "batch")


def token_bucket(asks: DataFrame, capacity: float, per_hour: float, price: float) -> DataFrame:
    """(key, seq, granted, tokens) from (key, seq, t, gpu_seconds): a bucket in dollars that refills up to its capacity
    and refuses what costs more than it holds. Requests stream past in order; a task keeps one balance at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = tokens = before = None
        for frame in frames:
            granted, left = [], []
            for k, t, cost in zip(frame.key.tolist(), frame.t.tolist(), (frame.gpu_seconds * (price / 3600)).tolist(), strict=True):
                if k != key:
                    key, tokens, before = k, float(capacity), t
                tokens = min(float(capacity), tokens + (t - before) * (per_hour / 3600))
                before = t
                granted.append(cost <= tokens)
                tokens -= cost if granted[-1] else 0.0
                left.append(round(tokens, 6))
            yield pd.DataFrame({"key": frame.key, "seq": frame.seq, "granted": granted, "tokens": left})

    ordered = asks.select("key", "seq", "t", "gpu_seconds").repartition("key").sortWithinPartitions("key", "seq")
    return ordered.mapInPandas(run, f"key {dict(asks.dtypes)['key']}, seq bigint, granted boolean, tokens double")


def publish(writes: DataFrame, leases: DataFrame, now: float) -> DataFrame:
    """``writes`` (item_id, fence, ...) with accepted: the lease has the same fence and has not expired."""
    held = leases.select("item_id", F.col("fence").alias("__fence"), "expires")
    return writes.join(held, "item_id", "left").withColumn("accepted", F.coalesce((F.col("fence") == F.col("__fence")) & (F.col("expires") >= now), F.lit(False))).drop("__fence", "expires")


def reap(items: DataFrame, leases: DataFrame, now: float) -> DataFrame:
    """(item_id, state) after expired leases are taken back: bridged where the item's segment was rotated, else legacy."""
    late = leases.filter(F.col("expires") < now).select("item_id", F.lit(True).alias("__late"))
    back = F.when(F.col("rotated"), BRIDGED).otherwise(LEGACY)
    return items.join(late, "item_id", "left").select("item_id", F.when((F.col("state") == RESOLVING) & F.col("__late"), back).otherwise(F.col("state")).alias("state"))


def epoch_due(items: DataFrame, changed: int, edges: int, share: float = 0.02) -> DataFrame:
    """One row: counts by state and whether flips or edge changes have reached their share."""
    live = F.count_if(~F.col("deleted"))
    native = F.count_if((F.col("state") == NATIVE) & ~F.col("deleted"))
    flips = F.count_if(F.col("flipped"))
    return items.agg(F.count(F.lit(1)).alias("n"), native.alias("native"), (native / live).alias("native_fraction"), (native == live).alias("all_native"), ((flips >= F.lit(share) * F.count(F.lit(1))) | F.lit(changed >= share * edges)).alias("due"))


def publish_batch(items: DataFrame, writes: DataFrame, leases: DataFrame, dependants: DataFrame, now: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a batch of publications does: the items after it, the audits it asks for, and its counts.

    ``writes`` (item_id, fence, category) land where their lease holds; each landed item and the nodes whose verdicts
    waited for it (dependants: item_id, node) are to be audited; flips for calibration don't count towards an epoch.
    """
    judged = publish(writes, leases, now)
    landed = judged.filter("accepted").select("item_id", "category").dropDuplicates(["item_id"])
    flips = F.col("category").isNotNull() & ~F.col("category").isin(*[c for c in CATEGORIES if c.startswith("calibration")])
    after = items.join(landed, "item_id", "left").withColumns({"state": F.when(F.col("category").isNotNull(), NATIVE).otherwise(F.col("state")), "flipped": F.col("flipped") | flips}).drop("category")
    audits = landed.select(F.col("item_id").alias("node")).unionByName(dependants.join(landed.select("item_id"), "item_id", "left_semi").select("node")).distinct()
    counts = judged.agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("stale"))
    return after, audits, counts


def audit_batches(queue: DataFrame, size: int = 64) -> DataFrame:
    """(node, batch) from (node, seq): audits in the order of their first request, ``size`` to a batch."""
    first = queue.groupBy("node").agg(F.min("seq").alias("seq"))
    return numbered(first, [F.col("seq"), F.col("node")], "__n").select("node", F.floor((F.col("__n") - 1) / size).alias("batch"))


def route_audits(verdicts: DataFrame, leases: DataFrame) -> DataFrame:
    """(src, dst, waits_for) from (src, dst, verdict): pending pairs wait for the end that a lease still promises, and
    those without one are left to the audit at the end of the migration (waits_for null)."""
    pending = verdicts.filter("verdict like 'pending%'")
    held = leases.select(F.col("item_id").alias("dst"), F.col("item_id").alias("waits_for")).distinct()
    return pending.select("src", "dst").join(held, "dst", "left").select("src", "dst", "waits_for")


def plan_steps(items: DataFrame, asks: DataFrame, per_step: int, order: str = "utility") -> DataFrame:
    """(step, item_id, region, pos): all claimable items in the order of the scheduler, ``per_step`` to a step, for as
    many steps as the token bucket granted (asks: step, granted); within a step regions stay together."""
    ready = items.filter(F.col("state").isin(LEGACY, BRIDGED) & ~F.col("deleted")).withColumn("p", priority(order))
    ranked = numbered(ready.select("item_id", "region", "p", "eps"), [F.desc("p"), F.desc("eps"), F.col("item_id")], "rank").withColumn("turn", F.floor((F.col("rank") - 1) / per_step))
    granted = numbered(asks.filter("granted").select("step"), [F.col("step")], "turn").withColumn("turn", F.col("turn") - 1)
    taken = ranked.join(granted, "turn")
    return taken.withColumn("pos", F.row_number().over(Window.partitionBy("step").orderBy("region", "rank"))).select("step", "item_id", "region", "pos")
