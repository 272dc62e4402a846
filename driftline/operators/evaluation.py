"""Metrics of request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.rank import numbered
from driftline.functions.stats import auroc

SLACK = 1e-12


def summarize(log: DataFrame) -> DataFrame:
    """One row of means and percentiles over a request log; certificate metrics use the rows with a bound.

    auroc_bound ranks certified requests by their bound against a recall below one, auroc_confidence all requests by
    their confidence; both are null unless both classes occur, or where the log has no such column.
    """
    cert = F.col("bound").isNotNull()
    mean = lambda c: F.round(F.avg(F.when(cert, c.cast("double"))), 6)
    cpu = F.avg(F.when(F.col("cpu") > 0, F.col("cpu")))
    wrong = F.col("recall") < 1 - SLACK
    ranks = [auroc(log.filter(F.col(c).isNotNull()).select(wrong.alias("p"), (-F.col(c)).alias("s")), "p", "s").select(F.round("auroc", 6).alias(f"auroc_{c}")) for c in ("bound", "confidence") if c in log.columns]
    out = log.agg(
        F.count(F.lit(1)).alias("requests"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg((F.col("requested") > 0).cast("double")), 6).alias("resolution_rate"),
        F.round(F.avg(((F.col("resolved") > 0) | (F.col("waited") > 0)).cast("double")), 6).alias("wait_rate"),
        F.round(F.percentile(F.col("latency") * 1000, 0.5), 6).alias("p50_ms"), F.round(F.percentile(F.col("latency") * 1000, 0.99), 6).alias("p99_ms"), F.round(1 / cpu, 6).alias("qps_per_core"),
        mean(F.col("bound")).alias("mean_bound"), mean(F.col("examined_recall") < F.col("bound") - SLACK).alias("m1"), mean(F.col("recall") < F.col("bound") - SLACK).alias("m2"), mean(F.col("bound") >= 1).alias("fully_certified"),
        F.round(F.avg(F.when(cert, F.col("recall"))) - F.avg("bound"), 6).alias("gap"), mean(F.col("score") > F.col("lam")).alias("miss"), mean(F.col("capture")).alias("capture"),
    )
    for r in ranks:
        out = out.join(F.broadcast(r))
    return out


def phases(log: DataFrame) -> DataFrame:
    """One row: mean recall by phase of a migration (phase, recall), and what of the distance between the start and the
    end each phase has closed."""
    mean = {p: F.avg(F.when(F.col("phase") == p, F.col("recall"))) for p in ("seed_off", "seed_res", "f25", "native")}
    out = log.agg(*[F.round(m, 6).alias(p) for p, m in mean.items()])
    span = F.nullif(F.col("native") - F.col("seed_off"), F.lit(0.0))
    return out.withColumn("closed_res", F.round((F.col("seed_res") - F.col("seed_off")) / span, 6)).withColumn("closed_f25", F.round((F.col("f25") - F.col("seed_off")) / span, 6))


def by_group(log: DataFrame, key: str) -> DataFrame:
    """Certificate metrics for each value of ``key`` (workload, variant or scheduler): requests, recall, mean bound,
    share of bounds above the recall over examined and over all items, gap and fully certified share."""
    mean = lambda c: F.round(F.avg(F.when(F.col("bound").isNotNull(), c.cast("double"))), 6)
    return log.groupBy(key).agg(
        F.count(F.lit(1)).alias("requests"), F.round(F.avg("recall"), 6).alias("recall"), mean(F.col("bound")).alias("mean_bound"), mean(F.col("examined_recall") < F.col("bound") - SLACK).alias("m1"),
        mean(F.col("recall") < F.col("bound") - SLACK).alias("m2"), mean(F.col("recall") - F.col("bound")).alias("gap"), mean(F.col("bound") >= 1).alias("fully_certified"),
    )


def bound_budgets(log: DataFrame, key: str, per_unit: float, target: float) -> DataFrame:
    """For each value of ``key`` of (key, seq, bound) the requests, in units of ``per_unit``, until a bound first reaches
    the target; null if none does."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    first = log.withColumn("__k", rank).groupBy(key)
    return first.agg(F.round(F.min(F.when(F.col("bound") >= target, F.col("__k") / per_unit)), 6).alias(f"to_{round(target * 1000):04d}"))


def variants(candidates: DataFrame, lam: DataFrame, k: int) -> DataFrame:
    """(variant, qid, bound): certificates of the same candidates (qid, item_id, d, exact, d_star, eps, r) in five
    variants: as they are, with one width for all regions, without the scale of the view, from the inner count alone,
    and from the outer count alone."""
    from driftline.functions import vectors as V
    from driftline.operators.search import certify

    both = candidates.join(F.broadcast(lam.select("lam")))
    full = certify(both.withColumn("w", V.width_of(F.col("eps"), F.col("lam"))), k)
    flat = certify(both.withColumn("w", F.when(F.col("eps") < float("inf"), F.col("lam")).otherwise(F.col("eps"))), k)
    plain = certify(both.withColumn("w", F.col("eps")), k)
    made = {"full": full.select("qid", "bound"), "one_width": flat.select("qid", "bound"), "no_scale": plain.select("qid", "bound"), "inner": full.select("qid", (F.col("m") / float(k)).alias("bound")), "outer": full.select("qid", (F.greatest(F.lit(0), k - F.col("z")) / float(k)).alias("bound"))}
    parts = [df.select(F.lit(name).alias("variant"), "qid", "bound") for name, df in made.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mean_of_runs(runs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Means over runs, missing values skipped; empty runs (requests = 0) are left out if a method has any other."""
    some = F.max((F.col("requests") > 0).cast("int")).over(Window.partitionBy(key))
    return runs.withColumn("__some", some).filter((F.col("requests") > 0) | (F.col("__some") == 0)).groupBy(key).agg(*[F.round(F.avg(c), 6).alias(c) for c in columns])


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """(category, seconds, cnt, per_item, total): seconds by category and all but those of served queries."""
    per = ledger.groupBy("category").agg(F.sum("seconds").alias("seconds"), F.sum("cnt").alias("cnt"))
    total = F.sum(F.when(F.col("category") != "served_query", F.col("seconds"))).over(Window.partitionBy())
    return per.select("category", F.round("seconds", 6).alias("seconds"), "cnt", F.round(F.col("seconds") / F.nullif(F.col("cnt"), F.lit(0)), 6).alias("per_item"), F.round(total, 6).alias("total"))


def moving_bound(log: DataFrame, size: int, target: float, block: int = 100_000) -> DataFrame:
    """One row, seq: the first request at which the mean of the last ``size`` bounds (missing: 1) reaches the target.

    Requests are numbered by ranges and cut into blocks of at least ``size``; each block also holds the ``size`` - 1
    requests before it, so blocks are judged apart.
    """
    block = max(block, size)
    rows = numbered(log.select("seq", F.coalesce("bound", F.lit(1.0)).alias("v")), [F.col("seq")], "n")
    own = F.floor((F.col("n") - 1) / block)
    late = (F.col("n") - 1) % block > block - size
    held = rows.withColumn("own", own).withColumn("block", F.explode(F.when(late, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    mean = F.avg("v").over(Window.partitionBy("block").orderBy("n").rowsBetween(1 - size, 0))
    moved = held.withColumn("mean", mean).filter((F.col("block") == F.col("own")) & (F.col("n") >= size))
    return moved.filter(F.round("mean", 9) >= target).agg(F.min("seq").alias("seq"))


def distinct_wait(log: DataFrame) -> DataFrame:
    """One row, share: the distinct queries of which any request waited."""
    per = log.groupBy("query").agg(F.bool_or((F.col("resolved") > 0) | (F.col("waited") > 0)).alias("w"))
    return per.agg(F.round(F.avg(F.col("w").cast("double")), 6).alias("share"))


def fault_table(rows: DataFrame) -> DataFrame:
    """One row: recovery times, counts by fault, and repeated work per expired lease."""
    audit = F.col("fault") == "audit"
    total = lambda c: F.sum(F.when(audit, F.col(c)))
    return rows.agg(
        F.count("recovery_seconds").alias("killed"), F.round(F.median("recovery_seconds"), 6).alias("median_s"), F.max("recovery_seconds").alias("max_s"), F.count_if(F.col("fault") == "spot").alias("spot_lost"), F.count_if(F.col("fault") == "partition").alias("partitioned"),
        total("lost").alias("lost"), F.round((total("encoded") - total("uniq")) / F.nullif(total("expired"), F.lit(0)), 6).alias("repeats_per_lease"),
    )


def stale_accepted(lines: DataFrame, lease: float) -> DataFrame:
    """One row: acknowledgements accepted after a partition outlived its lease, from consecutive lines of each log."""
    w = Window.partitionBy("worker").orderBy("t")
    pair = lines.withColumns({"nt": F.lead("t").over(w), "nk": F.lead("kind").over(w), "na": F.lead("accepted").over(w)})
    return pair.agg(F.count_if((F.col("kind") == "encoded") & (F.col("t") < F.col("t_stop")) & (F.col("nk") == "acked") & (F.col("nt") > F.col("t_stop") + lease) & (F.col("na") > 0)).alias("stale"))


def coverage(errors: DataFrame, radii: DataFrame) -> DataFrame:
    """(alpha, coverage, width): held-out errors (region, err, d_star) within the radii (region, alpha, eps)."""
    both = errors.join(radii, "region")
    return both.groupBy("alpha").agg(F.round(F.avg((F.col("err") <= F.col("eps")).cast("double")), 6).alias("coverage"), F.round(F.avg(F.when(F.col("eps") < float("inf"), F.col("eps") / F.col("d_star"))), 6).alias("width"))


def mean_confidence(items: DataFrame) -> DataFrame:
    """One row, confidence: the mean over items (native, confidence), where native vectors count 1."""
    return items.agg(F.round(F.avg(F.when(F.col("native"), 1.0).otherwise(F.col("confidence"))), 6).alias("confidence"))


def storage_peak(files: DataFrame) -> DataFrame:
    """One row, peak: the largest total size of the files (sample, bytes) of one sample."""
    return files.groupBy("sample").agg(F.sum("bytes").alias("used")).agg(F.round(F.max("used"), 6).alias("peak"))


def budget_table(curves: DataFrame, at: float, targets: list[float]) -> DataFrame:
    """Per method of (method, budget, value): the value at a budget and the budgets that first reach each target.

    Both are linear between points and skip missing values; beyond the ends the curve is flat, and a target that is
    never reached, or a curve of one point, gives null.
    """
    curves = curves.filter(F.col("value").isNotNull())
    w = Window.partitionBy("method").orderBy("budget")
    pair = curves.withColumns({"b1": F.lead("budget").over(w), "v1": F.lead("value").over(w)})
    slope = (F.col("b1") - F.col("budget")) / F.nullif(F.col("v1") - F.col("value"), F.lit(0.0))
    inside = F.when((F.col("budget") <= at) & (F.col("b1") > at), F.col("value") + (F.lit(at) - F.col("budget")) / F.nullif(F.col("b1") - F.col("budget"), F.lit(0.0)) * (F.col("v1") - F.col("value")))
    flat = F.when(F.lit(at) < F.min("budget"), F.min_by("value", "budget")).when(F.lit(at) >= F.max("budget"), F.max_by("value", "budget"))
    reach = [F.round(F.when(F.count(F.lit(1)) > 1, F.min(F.when(F.col("value") >= t, F.col("budget")).when(F.col("v1") >= t, F.col("budget") + (F.lit(t) - F.col("value")) * slope))), 6).alias(f"to_{round(t * 1000):04d}") for t in targets]
    return pair.groupBy("method").agg(F.round(F.coalesce(flat, F.max(inside)), 6).alias("value_at"), *reach)


def reembed_cost(ledger: DataFrame, items: DataFrame) -> DataFrame:
    """One row: encoding seconds per item from (seconds, cnt), and the seconds that all items would take."""
    per = ledger.agg((F.sum("seconds") / F.nullif(F.sum("cnt"), F.lit(0))).alias("per_item"))
    return items.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(per)).select("n", F.round("per_item", 6).alias("per_item"), F.round(F.col("n") * F.col("per_item"), 3).alias("seconds"))
