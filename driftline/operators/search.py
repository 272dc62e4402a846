"""Nearest-neighbour search with certificates over exact and bridged vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import vectors as V

BLOCK_QUERIES, BLOCK_ITEMS = 512, 8192


def knn(queries: DataFrame, items: DataFrame, k: int, query_id: str = "qid", item_id: str = "item_id", vector: str = "vec") -> DataFrame:
    """(qid, item_id, d, r): the k nearest by distance rounded to 6 decimals, ties to the smaller id.

    Both sides are packed into blocks; block pairs are multiplied as matrices and give k rows a query at most, so
    what is shuffled for the final ranks is k rows per query and block of items.
    """

    def packed(df: DataFrame, key: str, size: int, prefix: str) -> DataFrame:
        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for a in range(0, len(frame), size):
                    some = frame.iloc[a : a + size]
                    yield pd.DataFrame({f"{prefix}_ids": [some.iloc[:, 0].to_numpy(np.int64).tobytes()], f"{prefix}_v": [np.stack(some.iloc[:, 1].to_numpy()).astype(np.float64).tobytes()]})

        return df.select(F.col(key).cast("bigint"), F.col(vector).cast("array<double>")).mapInPandas(pack, f"{prefix}_ids binary, {prefix}_v binary")

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                qi, ii = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.i_ids, np.int64)
                q, x = np.frombuffer(r.q_v).reshape(len(qi), -1), np.frombuffer(r.i_v).reshape(len(ii), -1)
                rough = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T
                some = min(k + 8, len(ii))
                pick = np.argpartition(rough, some - 1, axis=1)[:, :some]
                edge = np.take_along_axis(rough, pick, 1).max(1, keepdims=True)
                # distances that round alike differ by 1e-6 at most, so their squares by twice that times the distance
                edge = edge + 2.1e-6 * np.sqrt(np.maximum(edge, 0)) + 1e-11 + 1e-13 * ((q * q).sum(1).max() + (x * x).sum(1).max())
                wide = np.flatnonzero((rough <= edge).sum(1) > some)
                for j in range(len(qi)):
                    at = np.flatnonzero(rough[j] <= edge[j]) if j in wide else pick[j]
                    d = np.round(np.sqrt(((x[at] - q[j]) ** 2).sum(1)), 6)
                    best = np.lexsort((ii[at], d))[:k]
                    yield pd.DataFrame({"qid": qi[j], "item_id": ii[at][best], "d": d[best]})

    pairs = packed(queries, query_id, BLOCK_QUERIES, "q").crossJoin(packed(items, item_id, BLOCK_ITEMS, "i"))
    found = pairs.mapInPandas(near, "qid bigint, item_id bigint, d double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d", "item_id"))
    return found.withColumn("r", rank).filter(F.col("r") <= k)


def region_probe(queries: DataFrame, items: DataFrame, centroids: DataFrame, probes: int, k: int) -> DataFrame:
    """(qid, item_id, d, r): search of the ``probes`` regions whose centroids are nearest, joined on the region."""
    near = knn(queries, centroids.withColumnRenamed("centroid", "qvec"), probes, item_id="region", vector="qvec").select("qid", F.col("item_id").alias("region"))
    chosen = near.join(queries, "qid")
    d = items.join(chosen, "region").withColumn("d", V.l2(F.col("qvec"), F.col("vec")))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("d", "item_id"))).filter(F.col("r") <= k).select("qid", "item_id", "d", "r")


def certify(candidates: DataFrame, k: int) -> DataFrame:
    """(qid, m, z, bound) of candidates (qid, item_id, d, exact, w).

    The count of upper bounds below a lower bound is under k exactly if the lower bound is at most the k-th smallest
    upper bound, so both counts need window values only.
    """
    q = Window.partitionBy("qid")
    b = candidates.withColumns({"lb": V.lower_bound(F.col("d"), F.col("exact"), F.col("w")), "ub": V.upper_bound(F.col("d"), F.col("exact"), F.col("w"))})
    b = b.withColumns({"r": F.row_number().over(q.orderBy("d", "item_id")), "u": F.row_number().over(q.orderBy("ub")), "n": F.count(F.lit(1)).over(q)})
    b = b.withColumns({"edge": F.min(F.when(F.col("r") > k, F.col("lb"))).over(q), "kth": F.max(F.when(F.col("u") == k, F.col("ub"))).over(q)})
    inside, few = F.col("r") <= k, F.col("n") <= k
    out = b.groupBy("qid").agg(
        F.max("n").alias("n"),
        F.sum(F.when(inside & (few | (F.col("ub") < F.col("edge"))), 1).otherwise(0)).cast("bigint").alias("m"),
        F.sum(F.when(~inside & (F.col("lb") <= F.col("kth")), 1).otherwise(0)).cast("bigint").alias("z"),
    )
    return out.select("qid", "m", "z", F.when(F.col("n") <= k, 1.0).otherwise(F.greatest(F.lit(0), F.col("m"), k - F.col("z")) / F.lit(float(k))).alias("bound"))


def ambiguous(candidates: DataFrame, k: int, limit: int) -> DataFrame:
    """(qid, item_id, r): bridged candidates whose interval meets the k-th result's, widest overlap first."""
    q = Window.partitionBy("qid")
    b = candidates.withColumns({"lb": V.lower_bound(F.col("d"), F.col("exact"), F.col("w")), "ub": V.upper_bound(F.col("d"), F.col("exact"), F.col("w"))})
    b = b.withColumns({"rk": F.row_number().over(q.orderBy("d", "item_id")), "n": F.count(F.lit(1)).over(q)})
    at = lambda c: F.max(F.when(F.col("rk") == k, F.col(c))).over(q)
    b = b.withColumns({"lk": at("lb"), "uk": at("ub"), "dk": at("d")}).filter(~F.col("exact"))
    overlap = F.least("ub", "uk") - F.greatest("lb", "lk")
    short = F.col("n") < k
    b = b.withColumns({"ov": F.when(short, F.lit(0.0)).otherwise(F.round(overlap, 9)), "gap": F.when(short, F.col("rk").cast("double")).otherwise(F.round(F.abs(F.col("d") - F.col("dk")), 9))}).filter("ov >= 0")
    return b.withColumn("r", F.row_number().over(q.orderBy(F.col("ov").desc(), "gap", "item_id"))).filter(F.col("r") <= limit).select("qid", "item_id", "r")


def rank_merge(old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """(qid, item_id, d, r): two ranked lists merged; an item's distance in the second list replaces the first's."""
    both = old.select("qid", "item_id", F.col("d").alias("d_old")).join(new.select("qid", "item_id", F.col("d").alias("d_new")), ["qid", "item_id"], "full")
    both = both.select("qid", "item_id", F.coalesce("d_new", "d_old").alias("d"))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("d", "item_id"))).filter(F.col("r") <= k)


def recall(found: DataFrame, truth: DataFrame, k: int, into: str = "recall") -> DataFrame:
    """(qid, recall): the share of each query's k true neighbours that were found."""
    hits = truth.join(found.select("qid", "item_id").withColumn("__hit", F.lit(1)), ["qid", "item_id"], "left")
    return hits.groupBy("qid").agg((F.count("__hit") / F.lit(float(k))).alias(into))
