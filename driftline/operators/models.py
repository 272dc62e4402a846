"""Fitting of regions and bridges, and word-vector encoding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import vectors as V


def regions(items: DataFrame, k: int, sample: int, seed: int = 1) -> DataFrame:
    """items with region: k-means fitted on a bounded sample in hash order, then every row assigned."""
    with_features = items.withColumn("__f", array_to_vector(F.col("vec").cast("array<double>")))
    model = KMeans(k=k, maxIter=25, seed=seed, featuresCol="__f", predictionCol="region").fit(with_features.orderBy(F.xxhash64("item_id")).limit(sample))
    return model.transform(with_features).drop("__f")


def procrustes(pairs: DataFrame) -> DataFrame:
    """(region, w) from (region, old, new): the orthogonal map nearest to taking old to new, row-major."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        u, _, vt = np.linalg.svd(np.stack(frame.old.to_numpy()).astype(float).T @ np.stack(frame.new.to_numpy()).astype(float))
        return pd.DataFrame({"region": [frame.region.iloc[0]], "w": [(u @ vt).ravel().tolist()]})

    return pairs.groupBy("region").applyInPandas(run, "region int, w array<double>")


class Moments:
    """Sums over pairs of rows from which ridge maps follow: counts, sums, and products of inputs and outputs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        one = np.ones((len(x), 1))
        self.joint = np.c_[one, x, y].T @ np.c_[one, x, y]
        self.width = x.shape[1]

    def less(self, other: Moments) -> Moments:
        """The sums without those of some of the rows."""
        rest = object.__new__(Moments)
        rest.joint, rest.width = self.joint - other.joint, self.width
        return rest

    def fit(self, rank: int, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Down, up and offset of the ridge map limited to a rank: the full map of the centered sums, projected on the
        leading directions of its fit."""
        count, w = self.joint[0, 0], self.width
        centered = self.joint[1:, 1:] - np.outer(self.joint[1:, 0], self.joint[0, 1:]) / count
        gram, cross = centered[:w, :w] + ridge * np.eye(w), centered[:w, w:]
        full = np.linalg.solve(gram, cross)
        up = np.linalg.eigh(full.T @ gram @ full)[1][:, ::-1][:, :rank]
        down = full @ up
        middle = self.joint[0, 1:] / count
        return down, up, middle[w:] - up @ (middle[:w] @ down)

    def error(self, down: np.ndarray, up: np.ndarray, offset: np.ndarray) -> float:
        """The sum of squared errors of a map over these rows: a quadratic form of the sums."""
        side = np.r_[offset[None, :], down @ up.T, -np.eye(len(offset))]
        return float(np.einsum("ij,ik,kj->", side, self.joint, side))


def low_rank(pairs: DataFrame, rank: int, grid: list[float], folds: int) -> DataFrame:
    """(region, ridge, error, down, up, b): per region the penalty with the least cross-validated error, first on ties.

    Each fold is summed once; the sums of the other folds are differences, so no penalty looks at the rows again.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item_id")
        x, y = (np.stack(frame[c].to_numpy()).astype(float) for c in ("old", "new"))
        held = [Moments(x[i :: min(folds, len(x))], y[i :: min(folds, len(x))]) for i in range(min(folds, len(x)))]
        every = Moments(x, y)
        rest = [every.less(m) for m in held]
        errors = [sum(out.error(*others.fit(rank, ridge)) for out, others in zip(held, rest, strict=True)) if len(held) > 1 else 0.0 for ridge in grid]
        best = int(np.argmin(errors))
        down, up, b = every.fit(rank, grid[best])
        return pd.DataFrame({"region": [frame.region.iloc[0]], "ridge": [grid[best]], "error": [errors[best]], "down": [down.ravel().tolist()], "up": [up.ravel().tolist()], "b": [b.tolist()]})

    return pairs.groupBy("region").applyInPandas(run, "region int, ridge double, error double, down array<double>, up array<double>, b array<double>")


def word_average(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(id, vec): the mean of a text's known word vectors as a unit vector; the vocabulary's mean if none is known."""
    token = F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)(\w+)")))
    hits = texts.select("id", token.alias("word")).groupBy("id", "word").count().join(words, "word")
    long = hits.select("id", "count", F.posexplode("vec").alias("j", "x")).groupBy("id", "j").agg((F.sum(F.col("x") * F.col("count")) / F.sum("count")).alias("x"))
    known = long.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("mean"))
    whole = words.select(F.posexplode("vec").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("x")).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("vocabulary"))
    joined = texts.select("id").join(known, "id", "left").join(F.broadcast(whole))
    return joined.select("id", V.unit(F.coalesce("mean", "vocabulary")).alias("vec"))
