"""Fitted maps as a table: checks, joins by region, pooled fallback, adapters of queries, and storing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import vectors as V
from driftline.functions.scratch import checked
from driftline.operators import search

#: A table of maps: w holds a column of the map for each output; low-rank maps have down (a row for each inner
#: direction) and up (a row for each output) instead.
SCHEMA = "region int, kind string, w array<array<double>>, down array<array<double>>, up array<array<double>>, b array<double>"


def check_shapes(maps: DataFrame, old: int, new: int) -> DataFrame:
    """``maps``, where a map that doesn't take ``old`` components to ``new`` raises an error when it is read."""
    width = lambda m, n: F.forall(m, lambda row: F.size(row) == n)
    dense = (F.size("w") == new) & width("w", old)
    low = (F.size("up") == new) & width("down", old) & width("up", F.size("down"))
    fine = (F.size("b") == new) & F.when(F.col("kind") == "lowrank", low).otherwise(dense)
    said = F.concat(F.lit("map of region "), F.coalesce(F.col("region").cast("string"), F.lit("(pooled)")), F.lit(f" does not take {old} components to {new}"))
    return maps.filter(F.when(F.coalesce(fine, F.lit(False)), True).otherwise(F.raise_error(said).cast("boolean")))


def apply_maps(items: DataFrame, maps: DataFrame, vector: str, into: str) -> DataFrame:
    """``items`` (region, ...) with ``into``: the image of ``vector`` by its region's map, or by the pooled map (null
    region) where the region has none. A vector of another width than its map's is an error."""
    named = maps.select(F.col("region").alias("__region"), F.struct("kind", "w", "down", "up", "b").alias("__map"))
    pooled = named.filter("__region is null").select(F.col("__map").alias("__pooled"))
    joined = items.join(checked(named.filter("__region is not null")), F.col("region") == F.col("__region"), "left").drop("__region")
    joined = joined.join(F.broadcast(pooled.agg(F.first("__pooled").alias("__pooled")))).withColumn("__map", F.coalesce("__map", "__pooled")).drop("__pooled")
    m, v = F.col("__map"), F.col(f"`{vector}`")
    wide = F.size(F.when(m["kind"] == "lowrank", m["down"][0]).otherwise(m["w"][0]))
    image = F.when(m["kind"] == "lowrank", V.low_rank(v, m["down"], m["up"], m["b"])).otherwise(V.affine(v, m["w"], m["b"]))
    fits = F.when(m.isNull(), F.raise_error("no map for the region and no pooled map").cast("boolean")).when(F.size(v) != wide, F.raise_error(F.concat(F.lit("vector of "), F.size(v).cast("string"), F.lit(" components for a map of "), wide.cast("string"))).cast("boolean")).otherwise(True)
    return joined.withColumn(into, F.when(fits, image)).drop("__map")


def _rotation(frame: pd.DataFrame) -> np.ndarray:
    u, _, vt = np.linalg.svd(np.stack(frame.old.to_numpy()).astype(float).T @ np.stack(frame.new.to_numpy()).astype(float))
    return u @ vt


def fit_rotations(pairs: DataFrame, least: int = 2) -> DataFrame:
    """A table of maps (SCHEMA) from (region, old, new): an orthogonal map for each region with at least ``least``
    pairs, and a pooled one (null region) from all pairs.

    Only the products of inputs and outputs leave the tasks for the pooled map, one matrix a task.
    """

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) < least:
            return pd.DataFrame({"region": pd.Series([], dtype="int32"), "w": pd.Series([], dtype=object)})
        return pd.DataFrame({"region": [frame.region.iloc[0]], "w": [[c.tolist() for c in _rotation(frame).T]]})

    def products(frames):
        for frame in frames:
            if len(frame):
                cross = np.stack(frame.old.to_numpy()).astype(float).T @ np.stack(frame.new.to_numpy()).astype(float)
                yield pd.DataFrame({"i": np.repeat(np.arange(cross.shape[0]), cross.shape[1]), "j": np.tile(np.arange(cross.shape[1]), cross.shape[0]), "x": cross.ravel()})

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        cross = np.zeros((frame.i.max() + 1, frame.j.max() + 1))
        cross[frame.i, frame.j] = frame.x
        u, _, vt = np.linalg.svd(cross)
        return pd.DataFrame({"region": pd.Series([None], dtype="Int32"), "w": [[c.tolist() for c in (u @ vt).T]]})

    kind = "region int, w array<array<double>>"
    each = pairs.select("region", "old", "new").groupBy("region").applyInPandas(own, kind)
    summed = pairs.select("old", "new").mapInPandas(products, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    pooled = summed.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(solve, kind)
    none = F.lit(None).cast("array<array<double>>")
    return each.unionByName(pooled).select("region", F.lit("procrustes").alias("kind"), "w", none.alias("down"), none.alias("up"), F.transform("w", lambda _: F.lit(0.0)).alias("b"))


def adapter(pairs: DataFrame, width: int) -> DataFrame:
    """A query adapter, one pooled orthogonal map (SCHEMA) from new to old vectors (new, old), both padded to a common
    width; its images are cut to the old width again by ``adapt``."""
    padded = pairs.select(F.lit(None).cast("int").alias("region"), V.pad(F.col("new"), width).alias("old"), V.pad(F.col("old"), width).alias("new"))
    return fit_rotations(padded).filter("region is null").limit(1)


def adapt(queries: DataFrame, maps: DataFrame, vector: str, old: int, width: int) -> DataFrame:
    """``queries`` with ``vector`` taken to the old space: padded, mapped, cut to ``old`` components."""
    sent = queries.withColumn("region", F.lit(None).cast("int")).withColumn(vector, V.pad(F.col(vector), width))
    return apply_maps(sent, maps, vector, "__old").withColumn(vector, F.slice("__old", 1, old)).drop("__old", "region")


def adapted_search(queries: DataFrame, items: DataFrame, maps: DataFrame, k: int, old: int, width: int) -> DataFrame:
    """(qid, item_id, d, r): queries (qid, vec) taken to the old space by an adapter and searched over old vectors."""
    return search.knn(adapt(queries, maps, "vec", old, width), items, k)


def squared_error(pairs: DataFrame, found: str, wanted: str) -> DataFrame:
    """One row, mse: squared errors summed over components, averaged over rows."""
    return pairs.agg(F.round(F.avg(V.squared_l2(F.col(found), F.col(wanted))), 9).alias("mse"))


def save_maps(maps: DataFrame, path: str) -> None:
    maps.write.mode("overwrite").parquet(path)


def load_maps(spark: SparkSession, path: str, old: int, new: int) -> DataFrame:
    """The maps of a folder, checked for their widths."""
    return check_shapes(spark.read.schema(SCHEMA).parquet(path), old, new)
