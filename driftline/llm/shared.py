"""Word separators and distributed running sums; written tables and bounded joins come from the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.scratch import checked, discard, fresh_path, join_hot, materialize, scratch

__all__ = ["SPACES", "checked", "discard", "fresh_path", "join_hot", "materialize", "row_hash", "scratch", "spread", "with_running_sum"]

#: ASCII white space that separates words in every operator: the complement of ``[^\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew if it comes from few files whose rows lie in fewer tasks than there are cores.

    For costly maps over small tables; a table of many files is left as it is, without a look at its rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= 2 * cores or df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return df
    return df.repartition(cores)


def row_hash(df: DataFrame, seed: int) -> Column:
    """A 64-bit hash of all columns of a row, nulls included; rows that are equal have equal hashes."""
    plain = [F.array_sort(F.map_entries(f"`{c}`")) if t.startswith("map<") else F.col(f"`{c}`") for c, t in df.dtypes]
    return F.xxhash64(F.lit(seed), *plain, F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns]))


def with_running_sum(df: DataFrame, keys: list[str], by: list[Column], value: Column, into: str, chunks: int) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows of the same ``keys`` that come earlier in the order of ``by``.

    The first of ``by`` is a 64-bit hash. Each key is split into ``chunks`` ranges of that hash with a sum each, so a
    key that holds most rows is spread over many tasks; only one row per key and chunk meets in one.
    """
    chunk, base = "__chunk", "__base"
    parted = df.withColumn(chunk, F.floor((by[0].cast("double") / 2.0**64 + 0.5) * chunks).cast("int"))
    totals = parted.groupBy(*keys, chunk).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(chunk).alias("__c"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(*keys, chunk).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    local = parted.withColumn(into, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = F.col(chunk) == F.col("__c")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return local.join(starts, on).withColumn(into, F.col(into) + F.col(base)).drop(chunk, base, "__c", *[f"__k{i}" for i in range(len(keys))])
