"""Stored state: versions behind a pointer, numbered logs, staged edges, graphs, ledgers, curves and whole indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.rank import numbered
from driftline.functions.scratch import discard, materialize
from driftline.sources import corpora

CURVE = "step long, budget double, recall double, mean_bound double"
LEDGER = "ts double, category string, seconds double, cnt long, device string"


def num(value: Column) -> Column:
    """A number as JSON text; infinities are strings, as JSON has no such numbers.

    Sizes from 1e-4 to below 1e16 are written without exponents, where Spark has them from 1e7 on and below 1e-3.
    """
    infinite = F.when(value == float("inf"), '"inf"').when(value == float("-inf"), '"-inf"')
    said, size = value.cast("string"), F.abs(value)
    plain = F.regexp_replace(said.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    said = F.when(said.contains("E") & (size >= 1e-4) & (size < 1e16), plain).otherwise(said)
    return F.coalesce(infinite, F.when(value.isNotNull() & ~F.isnan(value), said), F.lit("null"))


def unnum(text: Column) -> Column:
    """The number of a JSON text by ``num``; null for null."""
    return F.when(text == '"inf"', float("inf")).when(text == '"-inf"', float("-inf")).otherwise(text.try_cast("double"))


def to_base64(vector: Column) -> Column:
    """A vector as base64 of a JSON array, as payloads carry it."""
    return F.base64(F.encode(F.to_json(vector), "utf-8"))


def from_base64(text: Column) -> Column:
    return F.from_json(F.decode(F.unbase64(text), "utf-8"), "array<double>")


def write_version(df: DataFrame, root: str, version: int) -> None:
    """Write a version and then the marker that makes it count; readers see the whole version or the one before."""
    df.write.mode("overwrite").parquet(f"{root}/data/v={version}")
    df.sparkSession.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").json(f"{root}/committed")


def read_version(spark: SparkSession, root: str) -> DataFrame:
    last = spark.read.schema("version long").json(f"{root}/committed").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/data/v={last}")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; where none was finished there it is made and written first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def log_lines(records: DataFrame, order: list[Column], after: int) -> DataFrame:
    """(seq, line) of records (kind, fields): numbered from after + 1 in an order that tells them apart, as JSON, a TAB
    and its CRC-32. ``fields`` is a struct."""
    rows = numbered(records, order, "n").withColumn("seq", F.col("n") + after)
    body = F.to_json(F.struct("seq", "kind", "fields"))
    return rows.withColumn("body", body).select("seq", F.concat("body", F.lit("\t"), F.crc32(F.encode("body", "utf-8")).cast("string")).alias("line"))


def append_log(records: DataFrame, order: list[Column], path: str) -> int:
    """Append records to the log in a folder and return the last number. What a torn write left behind is passed over
    by ``read_log`` and its numbers are given anew."""
    spark = records.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = read_log(spark, path).agg(F.max("seq")).first()[0] if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else 0
    lines = log_lines(records, order, old or 0)
    lines.select("line").write.mode("append").text(path)
    return lines.agg(F.max("seq")).first()[0] or old or 0


def sound(lines: DataFrame) -> DataFrame:
    """(seq, body) of the lines (line) before the first number that no sound line has; a log's files need no order."""
    body = F.regexp_extract("line", r"(?s)^(.*)\t[^\t]*$", 1)
    good = lines.select(body.alias("body"), F.regexp_extract("line", r"\t(\d+)$", 1).alias("crc")).filter(F.crc32(F.encode("body", "utf-8")).cast("string") == F.col("crc"))
    parsed = good.select(F.get_json_object("body", "$.seq").cast("long").alias("seq"), "body").filter("seq > 0").dropDuplicates(["seq"])
    gap = numbered(parsed, [F.col("seq")], "n").filter("n <> seq").agg(F.min("n").alias("gap"))
    return parsed.join(F.broadcast(gap)).filter("gap IS NULL OR seq < gap").select("seq", "body")


def read_log(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """(seq, kind, body) of the sound records of a log after a number."""
    rows = sound(spark.read.text(path).withColumnRenamed("value", "line"))
    return rows.filter(F.col("seq") > after).select("seq", F.get_json_object("body", "$.kind").alias("kind"), "body")


def append(df: DataFrame, path: str) -> None:
    """Append rows to a table: requests, ledger entries, native vectors, staged edges."""
    df.write.mode("append").parquet(path)


def replay(base: DataFrame, staged: DataFrame) -> DataFrame:
    """(src, nbrs): base lists after the staged batches (batch, src, added, removed) in their order; what stays keeps
    the base's order, what was added follows."""
    steps = staged.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("batch", "added", "removed"))).alias("steps"))
    none = F.array().cast("array<bigint>")
    step = lambda nbrs, s: F.concat(F.array_except(nbrs, F.coalesce(s["removed"], none)), F.array_except(F.coalesce(s["added"], none), F.array_except(nbrs, F.coalesce(s["removed"], none))))
    both = base.select("src", "nbrs").join(steps, "src", "full")
    return both.select("src", F.coalesce(F.aggregate(F.coalesce("steps", F.array().cast(dict(steps.dtypes)["steps"])), F.coalesce("nbrs", none), step)).alias("nbrs"))


def truncate_native(native: DataFrame, published: DataFrame) -> DataFrame:
    """The records (gen, offset, ...) of a native log that its published sizes (gen, size) cover."""
    return native.join(published, "gen").filter("offset < size").drop("size")


def save_graph(edges: DataFrame, path: str) -> None:
    """Write (layer, src, pos, dst), a folder for each layer."""
    edges.write.mode("overwrite").partitionBy("layer").parquet(path)


def load_graph(spark: SparkSession, path: str, layer: int | None = None) -> DataFrame:
    edges = spark.read.parquet(path)
    return edges if layer is None else edges.filter(F.col("layer") == layer)


def upsert_segments(rows: DataFrame, spark: SparkSession, path: str, size: int = 4096) -> None:
    """Replace single rows (item_id, vec) of written segments: only the segments that hold such a row are written."""
    hit = rows.select((F.col("item_id") / size).cast("bigint").alias("segment")).distinct()
    old = spark.read.parquet(path).join(hit, "segment", "left_semi").select("item_id", "vec")
    merged = old.join(rows.select("item_id", F.col("vec").alias("new")), "item_id", "full").select("item_id", F.coalesce("new", "vec").alias("vec"))
    aside = materialize(merged, "segments")  # the segments can't be read while they are written
    corpora.write_segments(aside, path, size)
    discard(aside)


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CURVE).json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON file of a summary of few rows."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def create_index(root: str, items: DataFrame, edges: DataFrame, old: int, segment: int = 4096) -> None:
    """A new index: segments of (item_id, vec), its graph, its widths, and a log that begins with its creation."""
    spark = items.sparkSession
    corpora.write_segments(items.select("item_id", "vec"), f"{root}/segments", segment)
    save_graph(edges, f"{root}/graph")
    n = items.count()
    write_version(spark.range(1).select(F.lit(n).alias("n"), F.lit(old).alias("d_old"), F.lit(segment).alias("segment_rows")), f"{root}/meta", 0)
    append_log(spark.range(1).select(F.lit("create").alias("kind"), F.struct(F.lit(n).alias("n")).alias("fields")), [F.col("kind")], f"{root}/log")


def attach(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of an index: segments, graph, meta and the sound log."""
    return {"segments": corpora.read_segments(spark, f"{root}/segments"), "graph": load_graph(spark, f"{root}/graph"), "meta": read_version(spark, f"{root}/meta"), "log": read_log(spark, f"{root}/log")}
