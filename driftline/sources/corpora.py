"""Readers of corpora, queries, word vectors and segments, and their writers."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.rank import numbered


def positions(df: DataFrame, order: Column, into: str = "id") -> DataFrame:
    return numbered(df, [order], into).withColumn(into, F.col(into) - 1)


def sampled(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, in the order of a hash of the key."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def passages(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(id, text, title, source) from (gzipped) TSV with a header id, text, title: a sample, renumbered."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"').select(F.col("id").alias("source"), "text", "title")
    return positions(sampled(raw, "source", n), F.col("source").cast("bigint")).select("id", F.concat_ws(". ", "title", "text").alias("text"), "title", "source")


def first_column(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(text) from the first TAB column of several files, blank lines left out."""
    return spark.read.text(paths).select(F.split("value", "\t")[0].alias("text")).filter(F.trim("text") != "")


def split_once(lines: DataFrame) -> DataFrame:
    """(source, text) of lines split at their first TAB."""
    parts = F.split("value", "\t", 2)
    return lines.filter(F.trim("value") != "").select(parts[0].cast("bigint").alias("source"), parts[1].alias("text"))


def tar_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(value) of the lines of one member of tar archives, read one archive a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame.content:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    lines: list[str] = []
                    for line in io.TextIOWrapper(tar.extractfile(member), encoding="utf-8", newline="\n"):
                        lines.append(line.rstrip("\n"))
                        if len(lines) == 10_000:
                            yield pd.DataFrame({"value": lines})
                            lines = []
                    yield pd.DataFrame({"value": lines})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")


def tracks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, text, track) with the track taken from the part of the file name before its first dash's second part."""
    lines = spark.read.text(paths).withColumn("track", F.split(F.element_at(F.split("_metadata.file_path", "/"), -1), "[-.]")[1])
    parts = F.split("value", "\t", 2)
    return lines.filter(F.trim("value") != "").select(parts[0].cast("bigint").alias("source"), parts[1].alias("text"), "track")


def captions(spark: SparkSession, path: str, n: int, held: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(items, held-out captions) from parquet metadata with URL and TEXT; only these two columns are read."""
    rows = spark.read.parquet(path).select("URL", "TEXT").filter(F.col("TEXT").isNotNull() & (F.trim("TEXT") != ""))
    items = sampled(rows, "URL", n, seed)
    return items, sampled(rows.join(items.select("URL"), "URL", "left_anti"), "URL", held, seed)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def lookup(corpus: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """(pos, id, content): the text, or the path of the image, of each wanted id (pos, id) in order."""
    return ids.join(corpus, "id", "left").select("pos", "id", F.coalesce("text", F.concat(F.lit(folder + "/"), F.col("image"))).alias("content")).orderBy("pos")


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of lines of a word and its numbers."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("double")).alias("vec"))


def write_jsonl(df: DataFrame, path: str) -> DataFrame:
    """Write JSON lines and return (file, sha256, rows) of each part."""
    df.write.mode("overwrite").json(path)
    files = df.sparkSession.read.format("binaryFile").load(f"{path}/part-*")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.size(F.filter(F.split(F.decode("content", "utf-8"), "\n"), lambda x: x != "")).alias("rows"))


def write_segments(vectors: DataFrame, path: str, rows: int = 4096) -> None:
    """Vectors partitioned by fixed blocks of ids, overwriting only the blocks present."""
    parted = vectors.withColumn("segment", (F.col("item_id") / rows).cast("bigint"))
    parted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(path)


def read_segments(spark: SparkSession, path: str, segments: list[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if segments is None else df.filter(F.col("segment").isin(segments))
