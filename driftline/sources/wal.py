"""The commit log: lines of JSON with a checksum, of which the sound prefix counts."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A native record's head is item, fence and checksum, little-endian; the checksum starts from the item.
HEAD = "<qqI"


def encode(records: DataFrame, value: str = "body") -> DataFrame:
    """``records`` with line: the body, a TAB and its CRC-32."""
    return records.withColumn("line", F.concat(F.col(value), F.lit("\t"), F.crc32(F.encode(value, "utf-8")).cast("string")))


def sound_prefix(lines: DataFrame, order: str = "pos", line: str = "line") -> DataFrame:
    """(pos, body) of the lines before the first whose checksum fails; one aggregate finds it."""
    body, crc = F.regexp_extract(line, r"(?s)^(.*)\t[^\t]*$", 1), F.regexp_extract(line, r"(?s)^.*\t(\d+)$", 1)
    parsed = lines.select(order, body.alias("body"), (F.crc32(F.encode(body, "utf-8")).cast("string") == crc).alias("ok"))
    bad = parsed.filter(~F.coalesce("ok", F.lit(False))).agg(F.min(order).alias("__bad"))
    return parsed.join(F.broadcast(bad)).filter(F.col("__bad").isNull() | (F.col(order) < F.col("__bad"))).select(order, "body")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(pos, body) of a log file's sound prefix; a log is one file and read whole as one row per line."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return sound_prefix(whole.filter("line <> ''"))


def records(log: DataFrame, schema: str, after: int = 0) -> DataFrame:
    return log.select("pos", F.from_json("body", schema).alias("r")).select("pos", "r.*").filter(F.col("seq") > after)


def published_size(native: DataFrame) -> DataFrame:
    """(gen, size): per generation the end of the records that the log has published."""
    return native.groupBy("gen").agg(F.max(F.col("offset") + F.col("cnt") * F.col("record_size")).alias("size"))


def native_record(item_id: int, fence: int, vector: list[float]) -> bytes:
    body = np.asarray(vector, "<f4").tobytes()
    return struct.pack(HEAD, item_id, fence, zlib.crc32(body, item_id & 0xFFFFFFFF)) + body


def read_native(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(file, pos, item_id, fence, vec) of binary vector logs, one file a task, up to the first unsound record."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = struct.calcsize(HEAD) + 4 * width
        for frame in frames:
            for name, data in zip(frame.path, frame.content, strict=True):
                rows = []
                for pos in range(len(data) // size):
                    part = data[pos * size : (pos + 1) * size]
                    item, fence, crc = struct.unpack_from(HEAD, part)
                    if zlib.crc32(part[struct.calcsize(HEAD) :], item & 0xFFFFFFFF) != crc:
                        break
                    rows.append((name, pos, item, fence, np.frombuffer(part, "<f4", offset=struct.calcsize(HEAD)).tolist()))
                yield pd.DataFrame(rows, columns=["file", "pos", "item_id", "fence", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, pos bigint, item_id bigint, fence bigint, vec array<float>")
