"""WARC archives: an index of records first, then coalesced byte-range reads of those selected."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checked, fresh_path, materialize

#: A read goes on over gaps of at most so many bytes, and holds at most so many bytes unless one record is longer.
GAP_BYTES, READ_BYTES = 65_536, 8_000_000
FILE_BYTES = 256_000_000
INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string"
#: Record headers and the revisit profile of the WARC 1.1 standard; the date is not part of the data.
VERSION, PROFILE, DATE = b"WARC/1.1\r\n", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"1970-01-01T00:00:00Z"


def open_store(folder: str):
    """The pyarrow file system and root of a folder. Stores that Spark reads by Hadoop's names for S3 are opened by
    pyarrow's; a scheme that pyarrow has no store for raises its error, and ``folder`` has to name another one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder if "://" in folder else re.sub(r"^(?:file:)?/+", "file:///", folder)))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"null" if page_id is None else b"%d" % page_id)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, compressed by itself. A revisit keeps the HTTP head, with the payload's length, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = (url or "").encode().replace(b"%", b"%25").replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    head = [b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _name(page_id), b"WARC-Target-URI: " + target, b"WARC-Date: " + DATE, b"WARC-Payload-Digest: sha1:" + digest.encode()]
    if revisit:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + _name(refers_to)]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> dict:
    """The fields of one compressed record; payload is None for a revisit."""
    raw = zlib.decompress(data, 31)
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    number = lambda x: None if x in (None, b"<urn:page:null>") else int(x[10:-1])
    kind = fields[b"WARC-Type"].decode()
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    url = fields[b"WARC-Target-URI"].replace(b"%0A", b"\n").replace(b"%0D", b"\r").replace(b"%25", b"%").decode()
    return {"page_id": number(fields[b"WARC-Record-ID"]), "url": url, "payload_bytes": size, "payload_digest": fields[b"WARC-Payload-Digest"].decode()[5:], "record_type": kind, "refers_to": number(fields.get(b"WARC-Refers-To")), "payload": None if kind == "revisit" else payload}


def classify(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, refers_to and revisit.

    Of rows with equal payloads those with the smallest page_id (all that tie) are responses; rows without a page_id
    revisit it too, and are responses if no row of the payload has one.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    strong = pages.select("page_id", "url", payload.alias("html")).withColumn("__print", F.sha2(F.encode("html", "utf-8"), 256))
    least = strong.groupBy("__print").agg(F.min("page_id").alias("__least"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__print", "__least")
    joined = strong.join(checked(materialize(least, "payloads")), "__print", "left")
    revisit = F.col("__least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__least"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("__least")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per row of ``pages`` and return the index: file, offset, length, url, digest, page_id, type.

    ``folder`` is a URI that all executors reach (by default a new one in the shared folder). Each attempt of a task
    writes files of its own, and the index, written as a table, names those of the attempts that counted. Null and empty
    pages have empty payloads, pages of any length are one record, repeated rows are records of their own, other columns
    (also those named like the index's) are left out, and an empty table gives an empty index.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, offset, part = None, 0, 0
        for frame in frames:
            rows = []
            for page_id, url, html, refers_to, revisit in frame.itertuples(index=False, name=None):
                if out is None or offset >= FILE_BYTES:
                    if out:
                        out.close()
                    path, offset, part = f"{root}/{name}-{part}.warc.gz", 0, part + 1
                    out = store.open_output_stream(path, compression=None)
                payload = html.encode()
                number = lambda x: None if pd.isna(x) else int(x)
                digest = digest_of(payload)
                data = record(number(page_id), url, payload, digest, number(refers_to), bool(revisit))
                out.write(data)
                rows.append((path, offset, len(data), url, digest, number(page_id), "revisit" if revisit else "response"))
                offset += len(data)
            made = pd.DataFrame(rows, columns=["file", "offset", "length", "url", "digest", "page_id", "record_type"])
            yield made.astype({"page_id": "Int64"})
        if out:
            out.close()

    # ids travel as text: a column of numbers with nulls would become floating point
    sent = classify(pages).select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"), "revisit")
    index = materialize(sent.mapInPandas(run, INDEX), "warc-index")
    return index.withColumn("store", F.lit(folder))


def read_archives(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records that ``index`` selects, read by sorted byte ranges in which near records are coalesced. Rows that
    repeat a record read it again; further columns of ``index`` don't matter; an empty index gives an empty table."""
    by_file = Window.partitionBy("file").orderBy("offset")
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by_file)
    marked = index.withColumn("__gap", F.coalesce(gap, F.lit(0)) > GAP_BYTES)
    grouped = marked.withColumn("__part", F.sum(F.col("__gap").cast("int")).over(by_file)).withColumn("__size", F.floor(F.sum("length").over(by_file) / READ_BYTES))
    ranges = grouped.groupBy("store", "file", "__part", "__size").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                store, _ = open_store(r.store)
                with store.open_input_file(r.file) as f:
                    f.seek(int(r.start))
                    data = f.read(int(r.end - r.start))
                rows = [parse(data[x["offset"] - r.start : x["offset"] - r.start + x["length"]]) for x in r.records]
                made = pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})
                yield made[names]

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    spread = ranges.select("store", "file", "start", "end", "records").repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "start")
    return spread.mapInPandas(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads)
