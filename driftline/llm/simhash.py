"""SimHash near-duplicates: a byte-position inverted index with count filtering, then exact verification."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, join_hot, materialize, row_hash, spread

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: A pair within MAX_BITS bits differs in at most as many of the 8 bytes, so it shares at least LEAST_SHARED of them.
POSITIONS, LEAST_SHARED = 8, 8 - MAX_BITS
#: Lists hold the values of three positions, or of four from so many fingerprints on; both meet every pair that counts.
WIDE_FROM = 1 << 27
#: Members of a list that are compared among each other; larger lists are linked through points near to two members.
LARGE_POSTING = 2048

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def simhash(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text; no word: zero."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    last = max(len(words) - width, 0)
    starts = [0, *ends[:last].tolist()]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    octets = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]), np.uint8).reshape(-1, 8)
    votes = np.concatenate([np.bincount(octets[:, p], minlength=256) @ _BITS for p in range(8)])
    return int.from_bytes(np.packbits(2 * votes > len(octets)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp) for every row; fp is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = np.array([simhash(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made)], names=[key, "fp"])

    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, fp bigint")


def position_sets(width: int) -> np.ndarray:
    """Sets of ``width`` byte positions of which any LEAST_SHARED positions hold at least one.

    For three: the positions are dealt to three classes in turn; a set lies in one class, or has two positions of a
    class and one of the next. Of any four positions, two share a class, and each way to deal them holds such a set.
    """
    every = list(itertools.combinations(range(POSITIONS), width))
    if width < LEAST_SHARED:
        split = lambda p: [sum(x % 3 == c for x in p) for c in range(3)]
        every = [p for p in every if any(n[c] == 3 or (n[c] == 2 and n[(c + 1) % 3] == 1) for n in [split(p)] for c in range(3))]
    return np.array(every)


def postings(distinct: DataFrame, sets: np.ndarray) -> DataFrame:
    """The inverted index (list, fp): one list for each value of the bytes at each of the sets of positions.

    Lists of single positions would pair almost everything. Two fingerprints that share LEAST_SHARED positional bytes
    meet in a list of these; those that meet share as many bytes as a set has, so the count of shared bytes still
    decides which pairs are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                octets = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8).astype(np.int64)
                value = np.zeros((len(fp), len(sets)), np.int64)
                for j in range(sets.shape[1]):
                    value = value << 8 | octets[:, sets[:, j]]
                value |= np.arange(len(sets)) << 32
                yield pa.RecordBatch.from_arrays([pa.array(value.ravel()), pa.array(np.repeat(fp, len(sets)))], names=["list", "fp"])

    return distinct.select("fp").mapInArrow(run, "list bigint, fp bigint")


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of fingerprints link: shared positional bytes are tallied, pairs with fewer than the guaranteed
    minimum are passed over, and the bits of the rest are compared."""
    apart = np.ascontiguousarray(a ^ b).view(np.uint64)
    shared = (apart[..., None].view(np.uint8) == 0).sum(-1, dtype=np.int8)
    out = shared >= LEAST_SHARED
    out[out] = np.bitwise_count(apart[out]) <= MAX_BITS
    return out


def link_list(fp: np.ndarray) -> list[tuple[int, int]]:
    """A forest over one list: each fingerprint that has links is tied to the smallest of those it reaches here."""
    fp = np.sort(fp)
    near = np.concatenate([linked(fp[i : i + 256, None], fp[None, :]) for i in range(0, len(fp), 256)])
    label = np.arange(len(fp), dtype=np.int32)
    while True:
        lower = np.where(near, label[None, :], np.int32(len(fp))).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    return [(int(fp[i]), int(fp[j])) for i, j in enumerate(label) if i != j]


def links(index: DataFrame) -> DataFrame:
    """(kind, list, a, b) from the inverted index: kind 0 is a verified link, kind 1 a member of a large list."""

    def emit(pairs: list[tuple[int, int]], kind: int, of: int | np.ndarray = 0) -> pa.RecordBatch:
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(np.broadcast_to(np.int64(of), len(a)).copy()), pa.array(a.copy()), pa.array(b.copy())], names=["kind", "list", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, large, found = None, [], False, set()

        def close() -> None:
            if not large and sum(map(len, held)) > 1:
                found.update(link_list(np.concatenate(held)))

        for batch in batches:
            lists, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(lists):
                continue
            first = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
            stop = np.r_[first[1:], len(lists)]
            inner = np.arange(1, len(first) - 1)  # lists that lie in this batch whole
            two = first[inner[stop[inner] - first[inner] == 2]]
            a, b = fp[two], fp[two + 1]
            ok = linked(a, b)
            found.update(zip(np.maximum(a[ok], b[ok]).tolist(), np.minimum(a[ok], b[ok]).tolist(), strict=True))
            wide = inner[stop[inner] - first[inner] > 2]
            for s in [0, *wide.tolist(), *([len(first) - 1] if len(first) > 1 else [])]:
                members = fp[first[s] : stop[s]]
                if lists[first[s]] != of:
                    close()
                    of, held, large = lists[first[s]], [], False
                held.append(members)
                if not large and sum(map(len, held)) > LARGE_POSTING:
                    large = True
                if large:
                    members = np.concatenate(held)
                    held.clear()
                    yield emit(np.c_[members, members], 1, of)
            if len(found) > 50_000:
                yield emit(list(found), 0)
                found.clear()
        close()
        if found:
            yield emit(list(found), 0)

    return index.mapInArrow(run, "kind tinyint, list bigint, a bigint, b bigint")


def expand(large: DataFrame, sets: np.ndarray) -> DataFrame:
    """(kind, point, fp) for the members of large lists: all points within half of MAX_BITS of a member, its listed
    bytes kept. Two members are within MAX_BITS exactly if they have such a point in common, so rows stay in
    proportion to members, and no point has more members than there are points around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists, fp = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for kind in np.unique(lists >> 32):
                    if kind not in flips:
                        free = [8 * p + i for p in range(POSITIONS) if p not in sets[kind] for i in range(8)]
                        masks = [sum(1 << i for i in c) for n in range(MAX_BITS // 2 + 1) for c in itertools.combinations(free, n)]
                        flips[kind] = np.array(masks, np.uint64).view(np.int64)
                    own = fp[lists >> 32 == kind]
                    points = own[:, None] ^ flips[kind][None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(points.size, kind, np.int64)), pa.array(points.ravel()), pa.array(np.repeat(own, points.shape[1]))], names=["kind", "point", "fp"])

    return large.mapInArrow(run, "kind bigint, point bigint, fp bigint")


def neighbours(points: DataFrame) -> DataFrame:
    """(a, b): each member of a point tied to the one before it, from points sorted by kind, point and fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.empty((3, 0), np.int64)
        for batch in batches:
            rows = np.c_[last, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])]
            same = (rows[:2, 1:] == rows[:2, :-1]).all(0) & (rows[2, 1:] != rows[2, :-1])
            pairs = np.unique(np.c_[rows[2, 1:][same], rows[2, :-1][same]], axis=0)
            last = rows[:, -1:]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return points.mapInArrow(run, "a bigint, b bigint")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that join all fingerprints within MAX_BITS bits into the same components."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = position_sets(LEAST_SHARED if distinct.count() >= WIDE_FROM else LEAST_SHARED - 1)
    index = postings(distinct, sets).repartition(parts, "list").sortWithinPartitions("list")
    found = materialize(links(index), "links")
    plain = found.filter("kind = 0").select("a", "b").distinct()
    large = found.filter("kind = 1").select("list", F.col("a").alias("fp"))
    if large.isEmpty():
        return plain
    points = expand(large.repartition(4 * parts, "fp", "list"), sets)
    return plain.unionByName(neighbours(points.repartition(4 * parts, "kind", "point").sortWithinPartitions("kind", "point", "fp"))).distinct()


def grouped(prints: DataFrame) -> DataFrame:
    """(key, fp, component_id) of a written table (key, fp): the least key of the fingerprint's component.

    Copies of a fingerprint are folded first, so a group of copies costs one entry; fingerprints with very many rows,
    and components of very many fingerprints, are met by bounded broadcasts instead of in one task.
    """
    own = materialize(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    edges = fingerprint_links(own)
    roots = materialize(components(edges).withColumnRenamed("node", "fp"), "roots")
    members = roots.count()
    tied = materialize(own.join(roots, "fp"), "tied")
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    ids = join_hot(tied, least, "root", "m", members).select("fp", "component_id", "n")
    alone = own.join(roots.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"), "n")
    table = materialize(ids.unionByName(alone), "ids")
    for done in (roots, tied, own):
        discard(done)
    return join_hot(prints, table, "fp", "n", table.agg(F.sum("n")).first()[0] or 0).select("key", "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every row; fingerprints link at MAX_BITS or fewer differing bits.

    Rows without a word (null, empty or white texts) have fingerprint zero and link like others. component_id is the
    smallest key reachable (null if all are null); repeated rows each get a row; texts of any length are read whole;
    other columns, whatever their names, are left out; an empty table gives an empty table.
    """
    prints = materialize(fingerprints(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "key", "text"), "prints")
    return grouped(prints).select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each near-duplicate component, with the columns of ``docs``: that of the smallest key
    (rows without one come last), among equal keys that of the smallest hash of the whole row.

    So rows that share a key but not a component are both kept, equal rows are folded to one, and reruns agree.
    """
    name = F.struct(F.col(f"`{key}`").isNull().alias("last"), F.col(f"`{key}`").alias("key"), row_hash(docs, 1).alias("h1"), row_hash(docs, 2).alias("h2"))
    marked = docs.select(name.alias("__key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text}`").alias("__text"))
    prints = materialize(fingerprints(marked, "__key", "__text").withColumnRenamed("__key", "key"), "prints")
    kept = materialize(grouped(prints).filter("key = component_id").groupBy("key").agg(F.count(F.lit(1)).alias("n")), "kept")
    found = marked.join(kept, marked["__key"] == kept["key"])
    once = found.filter("n = 1").select("__row.*")
    if kept.filter("n > 1").isEmpty():
        return once
    return once.unionByName(found.filter("n > 1").groupBy("__key").agg(F.first("__row").alias("__row")).select("__row.*"))
