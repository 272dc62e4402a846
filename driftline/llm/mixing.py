"""Mixing sources to target weights by fixed-length blocks, multinomial shard counts and index permutations."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import word_array
from .shared import checked, discard, materialize, row_hash, with_running_sum

WEIGHTS, SHARE, MOST_TIMES = (5, 2, 1), 1.5, 2
#: Words in a block, blocks in an output shard (on average), rows in a chunk of a running sum (on average).
BLOCK, SHARD_SLOTS, CHUNK_ROWS, SEED = 1024, 512, 50_000, 11
#: Shards whose counts are drawn together, after those of the groups; shards that one task deals at most.
GROUP_SHARDS, TASK_SHARDS = 1024, 64


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int, backwards: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, by a four-round network that walks on while it is outside."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _mix64(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        high, low = out[todo] >> half, out[todo] & mask
        for k in keys[::-1] if backwards else keys:
            if backwards:
                high, low = low ^ (_mix64(high ^ k) & mask), high
            else:
                high, low = low, high ^ (_mix64(low ^ k) & mask)
        out[todo] = high << half | low
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _key(sid: int, epoch: int) -> int:
    return (sid * 1_000_003 + epoch) * 97 + SEED


def slots_of(size: int, want: int, sid: int, block: int) -> tuple[int, int, int]:
    """Blocks of ``block`` words of a source, slots that draw ``want`` words from it, and the words that the last slot takes."""
    blocks = -(-size // block)
    if want <= 0 or blocks == 0:
        return blocks, 0, 0
    epochs, rest = divmod(want, size)
    short = size - (blocks - 1) * block
    if rest == 0:
        return blocks, epochs * blocks, block
    at = int(permute(np.array([blocks - 1]), blocks, _key(sid, epochs), backwards=True)[0])
    before = at * block
    if rest <= before:
        more, base = -(-rest // block), 0
    elif rest <= before + short:
        return blocks, epochs * blocks + at + 1, rest - before
    else:
        base = before + short
        more = -(-(rest - base) // block)
    last = rest - base - (more - 1) * block
    return blocks, epochs * blocks + more + (at + 1 if base else 0), last


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, sid, source_size, target) from (source, size): weights by code point, targets capped at MOST_TIMES.

    Ranks come from range partitions and their counts; capping takes a few sums over the table of sources, of which
    only the sums come to the driver.
    """
    grouped = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = materialize(grouped.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("__p", F.spark_partition_id()), "sources")
    per = ranged.groupBy("__p").count()
    starts = per.select("__p", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(F.col("source").asc_nulls_last()))
    ranks = ranged.withColumn("sid", inside - 1).join(checked(starts), "__p").withColumn("sid", (F.col("sid") + F.col("__start")).cast("bigint"))
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    table = materialize(ranks.select("source", "sid", "source_size", weights.cast("double").alias("__weight"), (MOST_TIMES * F.col("source_size")).cast("double").alias("__cap")), "sources")
    total = SHARE * (table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("__cap") <= F.lit(level) * F.col("__weight")
        capped, open_weight = table.agg(F.sum(F.when(full, F.col("__cap"))), F.sum(F.when(~full, F.col("__weight")))).first()
        if not open_weight:
            break
        raised = (total - (capped or 0.0)) / open_weight
        if raised <= level:
            break
        level = raised
    return table.select("source", "sid", "source_size", F.least("__cap", F.lit(level) * F.col("__weight")).alias("target"))


def drawn_slots(targets: DataFrame, shards: int) -> DataFrame:
    """(shard, sid, k, block, words): the blocks that each output shard takes, and how many of a block's words.

    A source's slots are as many as its target asks for. How many of them a shard gets is a multinomial draw over the
    shards, the same for all sources; which blocks these are follows from the slots' numbers k by the source's
    permutation for each pass over it. The draw is made for groups of shards and then within each group, which gives
    the same law and never holds all shards at once. Only a source's last slot takes less than its block.
    """
    each = GROUP_SHARDS
    sizes = np.full(-(-shards // each), each)
    sizes[-1] = shards - each * (len(sizes) - 1)

    def rows(frame: pd.DataFrame, at: np.ndarray) -> Iterator[pd.DataFrame]:
        for low in range(0, len(at), 100_000):
            yield frame.iloc[at[low : low + 100_000]]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for sid, size, target in zip(frame.sid, frame.source_size, frame.target, strict=True):
                blocks, slots, last = slots_of(int(size), min(round(target), MOST_TIMES * int(size)), int(sid), BLOCK)
                counts = np.random.default_rng([SEED, int(sid)]).multinomial(slots, sizes / shards)
                made = pd.DataFrame({"sid": sid, "blocks": blocks, "slots": slots, "last": last, "shards": np.arange(len(sizes)), "first": np.cumsum(counts) - counts, "count": counts})
                yield from rows(made, np.flatnonzero(counts))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                n = int(sizes[r.shards])
                counts = np.random.default_rng([SEED, int(r.sid), int(r.shards) + 1]).multinomial(int(r.count), np.full(n, 1 / n))
                made = pd.DataFrame({"sid": r.sid, "blocks": r.blocks, "slots": r.slots, "last": r.last, "shard": int(r.shards) * each + np.arange(n), "first": int(r.first) + np.cumsum(counts) - counts, "count": counts})
                yield from rows(made, np.flatnonzero(counts))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                for at in range(int(r.first), int(r.first + r.count), 100_000):
                    k = np.arange(at, min(at + 100_000, int(r.first + r.count)))
                    block = np.empty(len(k), np.int64)
                    for epoch in np.unique(k // r.blocks):
                        own = k // r.blocks == epoch
                        block[own] = permute(k[own] % r.blocks, int(r.blocks), _key(int(r.sid), int(epoch)))
                    yield pd.DataFrame({"shard": r.shard, "sid": r.sid, "k": k, "block": block, "words": np.where(k == r.slots - 1, r.last, BLOCK)})

    parts = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = "sid bigint, blocks bigint, slots bigint, last bigint, {} bigint, first bigint, count bigint"
    groups = targets.select("sid", "source_size", "target").mapInPandas(deal, drawn.format("shards"))
    if len(sizes) > 1:
        groups = groups.repartition(parts, "shards")
    dealt = groups.mapInPandas(split, drawn.format("shard"))
    return dealt.repartition(max(parts, shards // TASK_SHARDS), "shard").mapInPandas(place, "shard bigint, sid bigint, k bigint, block bigint, words bigint")


def placed_rows(sizes: DataFrame) -> tuple[DataFrame, int]:
    """The rows of a written table (source, size, h1, h2, ...) with their source's sid, size and target, and at: the
    words of the source before them; and the number of output shards.

    A source's rows lie in the order of their hashes, so a row's place hangs on its content and not on files or tasks.
    """
    targets = materialize(source_targets(sizes.select("source", "size")), "targets")
    words, rows = sizes.agg(F.sum("size"), F.count(F.lit(1))).first()
    named = targets.select(F.col("source").alias("__source"), "sid", "source_size", "target")
    known = sizes.join(checked(named), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    chunks = max(4 * int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / CHUNK_ROWS))
    return with_running_sum(known, ["sid"], [F.col("h1"), F.col("h2")], F.col("size"), "at", chunks), max(1, -(-int(SHARE * (words or 0)) // (BLOCK * SHARD_SLOTS)))


def joined_blocks(placed: DataFrame, shards: int, how: str) -> DataFrame:
    """The rows with words of ``placed`` (sid, source_size, target, size, at, ...) joined by block with the slots that
    take their words: shard, k, low and high, the row's words that the slot takes. ``how`` left keeps rows that no
    slot takes, with nulls."""
    end = F.col("at") + F.col("size")
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence((F.col("at") / BLOCK).cast("bigint"), ((end - 1) / BLOCK).cast("bigint"))))
    # the slots grow with the words, which their plan can't tell from the small table of sources: no broadcast
    targets = placed.select("sid", "source_size", "target").distinct()
    drawn = drawn_slots(targets, shards).hint("merge")
    start = F.col("block") * BLOCK
    taken = pieces.join(drawn, ["sid", "block"], how).withColumns({"low": F.greatest(F.col("at"), start) - F.col("at"), "high": F.least(end, start + F.coalesce("words", F.lit(0))) - F.col("at")})
    return taken.filter("high > low") if how == "inner" else taken


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken) for every row: the words of it that the mix takes, repeats counted.

    A null or wordless text has size 0 and is not taken; null sources are one source, ranked last; repeated rows are
    rows of their own; other columns, whatever their names, are left out; an empty table gives an empty one. A source's
    taken words are its target to the nearest word, and no word is taken more than MOST_TIMES times. The result is the
    same for any order and files of the rows.
    """
    mine = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source"))
    sizes = materialize(mine.select("key", "source", F.size(word_array(F.col("text"))).cast("long").alias("size"), row_hash(mine, 1).alias("h1"), row_hash(mine, 2).alias("h2")), "sizes")
    placed, shards = placed_rows(sizes)
    placed = materialize(placed.select("key", "sid", "size", "source_size", "target", "at"), "placed")
    names = ["key", "size", "source_size", "target"]
    words = F.sum(F.greatest(F.lit(0), F.col("high") - F.col("low")))
    taken = joined_blocks(placed, shards, "left").groupBy("sid", "at", *names).agg(F.coalesce(words, F.lit(0)).cast("long").alias("taken")).select(*names, "taken")
    every = taken.unionByName(placed.filter("size = 0").select(*names, F.lit(0).cast("long").alias("taken")))
    return every.withColumnRenamed("key", key)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def blocks(docs: DataFrame, text: str = "text", source: str = "source", length: str | None = "n_chars") -> DataFrame:
    """The mix: (shard, slot, start, row) for each part of a document that a shard's slot takes.

    row has the columns of ``docs`` with the part's words in place of the text; a document that lies in one block
    whole keeps its text as it is. ``length`` names a column that is set to the length of the new text. slot puts a
    shard's blocks in a pseudorandom order, start the parts of a block in that of the source.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), row_hash(docs, 1).alias("h1"), row_hash(docs, 2).alias("h2"))
    sizes = materialize(docs.select(F.col(f"`{source}`").alias("source"), F.size(word_array(F.col(f"`{text}`"))).cast("long").alias("size"), row_hash(docs, 1).alias("h1"), row_hash(docs, 2).alias("h2")), "sizes")
    placed, shards = placed_rows(sizes)
    placed = materialize(placed.select("h1", "h2", "sid", "size", "source_size", "target", "at"), "placed")
    part = F.struct("shard", F.xxhash64("shard", "sid", "k").alias("slot"), (F.col("at") + F.col("low")).alias("start"), "low", "high")
    # equal rows have the same hashes: one of them stands for all, with the parts of all
    taken = joined_blocks(placed, shards, "inner").groupBy("h1", "h2").agg(F.max("size").alias("size"), F.collect_list(part).alias("parts"))
    copies = materialize(sizes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2"), "copies")
    known = rows.join(taken, ["h1", "h2"])
    if not copies.isEmpty():
        copies = checked(copies)
        folded = known.join(copies, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("row", "size", "parts")])
        known = known.join(copies, ["h1", "h2"], "left_anti").unionByName(folded)
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                columns = some.column(0).flatten()
                take, texts, where = [], [], []
                for i, (t, n, parts) in enumerate(zip(columns[at].to_pylist(), some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)):
                    ends = None
                    for p in parts:
                        if (p["low"], p["high"]) != (0, n):
                            ends = ends or [m.span() for m in _WORD.finditer(t)]
                        texts.append(t if (p["low"], p["high"]) == (0, n) else t[ends[p["low"]][0] : ends[p["high"] - 1][1]])
                        take.append(i)
                        where.append((p["shard"], p["slot"], p["start"]))
                made = [pa.array(texts, c.type) if i == at else pa.array([len(x) for x in texts], c.type) if names[i] == length else c.take(pa.array(take, pa.int64())) for i, c in enumerate(columns)]
                places = [pa.array(x, pa.int64()) for x in (zip(*where, strict=True) if where else ((), (), ()))]
                yield pa.RecordBatch.from_arrays([*places, pa.StructArray.from_arrays(made, fields=list(some.schema.field(0).type))], names=["shard", "slot", "start", "row"])

    kinds = dict(rows.dtypes)["row"]
    return known.select("row", "size", "parts").mapInArrow(run, f"shard bigint, slot bigint, start bigint, row {kinds}")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", length: str | None = "n_chars") -> DataFrame:
    """The mix with the columns of ``docs``, shard by shard and in the order of each shard's slots.

    Rows without words are not taken, an empty table gives an empty one, and columns of ``docs`` may have any names.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks(docs, text, source, length).repartition(parts, "shard").sortWithinPartitions("shard", "slot", "start").select("row.*")
