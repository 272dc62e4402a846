"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, merged over shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checked, materialize

#: Neighbours on the lowest layer and above; list sizes while building and searching; points expanded at a time.
LOW, HIGH, BUILD_LIST, SEARCH_LIST, AT_ONCE = 32, 16, 64, 96, 4
#: Neighbours by which a row may overflow while building before it is spread anew.
SLACK = 16
#: Rows of a shard at most (on average), least number of shards, queries that go past one copy of a shard's graph.
SHARD_ROWS, LEAST_SHARDS, QUERY_PART = 20_000, 3, 200_000
#: A length band with fewer rows than this for each of the LEAST_SHARDS takes fewer shards.
LEAST_ROWS = 1_000
#: Lengths in a shard differ by 2 ** BAND_BITS at most, so float32 tells its distances apart; 1 lies amid a band.
BAND_BITS = 4
BATCH = 256


def _nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(-1)[:, None] + (y * y).sum(-1)[None, :] - 2 * x @ y.T, 0)


def beam(points: np.ndarray, adjacency: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many queries at a time over flat neighbour rows (-1: none): ids and squared distances,
    nearest first, in ``width`` columns (id -1 where fewer were found). ``start`` holds each query's entry points."""
    q, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((q, len(points) + 1), bool)
    seen[:, -1] = True
    norm = (points * points).sum(1)
    own = (queries * queries).sum(1)[:, None]

    def far(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = own[at] + norm[ids] - 2 * np.matmul(points[ids], queries[at][:, :, None])[:, :, 0]
        return np.where(ids < 0, np.inf, np.maximum(d, 0)).astype(np.float32)

    ids = np.full((q, width), -1)
    dist = np.full((q, width), np.inf, np.float32)
    ids[:, : start.shape[1]] = start
    dist[:, : start.shape[1]] = far(start, np.arange(q))
    seen[rows, start] = True
    done = ids < 0
    live = np.arange(q)
    while len(live):
        open_dist = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(open_dist, AT_ONCE - 1, axis=1)[:, :AT_ONCE] if width > AT_ONCE else np.argsort(open_dist, axis=1)[:, :AT_ONCE]
        some = np.isfinite(np.take_along_axis(open_dist, pick, 1))
        going = some.any(1)
        live, pick, some = live[going], pick[going], some[going]
        if not len(live):
            break
        at = live[:, None]
        done[at, pick] |= some
        found = np.where(some[:, :, None], adjacency[ids[at, pick]], -1).reshape(len(live), -1)
        found = np.where(seen[at, found], -1, found)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        keep = int((found >= 0).sum(1).max(initial=0))
        if not keep:
            continue
        found = -np.sort(-found, axis=1)[:, :keep]
        seen[at, found] = True
        d = far(found, live)
        all_ids, all_dist = np.c_[ids[live], found], np.c_[dist[live], d]
        all_done = np.c_[done[live], found < 0]
        best = np.argpartition(all_dist, width - 1, axis=1)[:, :width]
        ids[live], dist[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_dist, all_done))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def spread(points: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` neighbours for each row, given nearest first: those nearer to one already taken than to the row's
    own point are passed over; room that is left goes to the nearest of these."""
    n, width = ids.shape
    if not width or not n:
        return np.full((n, most), -1)
    around = points[ids]
    sq = np.einsum("ijk,ijk->ij", around, around)
    cross = np.matmul(around, around.transpose(0, 2, 1))
    cross *= -2
    cross += sq[:, :, None]
    cross += sq[:, None, :]
    taken = np.zeros((n, width), bool)
    near = np.full((n, width), np.inf, np.float32)
    count = np.zeros(n, int)
    for j in range(width):
        ok = np.flatnonzero((ids[:, j] >= 0) & (dist[:, j] < near[:, j]) & (count < most))
        taken[ok, j] = True
        count[ok] += 1
        near[ok] = np.minimum(near[ok], cross[ok, j])
    rank = np.where(ids < 0, 3 * width, np.where(taken, 0, width) + np.arange(width))
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _respread(points: np.ndarray, rows: np.ndarray, pool: np.ndarray, most: int) -> np.ndarray:
    """The pools of the points ``rows``, in any order, spread to ``most`` neighbours."""
    d = points[pool] - points[rows][:, None, :]
    d = np.where(pool < 0, np.inf, np.einsum("ijk,ijk->ij", d, d)).astype(np.float32)
    order = np.argsort(d, axis=1, kind="stable")
    return spread(points, np.take_along_axis(pool, order, 1), np.take_along_axis(d, order, 1), most)


def _link_back(points: np.ndarray, adjacency: np.ndarray, new: np.ndarray, most: int) -> None:
    """Add the reverse of the new points' links. Rows have room for more than ``most`` neighbours, and only those that
    overflow are spread anew."""
    room = adjacency.shape[1]
    src, dst = np.repeat(new, most), adjacency[new, :most].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    known = (adjacency[dst] == src[:, None]).any(1)
    src, dst = src[~known], dst[~known]
    if not len(dst):
        return
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    rows, first, extra = np.unique(dst, return_index=True, return_counts=True)
    held = (adjacency[rows] >= 0).sum(1)
    fits = np.repeat(held + extra <= room, extra)
    at = np.repeat(held - first, extra) + np.arange(len(dst))
    adjacency[dst[fits], at[fits]] = src[fits]
    over = np.flatnonzero(held + extra > room)
    for some in np.array_split(over, max(1, len(over) // 512)):
        if len(some):
            step = np.arange(int(extra[some].max()))
            more = np.where(step < extra[some][:, None], src[np.minimum(first[some][:, None] + step, len(src) - 1)], -1)
            pool = np.c_[adjacency[rows[some]], more]
            adjacency[rows[some]] = -1
            adjacency[rows[some], :most] = _respread(points, rows[some], pool, most)


def build(points: np.ndarray, seed: int = 5) -> tuple[np.ndarray, list[np.ndarray]]:
    """The points of each layer above the lowest (from the top), and flat neighbour rows of each layer from the top.

    Points go in by batches: each is searched for in the graph so far and among its batch, then linked both ways.
    """
    n = len(points)
    level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(HIGH)).astype(int), 8)
    members = [np.flatnonzero(level >= k) for k in range(int(level.max(initial=0)) + 1)]
    layers = []
    for k, own in enumerate(members):
        most = HIGH if k else LOW
        x = points[own]
        rows = np.full((len(own), most + SLACK), -1)
        for a in range(0, len(own), BATCH):
            new = np.arange(a, min(a + BATCH, len(own)))
            inside = _nearest(x[new], x[new]).astype(np.float32)
            np.fill_diagonal(inside, np.inf)
            ids, dist = np.broadcast_to(new, inside.shape), inside
            if a:
                entry = np.sort(np.random.default_rng(seed + a).choice(a, min(a, 16), replace=False))
                first = entry[np.argsort(_nearest(x[new], x[entry]), axis=1)[:, :4]]
                found, far = beam(x, rows, x[new], first, BUILD_LIST)
                ids, dist = np.c_[found, ids], np.c_[far, dist]
            best = np.argsort(dist, axis=1, kind="stable")[:, :BUILD_LIST]
            ids, dist = np.take_along_axis(ids, best, 1), np.take_along_axis(dist, best, 1)
            rows[new, :most] = spread(x, np.where(np.isfinite(dist), ids, -1), dist, most)
            _link_back(x, rows, new, most)
        full = np.flatnonzero(rows[:, most] >= 0)
        for some in np.array_split(full, -(-len(full) // 512)) if len(full) else ():
            rows[some, :most] = _respread(x, some, rows[some], most)
        layers.append(rows[:, :most].copy())
    return members[:0:-1], layers[::-1]


def search(points: np.ndarray, members: list[np.ndarray], layers: list[np.ndarray], queries: np.ndarray, width: int) -> np.ndarray:
    """Ids found for each query (-1: none), going down the layers and then through the lowest by a wide list."""
    start = np.zeros((len(queries), 1), int)  # by position in the layer's members
    for own, rows, below in zip(members, layers, [*members[1:], np.arange(len(points))], strict=False):
        ids, _ = beam(points[own], rows, queries, start, 8)
        at = own[np.where(ids[:, :2] < 0, ids[:, :1], ids[:, :2])]
        start = np.searchsorted(below, at)
        start[:, 1:][start[:, 1:] == start[:, :1]] = -1
    return beam(points, layers[-1], queries, start, width)[0]


def _flat(v: np.ndarray) -> np.ndarray:
    """Vectors with a further component that makes all as long, so that the largest product is the least distance.

    All are divided by the largest component first, which keeps the order of products and any size within float range.
    """
    v = v / np.abs(v).max()
    sq = (v * v).sum(1)
    return np.c_[v, np.sqrt(np.maximum(sq.max() - sq, 0))].astype(np.float32)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) of the rows that take part: no null key, and a vector that is not null, empty or zero and has only
    finite components. Rows that repeat both count once."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(f"`{key}`").cast("bigint").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0)).distinct()


def band(v: Column) -> Column:
    """The band of a vector's length, by its logarithm; the largest component is taken out first, so squares stay finite."""
    most = F.array_max(F.transform(v, F.abs))
    square = F.aggregate(F.transform(v, lambda x: x / most), F.lit(0.0), lambda a, x: a + x * x)
    return F.floor((F.log2(most) + F.log2(square) / 2) / BAND_BITS + 0.5).cast("int")


def build_index(rows: DataFrame, key: str, vector: str, keep: int) -> DataFrame:
    """A written table with one row per shard: vectors, the ids of each (the ``keep`` smallest) and flat neighbours.

    Rows with the same vector are one point; vectors of unlike numbers of components, and of lengths in unlike bands, go
    to shards of their own.
    """
    ranked = usable(rows, key, vector).withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= keep)
    grouped = ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = materialize(grouped.withColumn("dim", F.size("v")).withColumn("band", band(F.col("v"))), "points")
    need = lambda rows: F.ceil(F.col("n") / F.lit(rows))
    shards = points.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n")).select(F.col("dim").alias("__dim"), F.col("band").alias("__band"), F.greatest(need(SHARD_ROWS), F.least(F.lit(LEAST_SHARDS).cast("bigint"), need(LEAST_ROWS))).alias("shards"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(frame.v.to_numpy()).astype(np.float64)
        order = np.lexsort(v.T[::-1])
        v, ids = v[order], [frame.ids.iloc[i] for i in order]
        members, layers = build(_flat(v))
        parts = [*members, *(x.ravel() for x in layers)]
        return pd.DataFrame([{"dim": v.shape[1], "band": frame.band.iloc[0], "shard": frame.shard.iloc[0], "v": v.tobytes(), "ids": np.concatenate(ids).astype(np.int64).tobytes(), "counts": np.array([len(i) for i in ids], np.int32).tobytes(), "layers": len(layers), "sizes": np.array([len(p) for p in parts], np.int64).tobytes(), "links": np.concatenate(parts).astype(np.int32).tobytes()}])

    keyed = points.join(checked(materialize(shards, "shards")), (F.col("dim") == F.col("__dim")) & (F.col("band") == F.col("__band"))).withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int")).select("v", "ids", "dim", "band", "shard")
    return materialize(keyed.groupBy("dim", "band", "shard").applyInPandas(run, "dim int, band int, shard int, v binary, ids binary, counts binary, layers int, sizes binary, links binary"), "graphs")


class Graph:
    """A shard's row of ``build_index`` as arrays."""

    def __init__(self, g: dict):
        self.v = np.frombuffer(g["v"]).reshape(-1, int(g["dim"]))
        self.counts, self.ids = np.frombuffer(g["counts"], np.int32), np.frombuffer(g["ids"], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        parts = np.split(np.frombuffer(g["links"], np.int32).astype(np.int64), np.cumsum(np.frombuffer(g["sizes"], np.int64))[:-1])
        n = g["layers"]
        self.members = parts[: n - 1]
        self.layers = [x.reshape(-1, LOW if i == n - 1 else HIGH) for i, x in enumerate(parts[n - 1 :])]
        self.points = _flat(self.v)

    def top(self, own: np.ndarray, q: np.ndarray, k: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query_id, vec_id, score) of the best ``k`` found for each of the queries ``q`` with the ids ``own``."""
        even = q / np.abs(q).max(axis=1, keepdims=True)
        even /= np.sqrt((even * even).sum(1, keepdims=True))
        found = search(self.points, self.members, self.layers, np.c_[even, np.zeros(len(q))].astype(np.float32), width)
        for one, vec, row in zip(own, q, found, strict=True):
            row = row[row >= 0]
            score = np.repeat(np.einsum("ij,j->i", self.v[row], vec), self.counts[row])
            n = self.counts[row]
            each = self.ids[np.repeat(self.first[row] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            score, each = score[each != one], each[each != one]
            best = np.lexsort((each, -score))[:k]
            yield np.full(len(best), one), each[best], score[best]


def search_index(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_LIST) -> DataFrame:
    """(query_id, rank, vec_id, score): each query (id, v) is sent to every shard of its number of components, and the
    shards' results are merged. A task loads a graph and lets the queries stream past it."""
    parts = max(1, -(-queries.count() // QUERY_PART))
    place = ["dim", "band", "shard", "part"]
    where = index.select("dim", "band", "shard")
    dealt = queries.withColumn("dim", F.size("v")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).join(checked(where), "dim")
    graphs = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(*place, F.struct(*[F.col(c) for c in index.columns if c != "v"], "v").alias("graph"))
    kind = dict(graphs.dtypes)["graph"]
    both = graphs.select(*place, F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("array<double>").alias("q"), "graph").unionByName(dealt.select(*place, "id", F.col("v").alias("q"), F.lit(None).cast(kind).alias("graph")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = graph = None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], 1)
            new = batch.column(6).is_valid().to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1) | new[1:] | new[:-1]])
            for low, high in zip(edge, np.r_[edge[1:], batch.num_rows], strict=True):
                if new[low]:
                    at, graph = key[low].tolist(), Graph(batch.column(6)[int(low)].as_py())
                    continue
                if graph is None or at != key[low].tolist():
                    raise RuntimeError("queries came before their graph")
                for a in range(low, high, BATCH):
                    some = batch.slice(a, min(BATCH, high - a))
                    q = some.column(5).flatten().to_numpy().reshape(some.num_rows, -1)
                    one, each, score = (np.concatenate(x) for x in zip(*graph.top(some.column(4).to_numpy(), q, k, width), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(each), pa.array(score)], names=["query_id", "vec_id", "score"])

    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts * index.count())
    found = both.repartition(tasks, *place).sortWithinPartitions(*place, F.col("id").asc_nulls_first()).mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows by inner product for each row whose id is divisible by ``every``.

    Rows with a null id, or with a vector that is null, empty, zero or not finite, take no part; a row that repeats id
    and vector counts once, and a query never meets its own id; ties go to the smaller id; vectors of different
    lengths don't meet. An empty table gives an empty table.
    """
    index = build_index(rows, key, vector, k + 1)
    return search_index(index, usable(rows, key, vector).filter(F.col("id") % every == 0), k)
