"""Epochs as tables: views, overlays, publication, closing, growth and recovery. Every step is a pure function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.rank import numbered
from driftline.operators.scheduling import BRIDGED, LEGACY, NATIVE, RESOLVING


def first_writes(overlay: DataFrame) -> DataFrame:
    """(item_id, vec, gen) of the first write of each item: later ones are ignored."""
    return overlay.groupBy("item_id").agg(F.min_by(F.struct("vec", "gen"), F.struct("gen", "seq")).alias("o")).select("item_id", "o.vec", "o.gen")


def resolve(view: DataFrame, overlay: DataFrame, frozen: int, version: int) -> DataFrame:
    """(item_id, route, best, exact) of a view (item_id, vec, space, mapped, native): routing uses overlay writes up to
    the frozen generation, ranking those of any; only writes of the view's version are exact."""
    own = first_writes(overlay.filter(F.col("version") == version)).select("item_id", F.col("vec").alias("o"), "gen")
    base = F.when(F.col("space") == "old", F.col("mapped")).otherwise(F.col("vec"))
    joined = view.join(own, "item_id", "left")
    route = F.coalesce(F.when(F.col("gen") <= frozen, F.col("o")), base)
    return joined.select("item_id", route.alias("route"), F.coalesce("o", base).alias("best"), (F.col("native") | F.col("o").isNotNull()).alias("exact"))


def claim(items: DataFrame, wanted: DataFrame, incarnation: int, expires: float) -> tuple[DataFrame, DataFrame]:
    """The items after claiming the wanted ones that are claimable, and their new leases (item_id, fence, expires)."""
    free = items.filter(F.col("state").isin(LEGACY, BRIDGED)).join(wanted.select("item_id").distinct(), "item_id", "left_semi").select("item_id")
    leases = numbered(free, [F.col("item_id")], "__n").withColumn("fence", F.shiftleft(F.lit(incarnation).cast("bigint"), 40).bitwiseOR(F.col("__n"))).drop("__n").withColumn("expires", F.lit(expires))
    mark = free.withColumn("__got", F.lit(True))
    after = items.join(mark, "item_id", "left").withColumn("state", F.when(F.col("__got"), RESOLVING).otherwise(F.col("state"))).drop("__got")
    return after, leases


def land(items: DataFrame, accepted: DataFrame) -> DataFrame:
    """The items after accepted publications: native from now on."""
    mark = accepted.filter("accepted").select("item_id", F.lit(True).alias("__in")).distinct()
    return items.join(mark, "item_id", "left").withColumn("state", F.when(F.col("__in"), NATIVE).otherwise(F.col("state"))).drop("__in")


def close_epoch(view: DataFrame, overlay: DataFrame, frozen: int, version: int) -> DataFrame:
    """The next view: written vectors up to the new frozen generation take the place of bridged ones."""
    own = first_writes(overlay.filter((F.col("version") == version) & (F.col("gen") <= frozen))).select("item_id", F.col("vec").alias("o"))
    got = F.col("o").isNotNull()
    return view.join(own, "item_id", "left").select("item_id", F.coalesce("o", "vec").alias("vec"), F.when(got, "native").otherwise(F.col("space")).alias("space"), F.when(~got, F.col("mapped")).alias("mapped"), (F.col("native") | got).alias("native"))


def rotate(view: DataFrame) -> DataFrame:
    """The same view with bridged images in place of old vectors; routing values don't change."""
    old = F.col("space") == "old"
    return view.select("item_id", F.when(old, F.col("mapped")).otherwise(F.col("vec")).alias("vec"), F.when(old, "mapped").otherwise(F.col("space")).alias("space"), "mapped", "native")


def insert(items: DataFrame, vectors: DataFrame, epoch: int) -> DataFrame:
    """New items get ids after the largest and are visible from the next epoch."""
    last = items.agg(F.coalesce(F.max("item_id"), F.lit(-1)).alias("last"))
    new = numbered(vectors, [F.col("key")], "r").join(F.broadcast(last)).select((F.col("last") + F.col("r")).cast("bigint").alias("item_id"), F.lit(NATIVE).alias("state"), F.lit(False).alias("deleted"), F.lit(epoch + 1).alias("since"))
    return items.unionByName(new)


def delete(items: DataFrame, ids: DataFrame) -> DataFrame:
    mark = ids.select("item_id", F.lit(True).alias("__gone")).distinct()
    return items.join(mark, "item_id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False))).drop("__gone")


def recover(log: DataFrame, native: DataFrame) -> DataFrame:
    """(item_id, gen, seq, frozen): the writes that the log's sound records publish, from records (pos, seq, kind, gen,
    offset, cnt, epoch) and the native log (item_id, gen, offset). ``frozen``: in the last committed view."""
    sizes = log.filter("kind = 'native'").groupBy("gen").agg(F.max(F.col("offset") + F.col("cnt")).alias("size"), F.max("seq").alias("seq"))
    committed = log.filter("kind = 'epoch'").agg(F.coalesce(F.max(F.struct("seq", "gen"))["gen"], F.lit(-1)).alias("committed"))
    kept = native.join(sizes, "gen").filter(F.col("offset") < F.col("size")).join(F.broadcast(committed))
    return kept.select("item_id", "gen", "seq", (F.col("gen") <= F.col("committed")).alias("frozen"))


def pending_merge(log: DataFrame) -> DataFrame:
    """(epoch): committed epochs whose merge the log doesn't hold yet, to be done again."""
    return log.filter("kind = 'epoch'").select("epoch").join(log.filter("kind = 'merged'").select("epoch"), "epoch", "left_anti")


def resolve_round(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """Candidates (qid, item_id, d, exact, w, d_star) after the chosen ones were encoded: exact wherever they occur."""
    done = chosen.select("item_id").distinct().withColumn("__done", F.lit(True))
    joined = candidates.join(done, "item_id", "left").withColumn("__done", F.coalesce("__done", F.lit(False)))
    return joined.withColumns({"d": F.when(F.col("__done"), F.col("d_star")).otherwise(F.col("d")), "exact": F.col("exact") | F.col("__done")}).drop("__done")


def retire(view: DataFrame, overlay: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """What the next migration starts from: the vectors that are exact (item_id, vec), and the items that are not yet
    and go over directly."""
    last = overlay.agg(F.coalesce(F.max("gen"), F.lit(0))).first()[0]
    final = close_epoch(view, overlay, int(last), version)
    return final.filter("native").select("item_id", "vec"), final.filter("not native").select("item_id")


def snapshot(tables: dict[str, DataFrame], root: str, seq: int) -> str:
    """Write the tables under root/seq=N and then a marker; a snapshot without its marker doesn't count."""
    spark, path = next(iter(tables.values())).sparkSession, f"{root}/seq={seq:012d}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(seq, sorted(tables))], "seq bigint, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/committed")
    return path


def restore(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the last snapshot that has its marker."""
    said = spark.read.schema("seq bigint, tables array<string>").json(f"{root}/seq=*/committed").orderBy(F.desc("seq")).first()
    return {name: spark.read.parquet(f"{root}/seq={said.seq:012d}/{name}") for name in said.tables}


def update(items: DataFrame, changed: DataFrame, epoch: int) -> DataFrame:
    """Items after some were replaced: the old rows are deleted and the new vectors get new ids, seen from the next
    epoch on. ``changed`` is (item_id, key), key ordering the new ids."""
    return insert(delete(items, changed), changed.select("key"), epoch)


def headroom(items: DataFrame, capacity: int) -> DataFrame:
    """One row, room: how many items may still be inserted before the next segments are needed."""
    return items.agg((F.lit(capacity) - F.count(F.lit(1)) % F.lit(capacity)).alias("room"))


def switch_generation(overlay: DataFrame) -> DataFrame:
    """One row, gen: the generation that writes go to after the present one is closed."""
    return overlay.agg((F.coalesce(F.max("gen"), F.lit(-1)) + 1).alias("gen"))


def initial_view(items: DataFrame, bridged: DataFrame) -> DataFrame:
    """The view that a migration begins with: old vectors (item_id, vec) and their images (item_id, mapped), none
    native."""
    return items.join(bridged, "item_id", "left").select("item_id", "vec", F.lit("old").alias("space"), "mapped", F.lit(False).alias("native"))


def next_view(view: DataFrame, overlay: DataFrame, inserted: DataFrame, deleted: DataFrame, frozen: int, version: int) -> DataFrame:
    """The view of the next epoch: writes up to ``frozen`` replace bridged vectors, inserted natives (item_id, vec) are
    appended, and flags say what is deleted. An inserted id that the view has already is an error."""
    closed = close_epoch(view, overlay, frozen, version)
    both = inserted.join(view.select("item_id", F.lit(True).alias("known")), "item_id", "left")
    fresh = both.filter(F.when(F.col("known"), F.raise_error("an inserted id is in the view already").cast("boolean")).otherwise(True))
    every = closed.unionByName(fresh.select("item_id", "vec", F.lit("native").alias("space"), F.lit(None).cast(dict(closed.dtypes)["mapped"]).alias("mapped"), F.lit(True).alias("native")))
    return every.join(deleted.select("item_id", F.lit(True).alias("gone")).distinct(), "item_id", "left").withColumn("deleted", F.coalesce("gone", F.lit(False))).drop("gone")


def merge_overlay(view: DataFrame, overlay: DataFrame, merged: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """The view with the writes of generations that were frozen but not merged yet, and the mask (gen) of all that are
    merged then. ``merged`` is (gen)."""
    rest = overlay.join(merged.select("gen").distinct(), "gen", "left_anti")
    last = rest.agg(F.coalesce(F.max("gen"), F.lit(-1))).first()[0]
    return close_epoch(view, rest, int(last), version), merged.select("gen").unionByName(rest.select("gen")).distinct()


def close_and_log(view: DataFrame, overlay: DataFrame, adjacency: DataFrame, staged: DataFrame, epoch: int, frozen: int, version: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The steps that close an epoch, as tables: the next view, the adjacency with the staged lists (epoch, src, nbrs) of
    this epoch, those of later ones that are carried over, and the log's records (kind, epoch) in their order."""
    rotated = rotate(view)
    after = close_epoch(rotated, overlay, frozen, version)
    now = staged.filter(F.col("epoch") <= epoch)
    lists = adjacency.join(now.select("src"), "src", "left_anti").select("src", "nbrs").unionByName(now.select("src", "nbrs"))
    kinds = ["rotated", "epoch", "merged", "edges"]
    records = view.sparkSession.range(len(kinds)).select((F.col("id") + 1).alias("seq"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") + 1).cast("int")).alias("kind"), F.lit(epoch).alias("epoch"))
    return after, lists, staged.filter(F.col("epoch") > epoch), records


def redo(log: DataFrame, adjacency: DataFrame, staged: DataFrame) -> DataFrame:
    """Adjacency (src, nbrs) after a crash: the staged lists (epoch, src, nbrs) of epochs that the log closed are applied
    again, those of epochs that it didn't close are dropped; the last epoch's list of a node counts."""
    closed = log.filter("kind = 'epoch'").select("epoch").distinct()
    last = staged.join(closed, "epoch", "left_semi").groupBy("src").agg(F.max_by("nbrs", "epoch").alias("nbrs"))
    return adjacency.join(last.select("src"), "src", "left_anti").select("src", "nbrs").unionByName(last)


class Crash(RuntimeError):
    """Raised at a crash point."""


CRASH_POINTS = ("publish", "rotate", "stage", "switch", "merge", "edges")


def crash_at(point: str | None):
    """A hook for tests: called with the name of a step, it raises at ``point`` and lets all others pass."""
    if point is not None and point not in CRASH_POINTS:
        raise ValueError(f"no crash point {point}")

    def reached(step: str) -> None:
        if step == point:
            raise Crash(step)

    return reached


def migrate(items: DataFrame, view: DataFrame, truth: DataFrame, per_step: int, steps: int, order: str, reached=crash_at(None)) -> list[tuple[int, DataFrame, DataFrame]]:
    """The loop of a migration over a bounded number of steps: pick by ``order``, encode (the vectors of ``truth``),
    publish, close the epoch. Gives (step, items, view) after each; every step is a table's plan on the one before."""
    from driftline.operators.scheduling import pick

    out = []
    for step in range(steps):
        chosen = pick(items, per_step, order).select("item_id")
        reached("publish")
        overlay = truth.join(chosen, "item_id", "left_semi").select("item_id", "vec", F.lit(step).alias("gen"), F.lit(0).alias("seq"), F.lit(1).alias("version"))
        items = land(items, chosen.withColumn("accepted", F.lit(True)))
        reached("rotate")
        view = close_epoch(rotate(view), overlay, step, 1)
        reached("switch")
        out.append((step, items, view))
    return out
