"""Queries over stored state, fitted maps, steps of a migration and experiment outputs, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import vectors as V
from driftline.functions.scratch import fresh_path, materialize
from driftline.operators import bridges, calibration, evaluation, graph, scheduling, search, workload
from driftline.plans import lifecycle
from driftline.plans.catalog import _OVERLAY, ALPHA_Q, K, WIDTH, _certified, _overlay, _truth, _view, query
from driftline.session import table
from driftline.sources import corpora, store

# ---------------------------------------------------------------- fitted maps


def _shift(scale: float, back: bool = False, width: int = WIDTH) -> list[list[float]]:
    """The signed shift of the derived vectors as columns of a map, times ``scale``, in a frame of ``width``."""
    rows = [[0.0] * width for _ in range(width)]
    for i in range(WIDTH):
        j = (i + WIDTH - 1) % WIDTH if back else (i + 1) % WIDTH
        rows[i][j] = scale * (1.0 if (j if back else i) % 2 == 0 else -1.0)
    return rows


def _maps(b):
    down, up = [[float(j % 3) for j in range(WIDTH)], [float(j % 5) for j in range(WIDTH)]], [[0.5 if i % 2 else 1.0, 1.0 if i % 3 else -1.0] for i in range(WIDTH)]
    rows = [(r, "lowrank", None, down, up, [0.25] * WIDTH) if r == 3 else (r, "procrustes", _shift(1 + r / 10), None, None, [0.25] * WIDTH) for r in range(7)]
    return bridges.check_shapes(b.spark.createDataFrame([*rows, (None, "procrustes", _shift(0.5), None, None, [0.0] * WIDTH)], bridges.SCHEMA), WIDTH, WIDTH)


@query("""WITH i AS (SELECT item_id, region, mapped, list_sum(list_transform(range(64), lambda j: old[j + 1] * (j % 3))) AS s, list_sum(list_transform(range(64), lambda j: old[j + 1] * (j % 5))) AS t FROM x)
SELECT item_id, round(CASE WHEN region = 3 THEN list_sum(list_transform(range(64), lambda j: (j + 1) * (s * CASE WHEN j % 2 = 1 THEN 0.5::DOUBLE ELSE 1 END + t * CASE WHEN j % 3 = 0 THEN -1 ELSE 1 END + 0.25::DOUBLE)))
WHEN region < 7 THEN list_sum(list_transform(range(64), lambda j: (j + 1) * (mapped[j + 1] * (1 + region / 10.0::DOUBLE) + 0.25::DOUBLE))) ELSE list_sum(list_transform(range(64), lambda j: (j + 1) * mapped[j + 1] * 0.5::DOUBLE)) END, 6) AS digest FROM i""")
def bridge_by_region(b):
    path = fresh_path(b.spark, "maps")
    bridges.save_maps(_maps(b), path)
    out = bridges.apply_maps(b.items, bridges.load_maps(b.spark, path, WIDTH, WIDTH), "old", "image")
    return out.select("item_id", F.round(F.aggregate(F.transform("image", lambda v, j: v * (j + 1)), F.lit(0.0), lambda s, v: s + v), 6).alias("digest"))


@query()
def bridge_fit(b):
    fitted = bridges.check_shapes(bridges.fit_rotations(b.corpus.filter("region < 8").select("region", "old", "new")), WIDTH, WIDTH)
    return bridges.apply_maps(b.items, fitted, "old", "image").select("item_id", V.l2(F.col("image"), F.col("mapped")).alias("off"))


@query("""WITH o AS (SELECT qid, list_transform(range(64), lambda i: qvec[(i + 63) % 64 + 1] * CASE WHEN (i + 63) % 64 % 2 = 0 THEN 1 ELSE -1 END) AS v FROM q)
SELECT qid, item_id, d, r FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, item_id) AS r FROM (SELECT qid, item_id, round(list_distance(v, old), 6) AS d FROM o, x)) WHERE r <= 10""")
def adapted_search(b):
    back = b.spark.createDataFrame([(None, "procrustes", _shift(1.0, True, 80), None, None, [0.0] * 80)], bridges.SCHEMA)
    return bridges.adapted_search(b.queries.withColumnRenamed("qvec", "vec"), b.items.select("item_id", F.col("old").alias("vec")), back, K, WIDTH, 80)


@query()
def adapter_fit(b):
    fitted = bridges.adapter(b.corpus.select("old", "new"), 80)
    found = bridges.adapt(b.queries.withColumnRenamed("qvec", "vec"), fitted, "vec", WIDTH, 80)
    return found.join(b.items.select(F.col("item_id").alias("qid"), "old"), "qid").select("qid", V.l2(F.col("vec"), F.col("old")).alias("off"))


@query("SELECT round(avg(list_sum(list_transform(range(1, 65), lambda j: (mapped[j] - new[j]) * (mapped[j] - new[j])))), 9) AS mse FROM x")
def map_error(b):
    return bridges.squared_error(b.items, "mapped", "new")


@query("SELECT region, CASE WHEN region % 3 = 0 THEN eps WHEN isinf(eps) THEN eps ELSE 1.0::DOUBLE END AS eps FROM radii")
def cert_eps(b):
    return b.radii.select("region", F.when(F.col("region") % 3 == 0, V.cert_eps(F.col("eps"), True)).otherwise(V.cert_eps(F.col("eps"), False)).alias("eps"))


# ---------------------------------------------------------------- stored state


@query("SELECT event_id + 1 AS seq, event_type AS kind, value FROM events")
def log_append(b):
    path = fresh_path(b.spark, "log")
    records = b.events.select("event_id", F.col("event_type").alias("kind"), F.struct(F.col("value")).alias("fields"))
    half = b.events.count() // 2
    store.append_log(records.filter(F.col("event_id") < half), [F.col("event_id")], path)
    b.spark.range(1).select(F.lit('{"seq":7000000,"kind":"torn').alias("line")).write.mode("append").text(path)
    store.append_log(records.filter(F.col("event_id") >= half), [F.col("event_id")], path)
    return store.read_log(b.spark, path).select("seq", "kind", F.get_json_object("body", "$.fields.value").cast("double").alias("value"))


@query("""WITH base AS (SELECT src, list(DISTINCT dst ORDER BY dst) AS nbrs FROM edges GROUP BY src),
a AS (SELECT src, list_concat(list_filter(nbrs, lambda v: v % 5 <> src % 5), CASE WHEN list_contains(list_filter(nbrs, lambda v: v % 5 <> src % 5), src + 1) THEN [] ELSE [src + 1] END) AS nbrs FROM base),
z AS (SELECT src, CASE WHEN src % 2 = 0 THEN list_concat(list_filter(nbrs, lambda v: v <> src + 1), CASE WHEN list_contains(list_filter(nbrs, lambda v: v <> src + 1), src + 2) THEN [] ELSE [src + 2] END) ELSE nbrs END AS nbrs FROM a)
SELECT src, unnest(range(len(nbrs))) AS pos, unnest(nbrs) AS dst FROM z""")
def staged_replay(b):
    base = b.edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("nbrs"))
    gone = F.filter("nbrs", lambda v: v % 5 == F.col("src") % 5)
    path = fresh_path(b.spark, "staged")
    store.append(base.select(F.lit(1).alias("batch"), "src", F.array(F.col("src") + 1).alias("added"), gone.alias("removed")), path)
    store.append(base.filter("src % 2 = 0").select(F.lit(2).alias("batch"), "src", F.array(F.col("src") + 2).alias("added"), F.array(F.col("src") + 1).alias("removed")), path)
    return store.replay(base, b.spark.read.parquet(path)).select("src", F.posexplode("nbrs").alias("pos", "dst")).withColumn("pos", F.col("pos").cast("bigint"))


@query("SELECT src, pos, dst FROM edges WHERE pos % 2 = 0")
def graph_store(b):
    path = fresh_path(b.spark, "graph")
    store.save_graph(b.edges.withColumn("layer", (F.col("pos") % 2).cast("int")), path)
    return store.load_graph(b.spark, path, 0).select("src", "pos", "dst")


@query("SELECT item_id, round(CASE WHEN item_id % 50 = 0 THEN old[1] ELSE new[1] END, 6) AS first_part FROM x")
def segment_upsert(b):
    path = fresh_path(b.spark, "segments")
    corpora.write_segments(b.items.select("item_id", F.col("new").alias("vec")), path, 128)
    store.upsert_segments(b.items.filter("item_id % 50 = 0").select("item_id", F.col("old").alias("vec")), b.spark, path, 128)
    return corpora.read_segments(b.spark, path).select("item_id", F.round(F.col("vec")[0], 6).alias("first_part"))


@query("SELECT event_type AS category, round(sum(value), 6) AS seconds, sum(event_id % 5) AS cnt FROM events GROUP BY event_type")
def ledger_append(b):
    path = fresh_path(b.spark, "ledger")
    entries = b.events.select(F.col("event_id").cast("double").alias("ts"), F.col("event_type").alias("category"), F.col("value").alias("seconds"), (F.col("event_id") % 5).alias("cnt"), F.lit("cpu").alias("device"))
    store.append(entries.filter("cnt < 2"), path)
    store.append(entries.filter("cnt >= 2"), path)
    return b.spark.read.schema(store.LEDGER).parquet(path).groupBy("category").agg(F.round(F.sum("seconds"), 6).alias("seconds"), F.sum("cnt").alias("cnt"))


@query("SELECT user_id AS step, count(*) / 10.0::DOUBLE AS budget, round(avg(value), 6) AS recall, CASE WHEN user_id % 3 <> 0 THEN 0.5::DOUBLE END AS mean_bound FROM events GROUP BY user_id")
def curve_file(b):
    path = fresh_path(b.spark, "curve")
    made = b.events.groupBy(F.col("user_id").alias("step")).agg((F.count(F.lit(1)) / 10.0).alias("budget"), F.round(F.avg("value"), 6).alias("recall"))
    made.withColumn("mean_bound", F.when(F.col("step") % 3 != 0, 0.5)).write.json(path)
    return store.read_curve(b.spark, path)


@query("SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN '\"inf\"' WHEN event_id % 7 = 1 THEN '\"-inf\"' WHEN event_id % 7 = 2 THEN 'null' ELSE event_id || '.5' END AS said, CASE WHEN event_id % 7 = 0 THEN 'infinity'::DOUBLE WHEN event_id % 7 = 1 THEN '-infinity'::DOUBLE WHEN event_id % 7 > 2 THEN event_id + 0.5::DOUBLE END AS value FROM events")
def inf_codec(b):
    i = F.col("event_id")
    v = F.when(i % 7 == 0, float("inf")).when(i % 7 == 1, float("-inf")).when(i % 7 > 2, i + 0.5)
    said = b.events.select(i.alias("id"), v.alias("v")).withColumn("said", store.num(F.col("v")))
    return said.select("id", "said", store.unnum(F.col("said")).alias("value"))


@query("SELECT item_id, round(list_sum(list_transform(range(64), lambda j: old[j + 1] * (j + 1))), 6) AS digest FROM x")
def vector_payload(b):
    back = b.items.select("item_id", store.from_base64(store.to_base64(F.col("old"))).alias("v"))
    return back.select("item_id", F.round(F.aggregate(F.transform("v", lambda v, j: v * (j + 1)), F.lit(0.0), lambda s, v: s + v), 6).alias("digest"))


@query("SELECT count(*) AS n, 64 AS d_old, 128 AS segment_rows, 'create' AS kind, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT item_id // 128) FROM x) AS segments FROM x")
def index_create(b):
    root = fresh_path(b.spark, "index")
    store.create_index(root, b.items.select("item_id", F.col("old").alias("vec")), b.edges.withColumn("layer", F.lit(0)), WIDTH, 128)
    t = store.attach(b.spark, root)
    return t["meta"].join(F.broadcast(t["log"].select("kind"))).join(F.broadcast(t["graph"].agg(F.count(F.lit(1)).alias("edges")))).join(F.broadcast(t["segments"].agg(F.countDistinct("segment").alias("segments"))))


@query("SELECT region, count(*) AS n, 2 AS version FROM x GROUP BY region")
def version_store(b):
    root = fresh_path(b.spark, "versions")
    for v in (1, 2):
        store.write_version(b.items.groupBy("region").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(v)), root, v)
    kept = store.cached(b.spark, f"{root}/cache", lambda: store.read_version(b.spark, root))
    store.write_summary(kept, f"{root}/summary")
    return b.spark.read.schema("region int, n long, version int").json(f"{root}/summary")


# ---------------------------------------------------------------- steps of a migration


@query("SELECT item_id, round(sum(pow(2.0::DOUBLE, -((SELECT max(event_id) FROM events) - event_id) / 10000.0::DOUBLE)), 6) AS heat FROM (SELECT event_id, unnest([user_id, user_id + 1]) AS item_id FROM events) GROUP BY item_id")
def warm_heat(b):
    lists = b.events.select(F.col("event_id").alias("seq"), F.array("user_id", F.col("user_id") + 1).alias("items"))
    return scheduling.warm_heat(lists, 10_000.0).withColumn("heat", F.round("heat", 6))


_WRITES = "w AS (SELECT item_id, item_id % 7 <> 0 AS ok, ['resolution', 'calibration', 'calibration_query', 'scheduled'][item_id % 4 + 1] AS category FROM x WHERE item_id % 2 = 0)"


def _published(b):
    names = F.array(*map(F.lit, scheduling.CATEGORIES))
    writes = b.items.filter("item_id % 2 = 0").select("item_id", (F.col("item_id") * 2).alias("fence"), F.element_at(names, (F.col("item_id") % 4 + 1).cast("int")).alias("category"))
    leases = b.items.select("item_id", (F.col("item_id") * 2 + (F.col("item_id") % 7 == 0).cast("int")).alias("fence"), F.lit(10.0).alias("expires"))
    items = b.items.select("item_id", F.lit(scheduling.RESOLVING).alias("state"), (F.col("item_id") % 3 == 0).alias("flipped"))
    return scheduling.publish_batch(items, writes, leases, b.edges.select(F.col("dst").alias("item_id"), F.col("src").alias("node")), 5.0)


@query(f"WITH {_WRITES} SELECT x.item_id, CASE WHEN w.ok THEN 3 ELSE 2 END AS state, x.item_id % 3 = 0 OR coalesce(w.ok AND w.category IN ('resolution', 'scheduled'), false) AS flipped FROM x LEFT JOIN w ON w.item_id = x.item_id")
def publish_items(b):
    return _published(b)[0]


@query(f"WITH {_WRITES} SELECT item_id AS node FROM w WHERE ok UNION SELECT src FROM edges WHERE dst IN (SELECT item_id FROM w WHERE ok)")
def publish_audits(b):
    return _published(b)[1]


@query(f"WITH {_WRITES} SELECT count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS stale FROM w")
def publish_counts(b):
    return _published(b)[2]


@query("SELECT node, (row_number() OVER (ORDER BY seq, node) - 1) // 64 AS batch FROM (SELECT user_id AS node, min(event_id) AS seq FROM events GROUP BY user_id)")
def audit_batches(b):
    return scheduling.audit_batches(b.events.select(F.col("user_id").alias("node"), F.col("event_id").alias("seq")))


@query("SELECT src, dst, CASE WHEN dst % 3 = 0 THEN dst END AS waits_for FROM (SELECT DISTINCT src, dst FROM edges WHERE (src + dst) % 3 > 0)")
def audit_routes(b):
    pair = F.col("src") + F.col("dst")
    said = b.edges.select("src", "dst", F.when(pair % 3 == 1, "pending-keep").when(pair % 3 == 2, "pending-drop").otherwise("keep").alias("verdict")).distinct()
    return scheduling.route_audits(said, b.items.filter("item_id % 3 = 0"))


@query("""WITH ready AS (SELECT item_id, region, row_number() OVER (ORDER BY heat DESC, eps DESC, item_id) AS k FROM states WHERE state IN (0, 1) AND NOT deleted),
steps AS (SELECT event_id AS step, row_number() OVER (ORDER BY event_id) - 1 AS turn FROM events WHERE event_id % 3 <> 1)
SELECT step, item_id, region, row_number() OVER (PARTITION BY step ORDER BY region, k) AS pos FROM ready JOIN steps ON turn = (k - 1) // 32""")
def scheduler_steps(b):
    asks = b.events.select(F.col("event_id").alias("step"), (F.col("event_id") % 3 != 1).alias("granted"))
    return scheduling.plan_steps(b.states, asks, 32, "heat")


@query(f"""WITH {_OVERLAY} SELECT c.item_id, CASE WHEN o.gen <= 1 OR native THEN 'native' ELSE 'old' END AS space, round(CASE WHEN o.gen <= 1 THEN o.vec[1] WHEN native THEN new[1] ELSE old[1] END, 6) AS first_part, c.item_id % 13 = 0 AS deleted FROM c LEFT JOIN o ON o.item_id = c.item_id
UNION ALL SELECT (SELECT max(item_id) + 1 FROM x) + item_id, 'native', round(new[1], 6), (SELECT max(item_id) + 1 FROM x) + item_id IN (SELECT item_id FROM x WHERE item_id % 13 = 0) FROM x WHERE item_id < 40""")
def view_next(b):
    fresh = b.items.filter("item_id < 40").select((F.lit(b.items.agg(F.max("item_id")).first()[0] + 1) + F.col("item_id")).alias("item_id"), F.col("new").alias("vec"))
    got = lifecycle.next_view(_view(b), _overlay(b), fresh, b.items.filter("item_id % 13 = 0"), 1, 1)
    return got.select("item_id", "space", F.round(F.col("vec")[0], 6).alias("first_part"), "deleted")


@query("SELECT item_id, 'old' AS space, round(mapped[1], 6) AS image, false AS native FROM x")
def view_initial(b):
    got = lifecycle.initial_view(b.items.select("item_id", F.col("old").alias("vec")), b.items.select("item_id", "mapped"))
    return got.select("item_id", "space", F.round(F.col("mapped")[0], 6).alias("image"), "native")


@query(f"WITH {_OVERLAY} SELECT c.item_id, round(CASE WHEN o.gen >= 2 THEN o.vec[1] WHEN native THEN new[1] ELSE old[1] END, 6) AS first_part FROM c LEFT JOIN o ON o.item_id = c.item_id")
def overlay_merge(b):
    got, _ = lifecycle.merge_overlay(_view(b), _overlay(b), b.spark.range(2).select(F.col("id").alias("gen")), 1)
    return got.select("item_id", F.round(F.col("vec")[0], 6).alias("first_part"))


_STAGED = "g AS (SELECT DISTINCT src, dst FROM edges)"


def _lists(b):
    base = b.edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("nbrs"))
    staged = base.filter("src % 4 = 1").select((F.col("src") % 3).alias("epoch"), "src", F.slice("nbrs", 1, 2).alias("nbrs"))
    return base, staged


@query(f"WITH {_STAGED}, k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM g) SELECT src, dst FROM k WHERE NOT (src % 4 = 1 AND src % 3 <= 1) OR k <= 2")
def close_edges(b):
    base, staged = _lists(b)
    return lifecycle.close_and_log(_view(b), _overlay(b), base, staged, 1, 1, 1)[1].select("src", F.explode("nbrs").alias("dst"))


@query("SELECT src, 2 AS epoch FROM (SELECT DISTINCT src FROM edges) WHERE src % 4 = 1 AND src % 3 = 2")
def close_carried(b):
    base, staged = _lists(b)
    return lifecycle.close_and_log(_view(b), _overlay(b), base, staged, 1, 1, 1)[2].select("src", "epoch")


@query(f"WITH {_STAGED}, k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM g) SELECT src, dst FROM k WHERE NOT (src % 4 = 1 AND src % 3 = 0) OR k <= 2")
def redo_edges(b):
    base, staged = _lists(b)
    log = b.spark.range(1).select(F.lit("epoch").alias("kind"), F.lit(0).alias("epoch"))
    return lifecycle.redo(log, base, staged).select("src", F.explode("nbrs").alias("dst"))


@query("SELECT item_id, 0 AS state, item_id % 50 = 7 AS deleted, 0 AS since FROM x UNION ALL SELECT (SELECT max(item_id) FROM x) + row_number() OVER (ORDER BY item_id), 3, false, 5 FROM x WHERE item_id % 50 = 7")
def update_items(b):
    items = b.items.select("item_id", F.lit(0).alias("state"), F.lit(False).alias("deleted"), F.lit(0).alias("since"))
    return lifecycle.update(items, b.items.filter("item_id % 50 = 7").select("item_id", F.col("item_id").alias("key")), 4)


@query("SELECT 4096 - count(*) % 4096 AS room FROM x")
def insert_headroom(b):
    return lifecycle.headroom(b.items, 4096)


@query(f"WITH {_OVERLAY} SELECT max(gen) + 1 AS gen FROM (SELECT item_id % 4 AS gen FROM c WHERE item_id % 3 = 0)")
def generation_switch(b):
    return lifecycle.switch_generation(_overlay(b))


@query("SELECT qid, item_id, d, r, NULL::DOUBLE AS bound FROM (SELECT qid, item_id, d_star AS d, row_number() OVER (PARTITION BY qid ORDER BY d_star, item_id) AS r FROM pd WHERE item_id % 3 <> 1) WHERE r <= 10")
def retired_search(b):
    left = b.items.filter("item_id % 3 <> 1").select("item_id", F.col("new").alias("vec"))
    return search.knn(b.queries.withColumnRenamed("qvec", "vec"), left, K).withColumn("bound", F.lit(None).cast("double"))


@query()
def migration_loop(b):
    items = b.states.select("item_id", "region", "state", "deleted", "flipped", "heat", "deg", "eps")
    steps = lifecycle.migrate(materialize(items, "items"), _view(b), b.items.select("item_id", F.col("new").alias("vec")), 40, 3, "radius")
    parts = [after.groupBy("state").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit(step)) for step, after, _ in steps]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- experiment outputs


@query("""WITH p AS (SELECT *, ['seed_off', 'seed_res', 'f25', 'native'][query % 4 + 1] AS phase FROM log), m AS (SELECT avg(recall) FILTER (phase = 'seed_off') AS a, avg(recall) FILTER (phase = 'seed_res') AS b, avg(recall) FILTER (phase = 'f25') AS f, avg(recall) FILTER (phase = 'native') AS n FROM p),
o AS (SELECT round(a, 6) AS seed_off, round(b, 6) AS seed_res, round(f, 6) AS f25, round(n, 6) AS native FROM m)
SELECT *, round((seed_res - seed_off) / nullif(native - seed_off, 0), 6) AS closed_res, round((f25 - seed_off) / nullif(native - seed_off, 0), 6) AS closed_f25 FROM o""")
def quality_phases(b):
    names = F.array(*map(F.lit, ("seed_off", "seed_res", "f25", "native")))
    return evaluation.phases(b.log.withColumn("phase", F.element_at(names, (F.col("query") % 4 + 1).cast("int"))))


@query("""SELECT query % 3 AS workload, count(*) AS requests, round(avg(recall), 6) AS recall, round(avg(bound), 6) AS mean_bound, round(avg((examined_recall < bound - 1e-12)::INT) FILTER (bound IS NOT NULL), 6) AS m1,
round(avg((recall < bound - 1e-12)::INT) FILTER (bound IS NOT NULL), 6) AS m2, round(avg(recall - bound), 6) AS gap, round(avg((bound >= 1)::INT) FILTER (bound IS NOT NULL), 6) AS fully_certified FROM log GROUP BY 1""")
def reliability_by_workload(b):
    return evaluation.by_group(b.log.withColumn("workload", F.col("query") % 3), "workload")


def _variant(source: str) -> str:
    """The certificate's counts and bound over a source of candidates with widths, as a sub-select."""
    return f"({_certified(source)})"


@query(f"""WITH wide AS (SELECT cand.*, CASE WHEN isinf(eps) OR isinf(lam) THEN 'infinity'::DOUBLE ELSE eps * lam END AS w FROM cand, view_lam)
SELECT 'full' AS variant, qid, bound FROM {_variant("SELECT * FROM wide")} UNION ALL SELECT 'inner', qid, m / 10.0::DOUBLE FROM {_variant("SELECT * FROM wide")} UNION ALL SELECT 'outer', qid, greatest(0, 10 - z) / 10.0::DOUBLE FROM {_variant("SELECT * FROM wide")}
UNION ALL SELECT 'no_scale', qid, bound FROM {_variant("SELECT *, eps AS w FROM cand")} UNION ALL SELECT 'one_width', qid, bound FROM {_variant("SELECT cand.*, CASE WHEN isinf(eps) THEN eps ELSE lam END AS w FROM cand, view_lam")}""")
def certificate_variants(b):
    c = materialize(b.candidates, "candidates")
    return evaluation.variants(c, calibration.view_scale(calibration.query_scores(c), ALPHA_Q), K)


@query("""WITH l AS (SELECT user_id % 4 AS scheduler, event_id AS seq, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS k, 1 - 1 / (1 + event_id / (300.0::DOUBLE * (1 + user_id % 4))) AS bound FROM events)
SELECT scheduler, round(min(k / 100.0::DOUBLE) FILTER (bound >= 0.7), 6) AS to_0700 FROM l GROUP BY scheduler""")
def scheduler_budgets(b):
    i, m = F.col("event_id"), F.col("user_id") % 4
    log = b.events.select(m.alias("scheduler"), i.alias("seq"), (1 - 1 / (1 + i / (300.0 * (1 + m)))).alias("bound"))
    return evaluation.bound_budgets(log, "scheduler", 100.0, 0.7)


@query("""WITH t AS (SELECT item_id, item_id % 37 + item_id % 5 AS title FROM x), n AS (SELECT title, count(*) AS n FROM t GROUP BY title), k AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS total FROM n), rare AS (SELECT title FROM n WHERE n <= (SELECT n FROM k WHERE i = floor(0.1::DOUBLE * (total - 1)))),
truth AS (SELECT qid, item_id FROM (SELECT qid, item_id, row_number() OVER (PARTITION BY qid ORDER BY d_star, item_id) AS t FROM pd) WHERE t <= 10), found AS (SELECT qid, item_id FROM cand WHERE r <= 10),
own AS (SELECT DISTINCT qid FROM truth JOIN t USING (item_id) WHERE title IN (SELECT title FROM rare))
SELECT count(*) AS queries, round(avg(recall), 6) AS recall FROM (SELECT qid, count(found.item_id) / 10.0::DOUBLE AS recall FROM truth LEFT JOIN found USING (qid, item_id) WHERE qid IN (SELECT qid FROM own) GROUP BY qid)""")
def rare_recall(b):
    titles = b.items.select("item_id", (F.col("item_id") % 37 + F.col("item_id") % 5).alias("title"))
    truth = materialize(_truth(b), "truth")
    own = workload.nearest_titles(truth, titles, workload.rare_entities(titles, "title")).select("qid").distinct()
    recall = search.recall(b.candidates.filter(F.col("r") <= K), truth, K).join(own, "qid", "left_semi")
    return recall.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("recall"), 6).alias("recall"))


@query("WITH o AS (SELECT c_custkey AS qid, row_number() OVER (ORDER BY ((c_custkey * 7919 + 3 * 104729) % 1009) / 1009.0::DOUBLE, c_custkey) AS rank, count(*) OVER () AS n FROM customer) SELECT event_id AS seq, qid FROM events JOIN o ON rank = event_id % n + 1")
def workload_uniform(b):
    queries = table(b.spark, b.dir, "customer").select(F.col("c_custkey").alias("qid"))
    return workload.workload("uniform", None, None, None, queries, b.events.count(), 3)


@query("""WITH o AS (SELECT r_regionkey AS qid, row_number() OVER (ORDER BY ((r_regionkey * 7919 + 3 * 104729) % 1009) / 1009.0::DOUBLE, r_regionkey) AS rank FROM region),
w AS (SELECT k AS rank, round(sum(1 / k::DOUBLE) OVER (ORDER BY k) / sum(1 / k::DOUBLE) OVER (), 9) AS high FROM range(1, 6) t(k)), d AS (SELECT event_id AS seq, ((event_id * 7919 + 3 * 104729) % 1009) / 1009.0::DOUBLE AS u FROM events),
z AS (SELECT seq, min(rank) AS rank FROM d JOIN w ON high > u GROUP BY seq) SELECT seq, qid FROM z JOIN o USING (rank)""")
def workload_zipf(b):
    queries = table(b.spark, b.dir, "region").select(F.col("r_regionkey").cast("bigint").alias("qid"))
    return workload.workload("zipf", None, None, None, queries, b.events.count(), 3).withColumn("qid", F.col("qid").cast("int"))
