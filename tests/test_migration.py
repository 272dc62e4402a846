"""Graphs, maps, stored state and steps of a migration against plain restatements."""

import functools
import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline import cli
from driftline.functions import scratch, udtf
from driftline.operators import bridges, evaluation, graph, models, scheduling, search, workload
from driftline.plans import catalog, further, lifecycle  # noqa: F401  (further registers its queries with the catalog)
from driftline.sources import store


def greedy(d, radius, between, current, alpha, most):
    """Verdicts of one node's candidates (by distance) from intervals, one at a time."""
    kept, out = [], {}
    for j in range(len(d)):
        if len(kept) == most:
            break
        if any(alpha * (between[s][j] + radius[s] + radius[j]) <= max(0.0, d[j] - radius[j]) for s in kept):
            continue
        sure = all(alpha * max(0.0, between[s][j] - radius[s] - radius[j]) > d[j] + radius[j] for s in kept)
        out[j] = "keep" if sure else "pending-keep" if current[j] else "pending-drop"
        if out[j] != "pending-drop":
            kept.append(j)
    return out


@pytest.mark.parametrize("width", [0.0, 0.05, 0.4])
def test_choice_against_one_node_at_a_time(spark, width):
    rng = np.random.default_rng(7)
    v, rows, want = rng.normal(size=(60, 4)), [], set()
    radius, current = (rng.random(60) * width).round(3), rng.random(60) < 0.5
    for src in range(40):
        ids = rng.choice(60, rng.integers(1, 30), replace=False)
        d = {int(j): round(float(np.linalg.norm(v[src] - v[j])), 6) for j in ids if j != src}
        order = sorted(d, key=lambda j: (d[j], j))
        rows += [(src, v[src].tolist(), 0.0, j, v[j].tolist(), float(radius[j]), bool(current[j])) for j in order]
        between = [[round(float(np.linalg.norm(v[a] - v[b])), 6) for b in order] for a in order]
        found = greedy([d[j] for j in order], [radius[j] for j in order], between, [current[j] for j in order], 1.2, 6)
        want |= {(src, order[j], verdict) for j, verdict in found.items()}
    df = spark.createDataFrame(rows, "src long, svec array<double>, srad double, dst long, dvec array<double>, drad double, current boolean")
    assert {tuple(r) for r in graph.audit(df, 1.2, 6).collect()} == want
    if not width:
        assert {(r.src, r.dst) for r in graph.prune(df, 1.2, 6).collect()} == {x[:2] for x in want}


def test_connect_prunes_only_where_lists_overflow(spark):
    rng = np.random.default_rng(8)
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(30, 3)))], "item_id long, vec array<double>")
    edges = [(i, 0) for i in range(1, 30)] + [(1, 2), (2, 3)]
    got = graph.connect(spark.createDataFrame(edges, "src long, dst long"), vec, 1.2, 8).collect()
    lists = {}
    for r in got:
        lists.setdefault(r.src, set()).add(r.dst)
    assert len(lists[0]) <= 8 and lists[2] == {0, 1, 3} and all(0 in lists[i] for i in range(1, 30))


def test_layers_find_the_nearest(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(900, 8))
    items = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)], "item_id long, shard int, vec array<double>")
    built = scratch.materialize(graph.build_layers(items, 12, 40, 1.2), "layers")
    rows = built.collect()
    degree = {}
    for r in rows:
        degree[r.layer, r.src] = degree.get((r.layer, r.src), 0) + 1
        assert r.src % 3 == r.dst % 3 == r.shard and r.src != r.dst
    assert max(n for (layer, _), n in degree.items() if layer == 0) <= 12 and max((n for (layer, _), n in degree.items() if layer), default=0) <= 6
    assert {s for layer, s in degree if layer == 0} == set(range(900)) and max(layer for layer, _ in degree) >= 1
    q = rng.normal(size=(40, 8))
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, qvec array<double>")
    found = {}
    for r in graph.search_layers(queries, built, items, 10, 60, part_rows=15).collect():
        found.setdefault(r.qid, set()).add(r.item_id)
    hit = sum(len(found[i] & set(np.argsort(((v - x) ** 2).sum(1))[:10].tolist())) for i, x in enumerate(q))
    assert hit >= 0.95 * 400
    one = graph.search_layers(queries, built.limit(0), items.limit(1), 10, 60).collect()
    assert len(one) == 40 and len({r.item_id for r in one}) == 1


@pytest.mark.parametrize("linked", [True, False])
def test_exact_layers_miss_nothing(spark, linked):
    rng = np.random.default_rng(12)
    v = np.r_[rng.normal(size=(300, 6)), np.repeat(rng.normal(size=(1, 6)), 60, 0), 9 + rng.normal(size=(240, 6)) * 0.01]
    items = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "item_id long, shard int, vec array<double>")
    built = scratch.materialize(graph.build_layers(items, 4, 8, 1.2), "layers") if linked else graph.build_layers(items, 4, 8, 1.2).limit(0)
    q = np.r_[rng.normal(size=(20, 6)), v[[3, 310, 420, 500]], 9 + rng.normal(size=(16, 6))]
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, qvec array<double>")
    d = np.round(np.sqrt(((v[None, :, :] - q[:, None, :]) ** 2).sum(2)), 6)
    want = {(i, int(j), float(d[i, j]), r + 1) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(v)), d[i]))[:10])}
    assert {tuple(r) for r in graph.search_layers(queries, built, items, 10, 12, part_rows=15, exact=True).collect()} == want
    assert {tuple(r) for r in graph.search_layers(queries, built, items, 10, 12, part_rows=15).collect()} != want


def test_completed_lists_over_many_blocks():
    rng = np.random.default_rng(13)
    v, q = rng.integers(0, 4, (90, 3)).astype(float), rng.integers(0, 4, (11, 3)).astype(float)
    d = np.round(np.sqrt(((v[None, :, :] - q[:, None, :]) ** 2).sum(2)), 6)
    begun = [(np.array([7]), d[i, [7]]) if i % 2 else (np.lexsort((np.arange(9), d[i, :9])), np.sort(d[i, :9])) for i in range(11)]
    for i, (at, far) in enumerate(graph._completed(v, q, begun, 9, 4, 16)):
        best = np.lexsort((np.arange(90), d[i]))[:9]
        assert (at == best).all() and (far == d[i][best]).all()


@pytest.mark.parametrize("most", [1, 4, 16])
def test_long_lists_are_chosen_like_short_ones(most):
    rng = np.random.default_rng(14)
    v = np.r_[rng.normal(size=(60, 5)), rng.normal(size=5) + rng.normal(size=(200, 5)) * 0.01]
    each, whole = graph._layer(v, 24, 1.2, most, wide=0), graph._layer(v, 24, 1.2, most, wide=1000)
    assert all(a.tolist() == b.tolist() for a, b in zip(each, whole, strict=True))


def test_whole_groups_keep_keys_together():
    import pandas as pd

    keys = np.sort(np.random.default_rng(1).integers(0, 9, 200))
    frames = [pd.DataFrame({"k": keys[a : a + 7]}) for a in range(0, 200, 7)]
    for size in (1, 20, 1000):
        got = [f.k.to_numpy() for f in graph.whole_groups(iter(frames), "k", size)]
        assert (np.concatenate(got) == keys).all() and all(a[-1] != b[0] for a, b in zip(got, got[1:], strict=False))


def test_reverse_links_and_new_items(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 3))
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vec array<double>")
    old = spark.createDataFrame([(i, (i + k) % 35) for i in range(35) for k in (1, 2, 3)], "src long, dst long")
    probes = spark.createDataFrame([(i, j) for i in range(35, 40) for j in range(35)], "item_id long, dst long")
    got = {(r.src, r.dst) for r in graph.link_new(vec.filter("item_id >= 35"), old, vec.filter("item_id < 35"), probes, 1.2, 6).collect()}
    for i in range(35, 40):
        own = {d for s, d in got if s == i}
        assert own and int(np.argsort(((v[:35] - v[i]) ** 2).sum(1))[0]) in own
    assert max(sum(s == i for s, _ in got) for i in range(40)) <= 6


def test_moments_give_the_refitted_errors():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(50, 6)), rng.normal(size=(50, 4))
    held, rest = models.Moments(x[::5], y[::5]), models.Moments(np.delete(x, np.s_[::5], 0), np.delete(y, np.s_[::5], 0))
    less = models.Moments(x, y).less(held)
    assert np.allclose(less.joint, rest.joint)
    for ridge in (0.01, 3.0):
        down, up, b = less.fit(3, ridge)
        assert held.error(down, up, b) == pytest.approx(((x[::5] @ down @ up.T + b - y[::5]) ** 2).sum())
        down, up, b = rest.fit(4, ridge)
        centered, target = (a - a.mean(0) for a in (np.delete(x, np.s_[::5], 0), np.delete(y, np.s_[::5], 0)))
        assert np.allclose(down @ up.T, np.linalg.solve(centered.T @ centered + ridge * np.eye(6), centered.T @ target))


def test_maps_fall_back_and_refuse_other_widths(spark):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    x = rng.normal(size=(41, 4))
    rows = [(0 if i < 20 else 1 if i < 40 else 2, a.tolist(), (a @ turn).tolist()) for i, a in enumerate(x)]
    pairs = spark.createDataFrame(rows, "region int, old array<double>, new array<double>")
    fitted = scratch.materialize(bridges.fit_rotations(pairs), "maps")
    assert sorted(((r.region) for r in fitted.collect()), key=str) == [0, 1, None]
    out = bridges.apply_maps(pairs, fitted, "old", "image").collect()
    assert len(out) == 41 and all(np.allclose(r.image, r.new) for r in out)
    with pytest.raises(PySparkException, match="components for a map of 4"):
        bridges.apply_maps(spark.createDataFrame([(0, [1.0, 2.0])], "region int, old array<double>"), fitted, "old", "image").collect()
    with pytest.raises(PySparkException, match="does not take 4 components to 5"):
        bridges.check_shapes(fitted, 4, 5).collect()
    adapter = bridges.adapter(pairs, 6)
    back = bridges.adapt(pairs.select("new", "old"), adapter, "new", 4, 6).collect()
    assert all(np.allclose(r.new, r.old) for r in back)


def test_log_survives_torn_and_foreign_lines(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    records = lambda a, b: spark.range(a, b).select(F.lit("native").alias("kind"), F.struct("id").alias("fields"), "id")
    assert store.append_log(records(0, 5), [F.col("id")], path) == 5
    spark.createDataFrame([('{"seq":7,"kind":"native"}\t1',), ("torn",)], "line string").write.mode("append").text(path)
    lines = store.log_lines(records(0, 1), [F.col("id")], 8)  # a sound line after a gap
    lines.select("line").write.mode("append").text(path)
    assert [r.seq for r in store.read_log(spark, path).orderBy("seq").collect()] == [1, 2, 3, 4, 5]
    assert store.append_log(records(5, 7), [F.col("id")], path) == 7
    assert [r.seq for r in store.read_log(spark, path, 4).orderBy("seq").collect()] == [5, 6, 7]


def test_numbers_as_json_text(spark):
    rng = np.random.default_rng(15)
    values = [0.0, -0.0, 1e7, -1e7, 10000000.5, 59099999.5, 2251799813685247.5, 9999999999999998.0, 1e16, -1.5e16, 1e-3, 9.99e-4, 1e-4, 1.2345678901234567e-4, 9.9e-5, 1e300, 1 / 3]
    values += [float(x) for x in rng.uniform(-1, 1, 500) * 10.0 ** rng.integers(-6, 18, 500)] + [float(x) + 0.5 for x in rng.integers(10**6, 2**51, 500)]
    df = spark.createDataFrame([(x,) for x in [*values, math.inf, -math.inf, math.nan, None]], "v double").select("v", store.num(F.col("v")).alias("said"))
    got = df.select("v", "said", store.unnum(F.col("said")).alias("back")).collect()
    for r in got[: len(values)]:
        assert float(r.said) == r.back == r.v
        assert r.said == json.dumps(r.v) or not 1e-4 <= abs(r.v) < 1e16
    assert [(r.said, r.back) for r in got[len(values) :]] == [('"inf"', math.inf), ('"-inf"', -math.inf), ("null", None), ("null", None)]


def test_codec_query_over_large_ids(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    (tmp_path / "embeddings.parquet").symlink_to(f"{src}/embeddings.parquet")
    events = spark.read.parquet(f"{src}/events.parquet")
    shifted = [events.withColumn("event_id", F.col("event_id") + by) for by in (0, 9_999_500, 59_000_000, 10**12)]
    functools.reduce(DataFrame.unionByName, shifted).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.SQL["inf_codec"]).fetchall()
    got = catalog.QUERIES["inf_codec"](spark, str(tmp_path)).select("id", "said", "value").collect()
    assert len(want) == 4000 and sorted(map(tuple, got)) == sorted(want)


def test_scratch_tables_go_with_their_scope(spark, tmp_path):
    import os

    with scratch.scratch():
        inner = scratch.materialize(spark.range(3), "inner")
        outer = scratch.materialize(spark.range(4), "outer", outlives=True)
        paths = [p.removeprefix("file://") for p in (inner.inputFiles()[0], outer.inputFiles()[0])]
    assert [os.path.exists(p) for p in paths] == [False, True] and outer.count() == 4
    scratch.discard(outer)
    assert not os.path.exists(paths[1])


def test_hot_keys_join_alike(spark, monkeypatch):
    monkeypatch.setattr(scratch, "LEAST_HOT", 5)
    rows = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m"))
    got = sorted(map(tuple, scratch.join_hot(rows, per, "k", "n", 300).collect()))
    assert got == sorted(map(tuple, rows.join(per, "k").collect())) and len(got) == 300


def test_ambiguous_for_sql_callers(spark):
    udtf.register(spark)
    rng = np.random.default_rng(4)
    for _ in range(15):
        n = int(rng.integers(1, 9))
        d, e = rng.integers(0, 8, n) / 4, rng.random(n) < 0.4
        w = rng.choice([0.0, 0.5, 1.0, math.inf], n)
        rows = spark.createDataFrame([(0, i, float(a), bool(b), float(c)) for i, (a, b, c) in enumerate(zip(d, e, w, strict=True))], "qid long, item_id long, d double, exact boolean, w double")
        want = [(r.item_id, r.r) for r in search.ambiguous(rows, 4, 3).orderBy("r").collect()]
        one = rows.agg(F.collect_list(F.struct("d", "exact", "w", "item_id")).alias("c")).selectExpr("c.d d", "c.exact e", "c.w w", "c.item_id i")
        one.createOrReplaceTempView("one_query")
        got = spark.sql("SELECT t.* FROM one_query, LATERAL ambiguous(d, e, w, i, 4, 3) t ORDER BY r").collect()
        assert [tuple(r) for r in got] == want


def test_encoders_and_crash_points(spark):
    udtf.ENCODERS["length"] = lambda texts: [[len(t), 1.0] for t in texts]
    got = spark.createDataFrame([("abc",), ("",)], "text string").select(udtf.load_encoder("length")(F.col("text")).alias("v")).collect()
    assert sorted(r.v for r in got) == [[0.0, 1.0], [3.0, 1.0]]
    with pytest.raises(KeyError):
        udtf.load_encoder("none")
    with pytest.raises(ValueError):
        lifecycle.crash_at("nowhere")
    reached = lifecycle.crash_at("merge")
    reached("rotate")
    with pytest.raises(lifecycle.Crash):
        reached("merge")


def test_zipf_and_bucket_edges(spark):
    draws = spark.range(2000).withColumnRenamed("id", "seq")
    got = {r.seq: r["rank"] for r in workload.zipf_stream(300, draws, 1.0, 5).collect()}
    edges = np.cumsum(1 / np.arange(1, 301)) / (1 / np.arange(1, 301)).sum()
    u = ((np.arange(2000) * 7919 + 5 * 104729) % 1009) / 1009
    assert [got[i] for i in range(2000)] == (np.searchsorted(edges.round(9), u, side="right") + 1).tolist()
    asks = spark.createDataFrame([(1, 2, 10.0, 3600.0), (1, 1, 0.0, 3600.0), (2, 1, 0.0, 9e9)], "key int, seq long, t double, gpu_seconds double")
    rows = {(r.key, r.seq): (r.granted, r.tokens) for r in scheduling.token_bucket(asks, 1.5, 0.0, 1.0).collect()}
    assert rows == {(1, 1): (True, 0.5), (1, 2): (False, 0.5), (2, 1): (False, 1.5)}


def test_summaries_without_one_class(spark):
    log = spark.createDataFrame([(1.0, 1.0, 0.5)] * 3, "recall double, bound double, confidence double").selectExpr("*", "1 requested", "0 resolved", "0 waited", "0.1 latency", "0.1 cpu", "1.0D examined_recall", "0.0D score", "1.0D lam", "1.0D capture")
    out = evaluation.summarize(log).first()
    assert out.requests == 3 and out.auroc_bound is None and out.auroc_confidence is None


def test_overrides():
    assert cli.overrides(["a=1", "b=x", 'c={"d": [2]}']) == {"a": 1, "b": "x", "c": {"d": [2]}}
    with pytest.raises(ValueError):
        cli.overrides(["a"])
