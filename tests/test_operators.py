"""Operators against plain restatements and invariants."""

import json
import math
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import rank, stats, vectors as V
from driftline.operators import evaluation, graph, models, scheduling, search, workload
from driftline.plans import lifecycle
from driftline.sources import corpora, wal
from driftline.streaming import state

INF = math.inf


def naive_certificate(rows, k):
    order = sorted(rows, key=lambda r: (r["d"], r["item_id"]))
    low = lambda r: r["d"] if r["exact"] else 0.0 if math.isinf(r["w"]) else max(0.0, r["d"] - r["w"])
    high = lambda r: r["d"] if r["exact"] else r["d"] + r["w"]
    if len(rows) <= k:
        return len(rows), 0, 1.0
    inside, outside = order[:k], order[k:]
    m = sum(high(r) < min(map(low, outside)) for r in inside)
    z = sum(sum(high(o) < low(r) for o in rows) < k for r in outside)
    return m, z, max(0, m, k - z) / k


def candidates(rng, queries, most):
    out = []
    for q in range(queries):
        for i in range(rng.integers(1, most)):
            out.append({"qid": q, "item_id": i, "d": float(rng.integers(0, 12)) / 4, "exact": bool(rng.random() < 0.4), "w": float(rng.choice([0.0, 0.25, 0.5, 1.0, INF], p=[0.2, 0.3, 0.3, 0.15, 0.05]))})
    return out


def test_certificate_matches_its_definition(spark):
    rows = candidates(np.random.default_rng(1), 250, 14)
    got = {r.qid: (r.m, r.z, r.bound) for r in search.certify(spark.createDataFrame(rows, "qid long, item_id long, d double, exact boolean, w double"), 4).collect()}
    for q in range(250):
        assert got[q] == naive_certificate([r for r in rows if r["qid"] == q], 4)


def test_bound_is_sound(spark):
    rng = np.random.default_rng(2)
    rows = candidates(rng, 150, 20)
    for r in rows:
        w = 0 if r["exact"] else min(r["w"], 50.0)
        r["true"] = float(max(0.0, r["d"] + rng.uniform(-w, w)))
    found = {r.qid: r.bound for r in search.certify(spark.createDataFrame([{k: v for k, v in r.items() if k != "true"} for r in rows], "qid long, item_id long, d double, exact boolean, w double"), 4).collect()}
    for q in range(150):
        own = [r for r in rows if r["qid"] == q]
        top = lambda c: {r["item_id"] for r in sorted(own, key=lambda r: (r[c], r["item_id"]))[:4]}
        if len(own) > 4:
            assert len(top("d") & top("true")) / 4 >= found[q] - 1e-9


def naive_ambiguous(rows, k):
    low = lambda r: r["d"] if r["exact"] else 0.0 if math.isinf(r["w"]) else max(0.0, r["d"] - r["w"])
    high = lambda r: r["d"] if r["exact"] else r["d"] + r["w"]
    order = sorted(rows, key=lambda r: (r["d"], r["item_id"]))
    if len(rows) < k:
        return {r["item_id"] for r in rows if not r["exact"]}
    edge = order[k - 1]
    some = [(-(min(high(r), high(edge)) - max(low(r), low(edge))), abs(r["d"] - edge["d"]), r["item_id"]) for r in rows if not r["exact"]]
    return [i for o, _, i in sorted(some) if o <= 0][:5]


def test_ambiguous_matches_its_definition(spark):
    rows = candidates(np.random.default_rng(5), 150, 12)
    got = {}
    for r in search.ambiguous(spark.createDataFrame(rows, "qid long, item_id long, d double, exact boolean, w double"), 4, 5).orderBy("qid", "r").collect():
        got.setdefault(r.qid, []).append(r.item_id)
    for q in range(150):
        want = naive_ambiguous([r for r in rows if r["qid"] == q], 4)
        assert (set(got.get(q, [])) == want) if isinstance(want, set) else got.get(q, []) == want


@pytest.mark.parametrize(("m", "alpha", "finite"), [(18, 0.05, False), (19, 0.05, True), (8, 0.1, False), (9, 0.1, True), (98, 0.01, False), (99, 0.01, True)])
def test_conformal_rank_edges(spark, m, alpha, finite):
    rows = spark.createDataFrame([(0, float(i)) for i in range(m)], "region int, s double")
    q = stats.conformal_quantiles(rows, ["region"], "s", alpha, "q").first().q
    assert (q == m - 1) if finite else math.isinf(q)


def test_interval_functions(spark):
    row = spark.range(1).select(V.width_of(F.lit(INF), F.lit(0.0)).alias("a"), V.normalized_error(F.lit(1.0), F.lit(2.0), F.lit(INF)).alias("b"), V.normalized_error(F.lit(1.0), F.lit(2.0), F.lit(0.0)).alias("c"), V.normalized_error(F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("d"), V.normalized_error(F.lit(1.0), F.lit(2.0), F.lit(0.5)).alias("e"), V.fence(F.lit(3), F.lit(7)).alias("f"), V.unit(F.array(F.lit(0.0))).alias("g")).first()
    assert tuple(row) == (INF, 0.0, INF, 0.0, 2.0, 3 << 40 | 7, None)


def test_heat_equals_the_recursion(spark):
    seqs = [3, 10, 4000, 9999]
    heat, clock = 0.0, 0
    for s in seqs:
        heat, clock = heat * 2 ** (-(s - clock) / 10_000) + 1, s
    got = scheduling.heat(spark.createDataFrame([(1, s) for s in seqs], "item_id long, seq long"), 10_000.0).first().heat
    assert got == pytest.approx(heat, rel=1e-12)


def test_cold_item_with_infinite_radius_has_no_priority(spark):
    rows = spark.createDataFrame([(1, 0, False, 0.0, INF, 5), (2, 0, False, 1.0, 0.1, 5), (3, 3, False, 9.0, 1.0, 9), (4, 0, True, 9.0, 1.0, 9)], "item_id long, state int, deleted boolean, heat double, eps double, deg long").withColumn("region", F.lit(1))
    assert [r.item_id for r in scheduling.pick(rows, 5).orderBy("pos").collect()] == [2, 1]


def test_knn_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 3, (90, 4)).astype(float)
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vec array<double>")
    monkeypatch.setattr(search, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 5)
    got = {}
    for r in search.knn(items.withColumnRenamed("item_id", "qid"), items, 6).orderBy("qid", "r").collect():
        got.setdefault(r.qid, []).append(r.item_id)
    for q in range(90):
        d = np.round(np.sqrt(((v - v[q]) ** 2).sum(1)), 6)
        assert got[q] == np.lexsort((np.arange(90), d))[:6].tolist()


def test_auroc_pairs(spark):
    rows = [(bool(p), float(s)) for p, s in zip([1, 0, 1, 0, 0, 1], [3, 3, 2, 1, 2, 5], strict=True)]
    pairs = [(a > b) + 0.5 * (a == b) for p, a in rows if p for n, b in rows if not n]
    df = spark.createDataFrame(rows, "p boolean, s double")
    assert stats.auroc(df, "p", "s").first().auroc == pytest.approx(np.mean(pairs))
    assert stats.auroc(df.filter("p"), "p", "s").first().auroc is None


def test_curves(spark):
    curve = spark.createDataFrame([(0, 0.0, 0.5, None), (1, 0.5, 0.7, 0.9), (2, 1.0, 0.9, 0.99)], "step int, budget double, recall double, b double")
    reach = lambda c, t: stats.curve_reach(curve, "step", "budget", c, t).first().budget
    assert reach("recall", 0.8) == pytest.approx(0.75) and reach("recall", 0.95) is None and reach("recall", 0.1) == 0.0 and reach("b", 0.9) == 0.5
    assert [stats.curve_at(curve, "budget", "recall", x).first().value for x in (-1.0, 0.25, 9.0)] == pytest.approx([0.5, 0.6, 0.9])


def test_stratified_split_rounds_half_to_even(spark):
    items = spark.createDataFrame([(10 * n + i, n) for n in (1, 3, 5, 7) for i in range(n)], "item_id long, region int")
    got = workload.stratified_split(items, 8, 4, 1).filter("part = 'fit'").groupBy("region").count().collect()
    assert {r.region: r["count"] for r in got} == {3: 2, 5: 2, 7: 4}


def test_models(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    rows = [(1, i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, x @ turn, strict=True))]
    df = spark.createDataFrame(rows, "region int, item_id long, old array<double>, new array<double>")
    w = np.array(models.procrustes(df).first().w).reshape(6, 6)
    assert np.allclose(w, turn) and np.allclose(w @ w.T, np.eye(6))
    wide = rng.normal(size=(6, 2)) @ rng.normal(size=(2, 9))
    df = spark.createDataFrame([(1, i, a.tolist(), (a @ wide + 3).tolist()) for i, a in enumerate(x)], "region int, item_id long, old array<double>, new array<double>")
    fit = models.low_rank(df, 2, [1e-6, 10.0], 5).first()
    down, up = np.array(fit.down).reshape(6, 2), np.array(fit.up).reshape(9, 2)
    assert fit.ridge == 1e-6 and np.allclose(x @ down @ up.T + fit.b, x @ wide + 3, atol=1e-4)


def test_prune_and_audit(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(12, 3))
    pool = [(0, v[0].tolist(), 0.0, j, v[j].tolist(), 0.0, False) for j in range(1, 12)]
    df = spark.createDataFrame(pool, "src long, svec array<double>, srad double, dst long, dvec array<double>, drad double, current boolean")
    kept = [r.dst for r in graph.prune(df.select("src", "svec", "dst", "dvec"), 1.2, 4).orderBy("pos").collect()]
    exact = [r.dst for r in graph.audit(df, 1.2, 4).collect()]
    assert kept == exact and 0 < len(kept) <= 4
    loose = graph.audit(df.withColumn("drad", F.lit(100.0)), 1.2, 4).collect()
    assert [r.verdict for r in loose][0] == "keep" and {r.verdict for r in loose[1:]} == {"pending-drop"}


def test_log_prefix_and_records(spark, tmp_path):
    bodies = [json.dumps({"seq": i, "kind": "native", "gen": 0}) for i in range(6)]
    lines = [f"{b}\t{zlib.crc32(b.encode())}" for b in bodies]
    lines[4] = "x" + lines[4]
    (tmp_path / "log").write_text("\n".join(lines) + "\n")
    got = wal.records(wal.read(spark, str(tmp_path / "log")), "seq long, kind string, gen long", after=1).collect()
    assert [r.seq for r in got] == [2, 3]


def test_epoch_close_keeps_routes(spark):
    view = spark.createDataFrame([(i, [float(i)], "old", [float(-i)], False) for i in range(6)], "item_id long, vec array<double>, space string, mapped array<double>, native boolean")
    writes = spark.createDataFrame([(1, [9.0], 0, 1, 7), (1, [8.0], 1, 2, 7), (2, [7.0], 3, 3, 7), (3, [6.0], 0, 4, 6)], "item_id long, vec array<double>, gen int, seq long, version int")
    before = {r.item_id: (r.route, r.exact) for r in lifecycle.resolve(view, writes, 1, 7).collect()}
    closed = lifecycle.rotate(lifecycle.close_epoch(view, writes, 1, 7))
    after = {r.item_id: r.vec for r in closed.collect()}
    assert before[1] == ([9.0], True) and before[2] == ([-2.0], True) and before[3] == ([-3.0], False)
    assert all(before[i][0] == after[i] for i in range(6))
    again = {r.item_id: r.vec for r in lifecycle.rotate(lifecycle.close_epoch(closed, writes, 1, 7)).collect()}
    assert again == after


def test_readers(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("id\ttext\ttitle\n1\tbody\tHead\n2\tmore\tTwo\n")
    assert [tuple(r) for r in corpora.passages(spark, str(tmp_path / "p.tsv"), 5).orderBy("id").collect()] == [(0, "Head. body", "Head", "1"), (1, "Two. more", "Two", "2")]
    (tmp_path / "a.csv").write_text("q1\tx\n\nq2\ty\n")
    assert sorted(r.text for r in corpora.first_column(spark, [str(tmp_path / "a.csv")] * 2).collect()) == ["q1", "q1", "q2", "q2"]
    (tmp_path / "c.tsv").write_text("7\ta\tb\n8\tc\n")
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as t:
        t.add(tmp_path / "c.tsv", "c.tsv")
    assert [tuple(r) for r in corpora.split_once(corpora.tar_lines(spark, str(tmp_path / "c.tar.gz"), "c.tsv")).collect()] == [(7, "a\tb"), (8, "c")]
    (tmp_path / "x-19.tsv").write_text("1\tq\n")
    assert corpora.tracks(spark, [str(tmp_path / "x-19.tsv")]).first().track == "19"
    spark.createDataFrame([(f"u{i}", f"t{i}" if i % 3 else " ") for i in range(30)], "URL string, TEXT string").write.parquet(str(tmp_path / "m"))
    items, held = corpora.captions(spark, str(tmp_path / "m"), 8, 5)
    assert items.count() == 8 and held.count() == 5 and not {r.URL for r in items.collect()} & {r.URL for r in held.collect()}
    (tmp_path / "w.txt").write_text("a 1 2\nb 3 4.5\n")
    assert corpora.word_vectors(spark, str(tmp_path / "w.txt")).filter("word = 'b'").first().vec == [3.0, 4.5]
    made = corpora.write_jsonl(spark.range(5).coalesce(1), str(tmp_path / "j")).collect()
    assert sum(r.rows for r in made) == 5 and corpora.jsonl(spark, str(tmp_path / "j"), "id long").count() == 5
    vec = spark.range(10).select(F.col("id").alias("item_id"), F.array(F.col("id").cast("double")).alias("vec"))
    corpora.write_segments(vec, str(tmp_path / "s"), 4)
    corpora.write_segments(vec.filter("item_id < 4").withColumn("vec", F.array(F.lit(9.0))), str(tmp_path / "s"), 4)
    assert corpora.read_segments(spark, str(tmp_path / "s")).count() == 10
    assert {r.vec[0] for r in corpora.read_segments(spark, str(tmp_path / "s"), [0]).collect()} == {9.0}


def run_stream(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, 3), (1, 10), (2, 5)], "item_id long, seq long").coalesce(1).write.parquet(str(tmp_path / "h"))
    spark.createDataFrame([(1, 9999)], "item_id long, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "h"))
    stream = spark.readStream.schema("item_id long, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "h"))
    got = {}
    for r in run_stream(state.heat_stream(stream, 10_000.0), "heat", "update"):
        got[r.item_id] = max(got.get(r.item_id, (0, 0.0)), (r.clock, r.heat))
    assert got[1][1] == pytest.approx(1 + 2 ** (-9996 / 10_000) + 2 ** (-9989 / 10_000))
    rows = [(1, 0.0, "claim", 1), (1, 5.0, "claim", 2), (1, 40.0, "claim", 3), (1, 41.0, "publish", 1), (1, 42.0, "publish", 3), (1, 43.0, "claim", 4)]
    spark.createDataFrame(rows, "item_id long, t double, kind string, fence long").coalesce(1).write.parquet(str(tmp_path / "l"))
    leases = state.lease_stream(spark.readStream.schema("item_id long, t double, kind string, fence long").parquet(str(tmp_path / "l")), 30.0)
    assert [r.outcome for r in run_stream(leases, "leases", "update")] == ["claimed", "refused", "claimed", "stale", "published", "refused"]


def test_request_windows(spark):
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parquet*")
    assert sum(r.n for r in run_stream(state.request_windows(events, "1 hour", "1 hour"), "windows", "complete")) == 1000


def test_native_log(spark, tmp_path):
    parts = [wal.native_record(i, 5, [float(i), 0.5]) for i in range(5)]
    parts[3] = parts[3][:-1] + b"x"
    (tmp_path / "n").write_bytes(b"".join(parts) + b"torn")
    got = wal.read_native(spark, str(tmp_path / "n"), 2).orderBy("pos").collect()
    assert [(r.item_id, r.fence, r.vec) for r in got] == [(i, 5, [float(i), 0.5]) for i in range(3)]


def test_snapshot(spark, tmp_path):
    root = f"file://{tmp_path}"
    lifecycle.snapshot({"a": spark.range(3)}, root, 1)
    lifecycle.snapshot({"a": spark.range(7)}, root, 2)
    spark.range(9).write.parquet(f"{root}/seq=000000000003/a")
    assert lifecycle.restore(spark, root)["a"].count() == 7


def test_certify_in_sql(spark):
    from driftline.functions import udtf

    udtf.register(spark)
    rows = candidates(np.random.default_rng(8), 20, 12)
    for q in range(20):
        own = [r for r in rows if r["qid"] == q]
        text = lambda f: "array(" + ", ".join(f(r) for r in own) + ")"
        number = lambda c: text(lambda r: "double('Infinity')" if math.isinf(r[c]) else f"{r[c]}D")
        got = spark.sql(f"SELECT * FROM certify({number('d')}, {text(lambda r: str(r['exact']))}, {number('w')}, {text(lambda r: str(r['item_id']))}, 4)").first()
        assert tuple(got) == naive_certificate(own, 4)


def test_numbered(spark):
    rows = spark.range(1000).withColumn("p", F.col("id") % 7)
    got = rank.numbered(rows.repartition(5), [F.desc("p"), F.col("id")], "n").orderBy("n").collect()
    assert [(r.n, r.id) for r in got] == [(i + 1, j) for i, j in enumerate(sorted(range(1000), key=lambda j: (-(j % 7), j)))]
    assert rank.numbered(rows.limit(0), [F.col("id")], "n").count() == 0


def test_running_total_and_blocks(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    want, total = {}, 0
    for r in sorted(rows.collect()):
        want[r.k] = total
        total += r.v
    assert {r.k: r.at for r in rank.running_total(rows.repartition(5), [F.col("k")], "v", "at").collect()} == want
    log = spark.range(1, 1001).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 > 0, (F.col("id") * 7 % 11) / 10.0 * F.col("id") / 1000).alias("bound"))
    values = [1.0 if r.bound is None else r.bound for r in log.orderBy("seq").collect()]
    for size, target in ((20, 0.7), (1, 1.0), (300, 0.55), (20, 9.0)):
        hit = next((i + 1 for i in range(size - 1, 1000) if round(np.mean(values[i + 1 - size : i + 1]), 9) >= target), None)
        assert evaluation.moving_bound(log.repartition(3), size, target, 25).first().seq == hit


def test_budget_table(spark):
    rows = [("a", 0.0, 0.2), ("a", 1.0, 0.6), ("a", 2.0, None), ("a", 3.0, 1.0), ("b", 1.0, 0.9)]
    got = {r.method: tuple(r)[1:] for r in evaluation.budget_table(spark.createDataFrame(rows, "method string, budget double, value double"), 0.5, [0.8, 2.0]).collect()}
    assert got == {"a": (0.4, 2.0, None), "b": (0.9, None, None)}
