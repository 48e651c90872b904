import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbweave.operators import neighbours as N
from orbweave.operators import sampling, validation
from orbweave.operators.schedule import Schedule

POINT = "id long, x float, y float, z float"


def cloud(n, seed=1, kind="uniform"):
    rng = random.Random(seed)
    if kind == "uniform":
        return [(i, rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(n)]
    if kind == "lattice":
        return [(i, float(rng.randrange(4)), float(rng.randrange(4)), 0.0) for i in range(n)]
    return [(i, rng.gauss(0, 0.01) if i % 3 else rng.uniform(-900, 900), rng.gauss(0, 0.01), 0.0) for i in range(n)]


def brute(points, queries, k, exclude_self=False):
    p = np.array([r[1:] for r in points], np.float32)
    ids = np.array([r[0] for r in points])
    out = []
    for q in queries:
        d = p - np.array(q[1:], np.float32)
        d2 = (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2]
        keep = d2 > 1e-10 if exclude_self else d2 >= 0
        near = sorted(zip(d2[keep].tolist(), ids[keep].tolist()))[:k]
        out += [(q[0], r, i, d) for r, (d, i) in enumerate(near, 1)]
    return out


def rows(df):
    return sorted((r["qid"], r["rank"], r["id"], r["d2"]) for r in df.collect())


@pytest.mark.parametrize("method", ["blocks", "grid"])
@pytest.mark.parametrize("kind", ["uniform", "lattice", "dense"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_knn(spark, method, kind, exclude_self):
    points = cloud(600, 2, kind)
    queries = points[::20] + [(10_000, 700.0, 1.0, 2.0)]
    p, q = spark.createDataFrame(points, POINT), spark.createDataFrame(queries, POINT)
    assert rows(N.knn(p, q, 7, exclude_self=exclude_self, method=method)) == brute(points, queries, 7, exclude_self)


@pytest.mark.parametrize("schedule", [Schedule(heuristic="fixed", fixed_radius=1e-3), Schedule(heuristic="fixed", fixed_radius=1e6), Schedule(heuristic="max"), Schedule(percentile=0.9, multiplier=1.5), Schedule(max_rounds=1)])
def test_a_schedule_never_changes_the_result(spark, schedule):
    points = cloud(300, 3)
    p = spark.createDataFrame(points, POINT)
    assert rows(N.knn_grid(p, p.where("id < 40"), 5, schedule)) == brute(points, points[:40], 5)


def test_blocks_and_partitions_do_not_matter(spark):
    points = cloud(300, 4, "lattice")
    p = spark.createDataFrame(points, POINT)
    assert rows(N.knn_blocks(p.repartition(5), p, 4, block=37)) == brute(points, points, 4)


def test_fewer_points_than_k_and_none(spark):
    points = cloud(3)
    p, none = spark.createDataFrame(points, POINT), spark.createDataFrame([], POINT)
    for method in ("blocks", "grid"):
        assert rows(N.knn(p, p, 5, method=method)) == brute(points, points, 5)
        assert N.knn(p, none, 5, method=method).count() == 0 and N.knn(none, p, 5, method=method).count() == 0
    with pytest.raises(ValueError):
        N.knn(p, p, 0)


def test_a_very_large_k_needs_no_more_memory(spark, monkeypatch):
    points = cloud(300, 4, "lattice")
    p = spark.createDataFrame(points, POINT)
    for method in ("blocks", "grid"):
        assert rows(N.knn(p, p.where("id < 20"), 10**9, method=method)) == brute(points, points[:20], 10**9)
    monkeypatch.setattr(N, "KEPT", 0)
    monkeypatch.setattr(N, "HELD", 1)
    batches = [b for b in p.toArrow().to_batches(max_chunksize=60)]
    sent = type("Sent", (), {"value": (np.arange(20), np.array([r[1:] for r in points[:20]], np.float32))})
    for k, exclude_self in ((7, False), (7, True), (100, False)):
        found = [r for b in N._wide_scan(sent, k, exclude_self)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert len(found) <= 20 * min(k, 60) * len(batches)
        best = [(q, r, i, d) for q in range(20) for r, (d, i) in enumerate(sorted((d, i) for at, i, d in found if at == q)[:k], 1)]
        assert best == brute(points, points[:20], k, exclude_self)


@pytest.mark.parametrize("k", [1_500, 10**9])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_a_large_k_shuffles_no_pairs(spark, monkeypatch, k, exclude_self):
    points = [(i, *at) for i, *at in cloud(2_000, 8, "lattice")]
    random.Random(9).shuffle(points)
    queries = points[:90] + [(10_000, 700.0, 1.0, 2.0)]
    p, q = spark.createDataFrame(points, POINT), spark.createDataFrame(queries, POINT)
    monkeypatch.setattr(N, "TOGETHER", 3)  # several lists of queries at one place
    found = N.knn_blocks(p, q, k, exclude_self)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1 and plan.index("MapInArrow") < plan.index("Exchange")  # of the queries, before they meet points
    assert rows(found) == sorted(brute(points, queries, k, exclude_self))
    monkeypatch.setattr(N, "RANKED", 1_999)  # more than are sent
    assert rows(N.knn_blocks(p, q.where("id < 60"), k, exclude_self)) == sorted(brute(points, [x for x in queries if x[0] < 60], k, exclude_self))


def test_ranked_runs_are_whole_and_short(monkeypatch):
    monkeypatch.setattr(N, "ROWS", 100)
    monkeypatch.setattr(N, "RUN", 7)
    points = cloud(300, 10, "lattice")
    sent = type("Sent", (), {"value": (np.arange(300), np.array([r[1:] for r in points], np.float32))})
    asked = pa.table([pa.array([5, 9, 200, 300]), *(pa.array([1.0, 1.0, 0.5, 1.0], pa.float32()) for _ in "xyz")], names=["qid", "qx", "qy", "qz"])
    together = N._asked_together(asked)
    assert together.column("qids").to_pylist() == [[200], [5, 9, 300]] and together.column("part").to_pylist() == [0, 1]
    for k in (20, 1_000):
        found, sizes = [], set()
        for b in N._ranking(sent, k, False)(together.to_batches()):
            (qids, low, ids, d2s), = zip(*(c.to_pylist() for c in b.columns))
            sizes.add((len(qids), len(ids)))
            found += [(q, low + at, i, d) for q in qids for at, (i, d) in enumerate(zip(ids, d2s), 1)]
        assert all(n * m <= 100 for n, m in sizes)
        assert sorted(found) == brute(points, [(q, *(0.5 if q == 200 else 1.0 for _ in "xyz")) for q in (5, 9, 200, 300)], k)


@pytest.mark.parametrize("scale", [1.0, 1e-25, 1e18])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_block_scans_skip_only_far_tiles(monkeypatch, scale, exclude_self):
    rng = np.random.default_rng(6)
    at = np.round(np.concatenate([rng.normal(size=(3_000, 3)) + c for c in (0, 50, 100)]) * 4).astype(np.float32) * np.float32(scale)
    points = [(i, *(float(x) for x in row)) for i, row in enumerate(at)]
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + 1_000)), *(pa.array(np.ascontiguousarray(at[low : low + 1_000, i])) for i in range(3))], ["id", "x", "y", "z"]) for low in range(0, 9_000, 1_000)]
    asked = points[::30]
    pairs, squares = [], N._squares
    monkeypatch.setattr(N, "_squares", lambda a, b, *rest: pairs.append(len(a) * len(b)) or squares(a, b, *rest))
    monkeypatch.setattr(N, "HELD", 4_000)
    sent = type("Sent", (), {"value": (np.arange(0, 9_000, 30), at[::30])})
    with np.errstate(over="ignore"):
        found = [r for b in N._block_scan(sent, 5, exclude_self)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        ranked = [(q[0], r, i, d) for q in asked for r, (d, i) in enumerate(sorted((d, i) for at, i, d in found if at == q[0]), 1)]
        assert ranked == brute(points, asked, 5, exclude_self)
    if scale == 1:
        assert sum(pairs) < len(asked) * len(points) / 1.5


def test_a_task_orders_its_points_once(monkeypatch):
    at = np.round(np.random.default_rng(12).normal(size=(9_000, 3)) * 9).astype(np.float32)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + 500)), *(pa.array(np.ascontiguousarray(at[low : low + 500, i])) for i in range(3))], ["id", "x", "y", "z"]) for low in range(0, 9_000, 500)]
    points = [(i, *(float(x) for x in row)) for i, row in enumerate(at)]
    sent = type("Sent", (), {"value": (np.arange(0, 9_000, 90), at[::90])})
    ordered, curve = [], N._curve
    monkeypatch.setattr(N, "_curve", lambda where: ordered.append(len(where)) or curve(where))
    monkeypatch.setattr(N, "HELD", 1_500)
    for times, held in ((8, [9_000]), (2, [3_000] * 3)):
        monkeypatch.setattr(N, "ORDERED", times, raising=False)
        ordered.clear()
        found = [r for b in N._block_scan(sent, 5, False)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert ordered == [100, *held]
        assert [(q[0], r, i, d) for q in points[::90] for r, (d, i) in enumerate(sorted((d, i) for a, i, d in found if a == q[0]), 1)] == brute(points, points[::90], 5)


def test_queries_of_a_scan(spark):
    p = spark.range(100).selectExpr("id", "float(id) AS x", "0F AS y", "0F AS z")
    for n, scans in ((0, 1), (180_000, 1), (300_000, 2)):
        found = N.knn_blocks(p, p.sparkSession.range(n).selectExpr("id", "float(id % 100) AS x", "0F AS y", "0F AS z"), 5)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == scans
    assert N.knn_blocks(p, p.where("id < 7"), 1, block=3).select("qid", "id").orderBy("qid").collect() == [(i, i) for i in range(7)]
    assert N.knn_blocks(p, p.where("id < 0"), 1).count() == 0


def test_many_points_at_one_place(spark):
    points = [(i, 1.0, 1.0, 1.0) for i in range(500)] + [(500 + i, float(i), 0.0, 0.0) for i in range(20)]
    p = spark.createDataFrame(points, POINT)
    assert N.thinned(p, 3).count() == 23
    assert rows(N.knn_grid(p, p.where("id % 50 = 0"), 3)) == brute(points, points[::50], 3)


def test_radius_join_includes_its_surface(spark):
    points = [(0, 0.0, 0.0, 0.0), (1, 3.0, 4.0, 0.0), (2, 3.0, 4.0, 0.001), (3, -5.0, 0.0, 0.0), (4, 0.0, 0.0, 0.0)]
    p = spark.createDataFrame(points, POINT)
    q = p.where("id = 0")
    assert sorted(r["id"] for r in N.radius_join(p, q, 5).collect()) == [0, 1, 3, 4]
    assert sorted(r["id"] for r in N.radius_ids(p, q, 0).collect()) == [0, 4]
    assert {(r["qid"], r["n_hits"]) for r in N.radius_counts(p, p, 0.0005).collect()} == {(0, 2), (1, 1), (2, 1), (3, 1), (4, 2)}
    capped = N.radius_capped(p, q, 5, 2).collect()
    assert sorted((r["rank"], r["id"], r["n_hits"]) for r in capped) == [(1, 0, 4), (2, 4, 4)]


def test_radius_join_equals_brute_force(spark):
    points = cloud(800, 5)
    p = spark.createDataFrame(points, POINT)
    for radius in (0.3, 1.0, 50.0):
        got = {(r["qid"], r["id"]) for r in N.radius_join(p, p.where("id < 60"), radius).collect()}
        assert got == {(q, i) for q, _, i, d in brute(points, points[:60], 800) if np.float32(d) <= np.float32(radius) * np.float32(radius)}


def test_radius_of_a_stream(spark, tmp_path):
    from orbweave.streaming import radius_stream

    points = cloud(200, 6)
    p = spark.createDataFrame(points, POINT)
    p.where("id < 30").write.parquet(f"{tmp_path}/q")
    stream = radius_stream(spark.readStream.schema(p.schema).parquet(f"{tmp_path}/q"), p, 2.0)
    run = stream.writeStream.format("memory").queryName("near").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("near").collect())) == sorted(map(tuple, N.radius_join(p, p.where("id < 30"), 2.0).collect()))


def test_radii(spark):
    kth = spark.createDataFrame([(i, float(10 - i)) for i in range(10)], "qid long, dist float")
    assert N.radius_percentile(kth, 0.1).first()[0] == 2.0 * 1.1 and N.radius_percentile(kth, 1.0).first()[0] == 10.0 * 1.1
    assert N.radius_max(kth).first()[0] == 10.0 * 1.1 and N.radius_percentile(kth.limit(0), 0.5).first()[0] is None


def test_samples(spark):
    p = spark.range(1_000)
    assert [r[0] for r in sampling.stride_sample(p, 1_000, 4).orderBy("id").collect()] == [0, 250, 500, 750]
    assert sampling.stride_sample(p, 1_000, 5_000).count() == 1_000 and sampling.every_nth(p).count() == 100 and sampling.prefix(p, 7).count() == 7
    assert sampling.random_sample(p, 30).count() == 30 and sampling.random_sample(p.limit(5), 30).count() == 5
    assert 60 < sampling.hashed_sample(p, 100).count() < 140 and sampling.hashed_sample(p, 5_000).count() == 1_000
    state = (sampling.LCG_SEED * sampling.LCG_A + sampling.LCG_C) % 2**64
    assert sampling.lcg_values(1, 1_000) == [(state >> 33) % 1_000]
    drawn = sampling.lcg_sample(p, 50, 1_000).orderBy("draw").collect()
    assert [r["id"] for r in drawn] == sampling.lcg_values(50, 1_000)


def test_validation(spark):
    points = cloud(200, 7)
    p = spark.createDataFrame(points, POINT)
    truth = N.knn(p, p.where("id < 20"), 5)
    assert validation.match_ratio(truth, truth).first()["ratio"] == 1.0 and validation.count_ok(truth, 20, 5)
    wrong = truth.selectExpr("qid", "rank", "CASE WHEN qid = 3 THEN id + 1000 ELSE id END AS id", "CAST(CASE WHEN qid = 3 THEN d2 + 1 ELSE d2 END AS FLOAT) AS d2")
    assert validation.match_ratio(wrong, truth).first()["matching"] == 19
    same_far = truth.selectExpr("qid", "rank", "CASE WHEN qid = 3 THEN id + 1000 ELSE id END AS id", "d2")
    assert validation.match_ratio(same_far, truth).first()["matching"] == 20
    assert [r["qid"] for r in validation.close_distances(wrong, truth).where("not ok").collect()] == [3]
    assert {r["qid"] for r in validation.failures(wrong, truth).collect()} == {3}
    assert validation.match_ratio(truth.where("qid != 4"), truth).first()["matching"] == 19


def test_thousands_of_queries_share_a_scan(spark):
    p = spark.range(20_000).selectExpr("id", "float(id % 100) AS x", "float(id % 7) AS y", "float(0) AS z")
    found = N.knn_blocks(p, p.where("id < 9000"), 1)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found.where("d2 = 0").count() == 9_000


def test_lists_are_read_once_to_be_compared(spark):
    p = spark.createDataFrame(cloud(200, 8), POINT)
    lazy = N.knn(p, p.where("id < 20"), 5)
    found = validation.match_ratio(spark.createDataFrame([(0, 1, 0, 0.0)], "qid long, rank long, id long, d2 float"), lazy)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    truth = spark.createDataFrame([(1, 1, 5, 1.0), (1, 2, 6, 4.0), (2, 1, 7, 1.0), (3, 1, 8, 9.0), (4, 1, 9, 1.0)], "qid long, rank long, id long, d2 float")
    other = spark.createDataFrame([(1, 1, 6, 1.0), (1, 2, 5, 4.0), (2, 1, 7, 1.0), (2, 2, 8, 1.0), (3, 1, 1, 9.1), (5, 1, 5, 1.0)], truth.schema)
    assert {r["qid"]: (r["same_ids"], r["ok"]) for r in validation.matches(other, truth).collect()} == {1: (False, True), 2: (False, False), 3: (False, False), 4: (False, False)}


@pytest.mark.parametrize("exclude_self", [False, True])
def test_many_queries_look_at_their_own_slab(spark, exclude_self):
    rng = np.random.default_rng(12)
    at = np.concatenate((np.round(rng.uniform(0, 300, (5_600, 3)) * (1, 0.1, 0.1)), rng.normal(size=(400, 3)))).astype(np.float32)
    points = [(i, *map(float, row)) for i, row in enumerate(at)]
    p = spark.createDataFrame(points, POINT)
    found = N.knn_blocks(p, p.where("id < 5000"), 3, exclude_self)
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found) == brute(points, points[:5_000], 3, exclude_self)


def test_limits_hold_k_points_and_skip_other_slabs(monkeypatch):
    rng = np.random.default_rng(13)
    at = rng.uniform(0, 100, (3_000, 3)).astype(np.float32)
    asked = at[::3]
    limits = N._limits(asked, at[::10], 4, False)
    d2 = ((asked[N._curve(asked)][:, None].astype(float) - at[None, ::10]) ** 2).sum(axis=2)
    assert (np.sort(d2, axis=1)[:, 3] <= np.repeat(limits, N.QUERY_TILE)[: len(asked)]).all() and np.isfinite(limits).all()
    assert np.isinf(N._limits(asked, at[:3], 4, False)).all()
    pairs, squares = [], N._squares
    monkeypatch.setattr(N, "_squares", lambda a, b, *rest: pairs.append(len(a) * len(b)) or squares(a, b, *rest))
    far = at + np.float32(1_000)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3_000)), *(pa.array(np.ascontiguousarray(far[:, i])) for i in range(3))], ["id", "x", "y", "z"])
    sent = type("Sent", (), {"value": (np.arange(1_000), asked, limits)})
    assert not list(b for b in N._block_scan(sent, 4, False)(iter([batch])) if b.num_rows) and not pairs


def test_failures_are_joined_by_the_failing_queries_only(spark):
    truth = spark.createDataFrame([(q, r, 10 * q + r, float(r)) for q in range(1, 40) for r in (1, 2)], "qid long, rank long, id long, d2 float")
    wrong = truth.where("not (qid = 7 and rank = 2)").withColumn("d2", F.when((F.col("qid") % 5 == 0) & (F.col("rank") == 2), 9.0).otherwise(F.col("d2")).cast("float"))
    wrong = wrong.withColumn("id", F.when(F.col("qid") % 5 == 0, -F.col("id")).otherwise(F.col("id")))
    found = validation.failures(wrong, truth)
    rows = [tuple(r) for r in found.collect()]
    assert rows == [(5, 1, -51, 1.0, 51, 1.0), (5, 2, -52, 9.0, 52, 2.0), (7, 1, 71, 1.0, 71, 1.0), (7, 2, None, None, 72, 2.0), (10, 1, -101, 1.0, 101, 1.0), (10, 2, -102, 9.0, 102, 2.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("FullOuter") < plan.index("LeftSemi") and plan.count("LeftSemi") == 2
    assert validation.matches(wrong, truth)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + validation.matches(wrong, truth)._jdf.queryExecution().executedPlan().toString().count("Exchange SinglePartition") <= 1
