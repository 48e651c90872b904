import random

import pytest
from pyspark.sql import functions as F

from orbweave.operators import bvh, index, neighbours, rays
from orbweave.plans import programs as P

SIDES = ("lx", "ly", "lz", "hx", "hy", "hz")


def made_up(n, seed=1):
    rng = random.Random(seed)
    low = [[rng.choice([0.0, rng.uniform(0, 50)]) for _ in range(3)] for _ in range(n)]
    return [(i, *a, *(x + rng.choice([0.0, 1.0, 2.0]) for x in a)) for i, a in enumerate(low)]


def recursive(rows, key=""):
    box = [min(r[i] for r in rows) for i in (1, 2, 3)] + [max(r[i] for r in rows) for i in (4, 5, 6)]
    wide = [box[i + 3] - box[i] for i in range(3)]
    axis = 1 if wide[1] > wide[0] else 0
    if wide[2] > wide[1] and wide[2] > wide[0]:
        axis = 2
    at = lambda r: (r[axis + 1] + r[axis + 4]) * 0.5
    left = [r for r in rows if at(r) < (box[axis] + box[axis + 3]) * 0.5]
    right = [r for r in rows if r not in left]
    leaf = len(rows) <= 2 or not left or not right
    yield key, len(rows), box, sorted(r[0] for r in rows) if leaf else None
    if not leaf:
        yield from recursive(left, key + "0")
        yield from recursive(right, key + "1")


def test_hierarchy(spark):
    rows = [tuple(r[:1]) + tuple(float(int(x)) for x in r[1:]) for r in made_up(60)] + [(100 + i, *([7.0] * 6)) for i in range(5)]
    df = spark.createDataFrame(rows, "prim_id long, " + ", ".join(f"{s} float" for s in SIDES))
    tree = bvh.build(df)
    nodes, members = {r["key"]: r for r in tree.nodes.collect()}, {}
    for r in tree.members.collect():
        members.setdefault(r["key"], []).append(r["prim_id"])
    want = list(recursive(rows))
    assert len(want) == len(nodes)
    for key, n, box, leaf in want:
        assert nodes[key]["n"] == n and [nodes[key][s] for s in SIDES] == box and nodes[key]["is_leaf"] == (leaf is not None)
        assert leaf is None or sorted(members[key]) == leaf
    assert bvh.build(df.limit(0)).nodes.count() == 0


def test_point_index(spark):
    rng = random.Random(2)
    p = spark.createDataFrame([(i, rng.random(), rng.random(), 0.0) for i in range(100)], "id long, x float, y float, z float")
    q = p.where("id < 9")
    with_index = index.PointIndex(p)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(with_index.knn(q, 3), neighbours.knn(p, q, 3)) and same(with_index.knn(q, 3, True, "grid"), neighbours.knn(p, q, 3, exclude_self=True))
    for r in (0.05, 0.3):
        assert same(with_index.radius(q, r), neighbours.radius_join(p, q, r)) and same(with_index.capped(q, r, 2), neighbours.radius_capped(p, q, r, 2))
    with_index.replace(q)
    assert with_index.radius(q, 10).count() == 81
    index.close_all()
    assert not index._open


@pytest.fixture(scope="module")
def scene(spark):
    balls = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 5.0, 0.0, 0.0, 1.0), (3, 10.0, 0.0, 0.0, 1.0)], "prim_id long, x float, y float, z float, radius float")
    shots = spark.createDataFrame([(1, -5.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 99.0), (2, 4.0, 0.0, 9.0, 0.0, 0.0, 1.0, 0.0, 99.0), (3, 7.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 99.0)], "ray_id long, ox float, oy float, oz float, dx float, dy float, dz float, tmin float, tmax float")
    return shots, balls


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_programs(scene):
    run = lambda *steps, miss=(): P.Trace(rays.spheres().hit_solid, steps, miss).run(*scene)
    assert got(run(), "ray_id", "prim_id", "t") == [(1, 1, 4.0), (1, 2, 9.0), (1, 3, 14.0), (2, None, None), (3, 3, 2.0)]
    assert got(run(P.Ignore(F.col("prim_id") == 2)), "ray_id", "prim_id") == [(1, 1), (1, 3), (2, None), (3, 3)]
    assert got(run(P.Terminate(F.col("t") > 8)), "ray_id", "prim_id") == [(1, 1), (1, 2), (2, None), (3, 3)]
    assert got(run(P.Update("sum", F.col("t"), running=True)), "ray_id", "sum") == [(1, 13.0), (1, 27.0), (1, 4.0), (2, None), (3, 2.0)]
    assert got(run(P.Push(F.col("prim_id"), 2), miss=[P.Update("n", F.lit(0).cast("bigint"))]), "ray_id", "pushed", "n") == [(1, [1, 2], 3), (2, None, 0), (3, [3], 1)]
    branch = P.If(F.col("t") < 5, [P.Update("near", F.lit(True))], [P.Block([P.Update("near", F.lit(False)), P.Ignore(F.col("prim_id") == 3)])])
    assert got(run(branch), "ray_id", "prim_id", "near") == [(1, 1, True), (1, 2, False), (2, None, None), (3, 3, True)]
    assert got(run(P.Sql("SELECT ray_id, max(t) AS t FROM {rows} GROUP BY ray_id")), "ray_id", "t") == [(1, 14.0), (2, None), (3, 2.0)]
