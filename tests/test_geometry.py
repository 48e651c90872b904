import math
import random

import pytest
from pyspark.sql import functions as F

from orbweave.functions import morton
from orbweave.functions import vectors as V
from orbweave.functions.geometry import Box, Ray, Sphere, ray_hits_box
from orbweave.operators import ordering, rays


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_vectors(spark):
    a, b, zero = V.vec(3, 4, 0), V.vec(1, 2, 2), V.vec(0, 0, 0)
    assert one(spark, V.length(a), V.distance(a, b), V.dot(a, b)) == (5.0, pytest.approx(math.sqrt(12), rel=1e-6), 11.0)
    assert one(spark, *V.cross(a, b)) == (8.0, -6.0, 2.0) and one(spark, *V.normalize(a)) == (pytest.approx(0.6), pytest.approx(0.8), 0.0)
    assert one(spark, *V.normalize(zero)) == (0, 0, 0) and one(spark, *V.divide(a, 2)) == (1.5, 2, 0)
    over = one(spark, *V.divide(V.vec(3, -4, 0), 0))
    assert over[:2] == (math.inf, -math.inf) and math.isnan(over[2])
    assert one(spark, *V.least(a, b), *V.greatest(a, b)) == (1, 2, 0, 3, 4, 2) and tuple(one(spark, V.packed(a))[0]) == (3, 4, 0)


def ray(o, d, tmin=0.0, tmax=100.0):
    return Ray(V.vec(*o), V.vec(*d), F.lit(tmin).cast("float"), F.lit(tmax).cast("float"))


def test_rays_and_boxes(spark):
    box = Box(V.vec(-1, -1, -1), V.vec(1, 1, 1))
    hits = lambda r: one(spark, ray_hits_box(r, box))[0]
    assert hits(ray((-5, 0, 0), (1, 0, 0))) and hits(ray((0, 0, 0), (0, 1, 0))) and hits(ray((-5, 1, 1), (1, 0, 0)))
    assert not hits(ray((-5, 2, 0), (1, 0, 0))) and not hits(ray((5, 0, 0), (1, 0, 0))) and not hits(ray((-5, 0, 0), (1, 0, 0), 0, 3))
    assert hits(ray((-5, -5, -5), (1, 1, 1))) and not hits(ray((-5, 0, 0), (1, 0, 0), 7, 9))


def test_rays_and_spheres(spark):
    ball = Sphere(V.vec(0, 0, 0), F.lit(2.0).cast("float"))
    solid = lambda r: one(spark, ball.hit_solid(r))[0]
    assert solid(ray((-5, 0, 0), (1, 0, 0))) == 3 and solid(ray((0, 0, 0), (1, 0, 0))) == 2 and solid(ray((-5, 0, 0), (1, 0, 0), 3.5)) == 7
    assert solid(ray((-5, 3, 0), (1, 0, 0))) is None and solid(ray((5, 0, 0), (1, 0, 0))) is None and solid(ray((0, 0, 0), (0, 0, 0))) is None
    near = lambda p, r: one(spark, ball.with_radius(r).hit(Ray.query(V.vec(*p), 1)))[0]
    assert near((0, 2, 0), 2) == 2 and near((0, 2.1, 0), 2) is None and near((0, 0, 0), 2) == 0


def test_rays_and_triangles(spark):
    prims = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 4.0, 0.0), (2, 0.0, 0.0, 2.0, 4.0, 0.0, 2.0, 0.0, 4.0, 2.0), (3, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 1.0)], "tri_id long, ax float, ay float, az float, bx float, by_ float, bz float, cx float, cy float, cz float")
    shots = spark.createDataFrame([(i, x, y, -1.0, 0.0, 0.0, 1.0, 0.0, t) for i, (x, y, t) in enumerate([(1.0, 1.0, 9.0), (5.0, 5.0, 9.0), (1.0, 1.0, 2.0), (1.0, 1.0, 3.0), (0.0, 0.0, 9.0)])], "ray_id long, ox float, oy float, oz float, dx float, dy float, dz float, tmin float, tmax float")
    hits = rays.trace(shots, prims, rays.triangles(), "tri_id")
    assert sorted(map(tuple, hits.collect())) == [(0, 1, 1), (0, 2, 3), (2, 1, 1), (3, 1, 1), (4, 1, 1), (4, 2, 3)]
    anywhere = rays.trace(shots, prims, rays.triangles().hit, "tri_id", block=1)
    assert sorted(map(tuple, anywhere.collect())) == sorted(map(tuple, hits.collect()))
    assert sorted(map(tuple, rays.closest_hit(hits).collect())) == [(0, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1)]
    ended = rays.any_hit(hits, terminate=F.col("prim_id") == 2)
    assert ended.count() == 6 and {r["ray_id"] for r in rays.closest_hit(ended).collect()} == {2, 3}
    assert rays.any_hit(hits, keep=F.col("prim_id") == 2).count() == 2
    assert {r["ray_id"]: r["value"] for r in rays.outcome(shots, hits, F.col("prim_id"), F.lit(-1)).collect()} == {0: 1, 1: -1, 2: 1, 3: 1, 4: 1}
    assert rays.triangle_buffers(prims).count() == 9


def spread(x, y, z):
    return sum((x >> b & 1) << 3 * b + 2 | (y >> b & 1) << 3 * b + 1 | (z >> b & 1) << 3 * b for b in range(10))


def test_morton(spark):
    rng = random.Random(1)
    cells = [(rng.randrange(1024), rng.randrange(1024), rng.randrange(1024)) for _ in range(50)] + [(1023, 1023, 1023), (0, 0, 0)]
    df = spark.createDataFrame(cells, "x long, y long, z long")
    assert [r[-1] for r in df.select("*", morton.code(F.col("x"), F.col("y"), F.col("z"))).collect()] == [spread(*c) for c in cells]


def test_morton_order(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0.0, 1.0, rng.random()]), rng.random(), 7.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x float, y float, z float")
    ordered = [r["id"] for r in ordering.morton_sorted(df).collect()]
    assert [r["id"] for r in ordering.morton_ranked(df).orderBy("position").collect()] == ordered
    assert ordering.morton_codes(df.limit(0)).count() == 0 and ordering.morton_codes(df.limit(1)).first()["code"] == 0
    assert tuple(ordering.bounding_box(df.limit(0)).first()) == (None,) * 6


@pytest.mark.parametrize("finest", [1, 7, 1_024])
def test_rays_of_any_direction_meet_what_they_hit(spark, monkeypatch, finest):
    """Geometries of very different sizes, rays along axes, of no direction, from within and without end; all pairs tested is the truth."""
    monkeypatch.setattr(rays, "FINEST", finest)
    rng = random.Random(4)
    at = lambda r: tuple(rng.uniform(-r, r) for _ in range(3))
    shots = [(i, *at(15), *rng.choice([at(1), (0.0, 0.0, 1.0), (0.0, -2.0, 0.0), (0.0, 0.0, 0.0), (1.0, 1.0, 0.0)]), rng.choice([0.0, 2.0]), rng.choice([1.0, 9.0, 1e30, float("inf")])) for i in range(60)]
    shots = spark.createDataFrame(shots, "ray_id long, " + ", ".join(f"{c} float" for c in ("ox", "oy", "oz", "dx", "dy", "dz", "tmin", "tmax")))
    corners = lambda c, r: [x for _ in range(3) for x in (p + rng.uniform(-r, r) for p in c)]
    tris = spark.createDataFrame([(i, *corners(at(12), rng.choice([0.01, 1.0, 12.0]))) for i in range(80)], "tri_id long, " + ", ".join(f"{c} float" for c in ("ax", "ay", "az", "bx", "by_", "bz", "cx", "cy", "cz")))
    balls = spark.createDataFrame([(i, *at(12), rng.choice([0.05, 1.0, 6.0])) for i in range(80)], "prim_id long, x float, y float, z float, radius float")
    for prims, shape, hit, name in ((tris, rays.triangles(), rays.triangles().hit, "tri_id"), (balls, rays.solid_spheres(), rays.spheres().hit_solid, "prim_id"), (balls, rays.spheres(), rays.spheres().hit, "prim_id")):
        want = sorted(map(tuple, rays.trace(shots, prims, hit, name).collect()))
        assert sorted(map(tuple, rays.trace(shots, prims, shape, name).collect())) == want and len(want) > 5
        assert rays.trace(shots, prims.limit(0), shape, name).count() == rays.trace(shots.limit(0), prims, shape, name).count() == 0
    plan = rays.trace(shots, tris, rays.triangles(), "tri_id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
