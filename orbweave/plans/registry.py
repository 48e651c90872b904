"""Named queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions import vectors as V
from orbweave.functions.geometry import Box, Ray
from orbweave.operators import bvh, nbody, neighbours, octree, ordering, rays, sampling, validation
from orbweave.operators.schedule import Schedule
from orbweave.plans import programs
from orbweave.plans.views import asked, duck, view
from orbweave.session import table
from orbweave.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


D2 = "CAST(((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y))+(p.z-q.z)*(p.z-q.z) AS FLOAT)"


# vectors and boxes

_PAIRS = f"{duck('points_emb')}, pairs AS (SELECT a.id, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM points_emb a JOIN points_emb b ON b.id = a.id + 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "points_emb")
    a = p.select("id", *(F.col(c).alias("a" + c) for c in "xyz"))
    b = p.select((F.col("id") - 1).alias("id"), F.col("x").alias("bx"), F.col("y").alias("by_"), F.col("z").alias("bz"))
    return a.join(b, "id")


_A, _B = ("ax", "ay", "az"), ("bx", "by_", "bz")
_NORM = "CAST(sqrt(CAST(ax*ax+ay*ay+az*az AS FLOAT)) AS FLOAT)"


def _named(**vectors) -> list:
    """Columns name_x, name_y and name_z of vectors."""
    return [c.alias(f"{name}_{axis}") for name, v in vectors.items() for c, axis in zip(v, "xyz")]


def _each(name: str, form: str) -> str:
    """The same in SQL; ``@`` stands for the axis, and the second vector's y is by_."""
    return ", ".join(form.replace("b@", "by_" if c == "y" else "b@").replace("@", c) + f" AS {name}_{c}" for c in "xyz")


_FLAT = lambda value: f"CAST({value} AS FLOAT)"


@query(
    "vec3_scalar",
    f"""WITH {_PAIRS}
SELECT id, {_NORM} AS length, CAST(sqrt(CAST((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)+(az-bz)*(az-bz) AS FLOAT)) AS FLOAT) AS distance,
  CAST(ax*bx+ay*by_+az*bz AS FLOAT) AS dot, ay*bz-az*by_ AS cross_x, az*bx-ax*bz AS cross_y, ax*by_-ay*bx AS cross_z,
  {_each("unit", f"round(CAST(CASE WHEN {_NORM} > 0 THEN CAST(CAST(a@ AS DOUBLE)/{_NORM} AS FLOAT) ELSE a@ END AS DOUBLE), 5)")}, {_each("sum", "a@+b@")}, {_each("diff", "a@-b@")},
  {_each("twice", f"a@*{_FLAT(2)}")}, {_each("quarter", "round(CAST(CAST(CAST(a@ AS DOUBLE)/4 AS FLOAT) AS DOUBLE), 5)")}, {_each("least", "least(a@,b@)")}, {_each("greatest", "greatest(a@,b@)")} FROM pairs""",
)
def vec3_scalar(spark, sf_dir):
    a, b = V.vec(*_A), V.vec(*_B)
    rounded = lambda v: tuple(F.round(c.cast("double"), 5) for c in v)
    vectors = _named(cross=V.cross(a, b), unit=rounded(V.normalize(a)), sum=V.add(a, b), diff=V.sub(a, b), twice=V.scale(a, 2), quarter=rounded(V.divide(a, 4)), least=V.least(a, b), greatest=V.greatest(a, b))
    return _pairs(spark, sf_dir).select("id", V.length(a).alias("length"), V.distance(a, b).alias("distance"), V.dot(a, b).alias("dot"), *vectors)


@query(
    "aabb_scalar",
    f"""WITH {_PAIRS}
SELECT id, {_each("low", "least(a@,b@)")}, {_each("high", "greatest(a@,b@)")}, {_each("center", f"(least(a@,b@)+greatest(a@,b@))*{_FLAT(0.5)}")},
  {_each("merged_low", f"least(least(a@,b@), {_FLAT(0)})")}, {_each("merged_high", f"greatest(greatest(a@,b@), {_FLAT(1)})")} FROM pairs""",
)
def aabb_scalar(spark, sf_dir):
    a, b = V.vec(*_A), V.vec(*_B)
    box = Box(a, a).grow(b)
    merged = box.merge(Box(V.vec(0, 0, 0), V.vec(1, 1, 1)))
    return _pairs(spark, sf_dir).select("id", *_named(low=box.low, high=box.high, center=box.center(), merged_low=merged.low, merged_high=merged.high))


@query("sphere_bounds", f"WITH {duck('points_emb')} SELECT id, {_each('low', f'@-{_FLAT(0.25)}')}, {_each('high', f'@+{_FLAT(0.25)}')}, x AS packed_0, y AS packed_1, z AS packed_2, {_FLAT(0.25)} AS packed_3 FROM points_emb")
def sphere_bounds(spark, sf_dir):
    ball = rays.spheres().with_radius(0.25)
    return view(spark, sf_dir, "points_emb").select("id", *_named(low=ball.bounds().low, high=ball.bounds().high), *(ball.packed()[i].alias(f"packed_{i}") for i in range(4)))


_CORNERS = [f"{p}{'y_' if p + c == 'by' else c}" for p in "abc" for c in "xyz"]


@query("triangle_bounds", f"WITH {duck('triangles')} SELECT tri_id, {_each('low', 'least(a@,b@,c@)')}, {_each('high', 'greatest(a@,b@,c@)')}, {', '.join(f'{c} AS packed_{i}' for i, c in enumerate(_CORNERS))} FROM triangles")
def triangle_bounds(spark, sf_dir):
    shape = rays.triangles()
    return view(spark, sf_dir, "triangles").select("tri_id", *_named(low=shape.bounds().low, high=shape.bounds().high), *(shape.packed()[i].alias(f"packed_{i}") for i in range(9)))


@query(
    "triangle_buffers",
    f"""WITH {duck('triangles')}, corners AS (
  SELECT tri_id, 0 AS corner, ax AS x, ay AS y, az AS z FROM triangles UNION ALL SELECT tri_id, 1, bx, by_, bz FROM triangles UNION ALL SELECT tri_id, 2, cx, cy, cz FROM triangles)
SELECT tri_id, CAST(corner AS BIGINT) AS corner, CAST(3*tri_id+corner AS BIGINT) AS "index", x, y, z FROM corners""",
)
def triangle_buffers(spark, sf_dir):
    return rays.triangle_buffers(view(spark, sf_dir, "triangles"))


@query("bbox_agg", f"WITH {duck('points_ord')} SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM points_ord")
def bbox_agg(spark, sf_dir):
    return ordering.bounding_box(view(spark, sf_dir, "points_ord"))


# rays


def _slab_sql() -> str:
    """Rays and boxes, each axis divided in DOUBLE; an axis that a ray runs along bounds nothing, but the ray has to be in its slab."""
    part = lambda c, side: f"(CAST({side}{c} AS DOUBLE)-o{c})/CAST(d{c} AS DOUBLE)"
    near = lambda c: f"CASE WHEN d{c} = 0 THEN NULL ELSE least({part(c, 'l')}, {part(c, 'h')}) END"
    far = lambda c: f"CASE WHEN d{c} = 0 THEN NULL ELSE greatest({part(c, 'l')}, {part(c, 'h')}) END"
    low, high = (", ".join(f(c) for c in "xyz") for f in (near, far))
    inside = " AND ".join(f"(d{c} != 0 OR o{c} BETWEEN l{c} AND h{c})" for c in "xyz")
    boxes = ", ".join(f"least(a{c}, b{c if c != 'y' else 'y_'}, c{c}) AS l{c}, greatest(a{c}, b{c if c != 'y' else 'y_'}, c{c}) AS h{c}" for c in "xyz")
    return f"""WITH {duck('rays', 'triangles')}, boxes AS (SELECT tri_id, {boxes} FROM triangles),
  ends AS (SELECT ray_id, tri_id, greatest(CAST(tmin AS DOUBLE), {low}) AS low, least(CAST(tmax AS DOUBLE), {high}) AS high, {inside} AS inside FROM rays CROSS JOIN boxes)
SELECT ray_id, tri_id FROM ends WHERE inside AND high >= low AND high > 0"""


@query("ray_aabb", _slab_sql())
def ray_aabb(spark, sf_dir):
    r, t = view(spark, sf_dir, "rays"), view(spark, sf_dir, "triangles")
    box = rays.triangles().bounds()
    boxes = t.select("tri_id", *(c.alias(n) for c, n in zip((*box.low, *box.high), ("lx", "ly", "lz", "hx", "hy", "hz"))))
    return rays.box_hits(r, boxes, Box(V.vec("lx", "ly", "lz"), V.vec("hx", "hy", "hz")), "tri_id")


def _parts(spark, sf_dir):
    return view(spark, sf_dir, "points_tie").select(F.col("id").alias("prim_id"), (F.col("x") * 10).alias("x"), (F.col("y") * 100).cast("float").alias("y"), F.lit(5.0).cast("float").alias("z"), F.lit(8.0).cast("float").alias("radius"))


_BALLS = f"{duck('rays', 'points_tie')}, balls AS (SELECT id AS prim_id, CAST(x*10 AS FLOAT) AS x, CAST(y*100 AS FLOAT) AS y, CAST(5 AS FLOAT) AS z, CAST(8 AS FLOAT) AS radius FROM points_tie)"
_OFF, _DIR = [f"(CAST(o{c} AS DOUBLE)-{c})" for c in "xyz"], [f"CAST(d{c} AS DOUBLE)" for c in "xyz"]
_SUM = lambda u, w: f"({u[0]}*{w[0]}+{u[1]}*{w[1]}+{u[2]}*{w[2]})"
_SOLID = f"""{_BALLS}, eq AS (SELECT ray_id, prim_id, {_SUM(_DIR, _DIR)} AS a, {_SUM(_OFF, _DIR)} AS b, {_SUM(_OFF, _OFF)}-64 AS c FROM rays CROSS JOIN balls),
  roots AS (SELECT ray_id, prim_id, (-b-sqrt(b*b-a*c))/a AS near, (-b+sqrt(b*b-a*c))/a AS far FROM eq WHERE b*b-a*c > 0),
  hits AS (SELECT ray_id, prim_id, CASE WHEN near > 0 AND near < 50 THEN near WHEN far > 0 AND far < 50 THEN far END AS t FROM roots)"""


@query("ray_sphere_solid", f"WITH {_SOLID} SELECT ray_id, prim_id, round(t, 4) AS t FROM hits WHERE t IS NOT NULL")
def ray_sphere_solid(spark, sf_dir):
    hits = rays.trace(view(spark, sf_dir, "rays"), _parts(spark, sf_dir), rays.solid_spheres())
    return hits.select("ray_id", "prim_id", F.round("t", 4).alias("t"))


_TRI = f"""WITH {duck('rays', 'triangles')}, e AS (SELECT ray_id, tri_id, dx, dy, dz, bx-ax AS e1x, by_-ay AS e1y, bz-az AS e1z, cx-ax AS e2x, cy-ay AS e2y, cz-az AS e2z, ox-ax AS sx, oy-ay AS sy, oz-az AS sz FROM rays CROSS JOIN triangles),
 p AS (SELECT *, dy*e2z-dz*e2y AS hx, dz*e2x-dx*e2z AS hy, dx*e2y-dy*e2x AS hz, sy*e1z-sz*e1y AS qx, sz*e1x-sx*e1z AS qy, sx*e1y-sy*e1x AS qz FROM e),
 h AS (SELECT *, CAST((e1x*hx+e1y*hy)+e1z*hz AS FLOAT) AS det FROM p),
 u AS (SELECT *, 1e0/CAST(det AS DOUBLE) AS f FROM h WHERE det <= -1e-7 OR det >= 1e-7),
 t AS (SELECT ray_id, tri_id, f*CAST(CAST((sx*hx+sy*hy)+sz*hz AS FLOAT) AS DOUBLE) AS u, f*CAST(CAST((dx*qx+dy*qy)+dz*qz AS FLOAT) AS DOUBLE) AS v, f*CAST(CAST((e2x*qx+e2y*qy)+e2z*qz AS FLOAT) AS DOUBLE) AS t FROM u),
 hits AS (SELECT ray_id, tri_id AS prim_id, t FROM t WHERE u >= 0 AND u <= 1 AND v >= 0 AND u+v <= 1 AND t > 0 AND t < 50)"""


def _triangle_hits(spark, sf_dir):
    return rays.trace(view(spark, sf_dir, "rays"), view(spark, sf_dir, "triangles"), rays.triangles(), "tri_id")


@query("ray_triangle", f"{_TRI} SELECT ray_id, prim_id, round(t, 4) AS t FROM hits")
def ray_triangle(spark, sf_dir):
    return _triangle_hits(spark, sf_dir).select("ray_id", "prim_id", F.round("t", 4).alias("t"))


@query("closest_hit", f"{_TRI}, ranked AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY t, prim_id) AS k FROM hits) SELECT ray_id, prim_id, round(t, 4) AS t FROM ranked WHERE k = 1")
def closest_hit(spark, sf_dir):
    return rays.closest_hit(_triangle_hits(spark, sf_dir)).select("ray_id", "prim_id", F.round("t", 4).alias("t"))


_ENDED = f"""{_TRI}, kept AS (SELECT *, prim_id % 5 = 0 AS ends FROM hits WHERE prim_id % 3 != 0),
 run AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY ray_id ORDER BY t, prim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM kept)"""


@query("any_hit_terminate", f"{_ENDED}, seen AS (SELECT * FROM run WHERE before = 0) SELECT ray_id, prim_id, bool_or(ends) OVER (PARTITION BY ray_id) AS ended FROM seen")
def any_hit_terminate(spark, sf_dir):
    return rays.any_hit(_triangle_hits(spark, sf_dir), keep=F.col("prim_id") % 3 != 0, terminate=F.col("prim_id") % 5 == 0).select("ray_id", "prim_id", "ended")


@query("trace_branch", f"{_TRI}, near AS (SELECT ray_id, min_by(prim_id, t) AS prim_id FROM (SELECT * FROM hits ORDER BY t, prim_id) GROUP BY ray_id) SELECT r.ray_id, CASE WHEN n.prim_id IS NOT NULL THEN 1 ELSE 0 END AS value FROM rays r LEFT JOIN near n ON r.ray_id = n.ray_id")
def trace_branch(spark, sf_dir):
    return rays.outcome(view(spark, sf_dir, "rays"), _triangle_hits(spark, sf_dir), F.lit(1), F.lit(0))


@query("point_in_sphere", f"WITH {_BALLS}, d AS (SELECT ray_id, prim_id, CAST((ox-x)*(ox-x)+(oy-y)*(oy-y)+(oz-z)*(oz-z) AS FLOAT) AS d2 FROM rays CROSS JOIN balls) SELECT ray_id, prim_id, CAST(sqrt(d2) AS FLOAT) AS t FROM d WHERE d2 <= CAST(64 AS FLOAT)")
def point_in_sphere(spark, sf_dir):
    return rays.trace(view(spark, sf_dir, "rays"), _parts(spark, sf_dir), rays.spheres())


@query("trace_program", f"{_TRI}, ranked AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY t, prim_id) AS k, count(*) OVER (PARTITION BY ray_id) AS n FROM hits WHERE prim_id % 3 != 0), pushed AS (SELECT ray_id, string_agg(CAST(prim_id AS VARCHAR), ',' ORDER BY k) AS pushed, max(n) AS n FROM ranked WHERE k <= 2 GROUP BY ray_id) SELECT ray_id, pushed, CAST(n AS BIGINT) AS n FROM pushed UNION ALL SELECT ray_id, 'none', 0 FROM rays WHERE ray_id NOT IN (SELECT ray_id FROM hits)")
def trace_program(spark, sf_dir):
    program = programs.Trace(rays.triangles(), [programs.Ignore(F.col("prim_id") % 3 == 0), programs.Push(F.col("prim_id").cast("string"), 2)], [programs.Update("pushed", F.array(F.lit("none"))), programs.Update("n", F.lit(0).cast("bigint"))], "tri_id")
    out = program.run(view(spark, sf_dir, "rays"), view(spark, sf_dir, "triangles"))
    return out.select("ray_id", F.concat_ws(",", "pushed").alias("pushed"), "n")


@query("bounds_by_node", f"WITH {duck('triangles')} SELECT tri_id % 7 AS node, CAST(count(*) AS BIGINT) AS n, min(least(ax,bx,cx)) AS lx, min(least(ay,by_,cy)) AS ly, min(least(az,bz,cz)) AS lz, max(greatest(ax,bx,cx)) AS hx, max(greatest(ay,by_,cy)) AS hy, max(greatest(az,bz,cz)) AS hz FROM triangles GROUP BY ALL")
def bounds_by_node(spark, sf_dir):
    return bvh.bounds_by(bvh.boxes(view(spark, sf_dir, "triangles"), rays.triangles(), "tri_id").withColumn("node", F.col("prim_id") % 7), "node")


def _bvh_sql(levels: int, leaf: int) -> str:
    """The levels written out; a level without nodes costs nothing."""
    box = ", ".join(f"min(l{c}) AS l{c}" for c in "xyz") + ", " + ", ".join(f"max(h{c}) AS h{c}" for c in "xyz")
    axis = "CASE WHEN hz-lz > hy-ly AND hz-lz > hx-lx THEN 'z' WHEN hy-ly > hx-lx THEN 'y' ELSE 'x' END"
    middle = lambda p: f"(CASE m.axis WHEN 'z' THEN {p}.lz+{p}.hz WHEN 'y' THEN {p}.ly+{p}.hy ELSE {p}.lx+{p}.hx END)*CAST(0.5 AS FLOAT)"
    out = [f"WITH {duck('triangles')}, p0 AS (SELECT tri_id, '' AS key, {', '.join(f'least(a{c}, b{c if c != "y" else "y_"}, c{c}) AS l{c}, greatest(a{c}, b{c if c != "y" else "y_"}, c{c}) AS h{c}' for c in 'xyz')} FROM triangles)"]
    for i in range(levels):
        out.append(f"m{i} AS (SELECT *, {axis} AS axis FROM (SELECT key, count(*) AS n, {box} FROM p{i} GROUP BY key))")
        out.append(f"t{i} AS (SELECT p.*, {middle('p')} < {middle('m')} AS lft FROM p{i} p JOIN m{i} m ON p.key = m.key)")
        out.append(f"e{i} AS (SELECT key, sum(CAST(lft AS BIGINT)) AS lefts FROM t{i} GROUP BY key)")
        out.append(f"n{i} AS (SELECT m.key, CAST({i} AS INT) AS level, CAST(n AS BIGINT) AS n, lx, ly, lz, hx, hy, hz, n <= {leaf} OR lefts = 0 OR lefts = n AS is_leaf FROM m{i} m JOIN e{i} e ON m.key = e.key)")
        out.append(f"p{i + 1} AS (SELECT tri_id, t.key || CASE WHEN lft THEN '0' ELSE '1' END AS key, {', '.join(f't.{s}{c}' for s in 'lh' for c in 'xyz')} FROM t{i} t JOIN n{i} n ON t.key = n.key WHERE NOT n.is_leaf)")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(levels))


@query("bvh_nodes", _bvh_sql(16, 2))
def bvh_nodes(spark, sf_dir):
    return bvh.build(bvh.boxes(view(spark, sf_dir, "triangles"), rays.triangles(), "tri_id")).nodes


# Morton order

_SPREAD = ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249))


def _spread_sql(c: str) -> str:
    out = f"(({c}) & 1023)"
    for shift, mask in _SPREAD:
        out = f"(({out} | ({out} << {shift})) & {mask})"
    return out


def _morton_sql(view_name: str, isotropic: bool) -> str:
    wide = {c: f"greatest(h{c}-l{c}, CAST(1e-6 AS FLOAT))" for c in "xyz"}
    if isotropic:
        wide = dict.fromkeys("xyz", "greatest(hx-lx, hy-ly, hz-lz, CAST(1e-6 AS FLOAT))")
    cell = ", ".join(f"CAST(least(floor(CAST(CAST({c}-l{c} AS DOUBLE)/CAST({wide[c]} AS DOUBLE) AS FLOAT)*CAST(1023 AS FLOAT)), 1023) AS BIGINT) AS c{c}" for c in "xyz")
    code = f"({_spread_sql('cx')} << 2) | ({_spread_sql('cy')} << 1) | {_spread_sql('cz')}"
    return f"WITH {duck(view_name)}, box AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM {view_name}), cells AS (SELECT id, x, y, z, {cell} FROM {view_name}, box), coded AS (SELECT id, x, y, z, {code} AS code FROM cells)"


@query("morton_codes", f"{_morton_sql('points_ord', False)} SELECT id, x, y, z, code FROM coded")
def morton_codes(spark, sf_dir):
    return ordering.morton_codes(view(spark, sf_dir, "points_ord"))


@query("morton_sorted", f"{_morton_sql('points_ord', False)} SELECT id, x, y, z, code, CAST(row_number() OVER (ORDER BY code, id) - 1 AS BIGINT) AS position FROM coded")
def morton_sorted(spark, sf_dir):
    return ordering.morton_ranked(view(spark, sf_dir, "points_ord"))


@query("morton_isotropic_sorted", f"{_morton_sql('points_ord', True)} SELECT id, code, CAST(row_number() OVER (ORDER BY code, id) - 1 AS BIGINT) AS position FROM coded")
def morton_isotropic_sorted(spark, sf_dir):
    return ordering.morton_ranked(view(spark, sf_dir, "points_ord"), isotropic=True).select("id", "code", "position")


@query("morton_isotropic", f"{_morton_sql('points_ord', True)} SELECT id, code FROM coded")
def morton_isotropic(spark, sf_dir):
    return ordering.morton_codes(view(spark, sf_dir, "points_ord"), isotropic=True).select("id", "code")


# joins within a radius


def _near_sql(points: str, radius: float) -> str:
    return f"WITH {duck(points)}, pairs AS (SELECT q.id AS qid, p.id, {D2} AS d2 FROM {points} p, {points} q WHERE q.id % 50 = 0), near AS (SELECT * FROM pairs WHERE d2 <= CAST({radius} AS FLOAT)*CAST({radius} AS FLOAT))"


def _ord(spark, sf_dir):
    p = view(spark, sf_dir, "points_ord")
    return p, asked(p)


@query("radius_join", f"{_near_sql('points_ord', 6)} SELECT * FROM near")
def radius_join(spark, sf_dir):
    return neighbours.radius_join(*_ord(spark, sf_dir), 6)


@query("radius_flat", f"{_near_sql('points_ord', 6)} SELECT id FROM near")
def radius_flat(spark, sf_dir):
    return neighbours.radius_ids(*_ord(spark, sf_dir), 6)


@query("radius_counts", f"{_near_sql('points_ord', 6)} SELECT qid, CAST(count(*) AS BIGINT) AS n_hits FROM near GROUP BY qid")
def radius_counts(spark, sf_dir):
    return neighbours.radius_counts(*_ord(spark, sf_dir), 6)


@query("radius_capped", f"{_near_sql('points_ord', 10)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank, count(*) OVER (PARTITION BY qid) AS n_hits FROM near) SELECT qid, rank, id, d2, n_hits FROM ranked WHERE rank <= 4")
def radius_capped(spark, sf_dir):
    return neighbours.radius_capped(*_ord(spark, sf_dir), 10, 4)


# nearest neighbours


def _knn_sql(points: str, k: int, step: int = 50, where: str = "true") -> str:
    return f"WITH {duck(points)}, pairs AS (SELECT q.id AS qid, p.id, {D2} AS d2 FROM {points} p, {points} q WHERE q.id % {step} = 0), ranked AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS BIGINT) AS rank, id, d2 FROM pairs WHERE {where}) SELECT qid, rank, id, d2 FROM ranked WHERE rank <= {k}"


def _knn(name: str, points: str, k: int, method: str, step: int = 50, exclude_self: bool = False, schedule: Schedule | None = None) -> None:
    @query(name, _knn_sql(points, k, step, "d2 > CAST(1e-10 AS FLOAT)" if exclude_self else "true"))
    def run(spark, sf_dir):
        p = view(spark, sf_dir, points)
        return neighbours.knn(p, asked(p, step), k, schedule, exclude_self, method)


_knn("knn_brute", "points_ord", 5, "blocks")
_knn("knn_iterative", "points_ord", 5, "grid")
_knn("knn_exclude_self", "points_ord", 5, "grid", exclude_self=True)
_knn("knn_planar", "points_planar", 5, "grid")
_knn("knn_ties", "points_tie", 5, "grid")
_knn("knn_all", "points_emb", 5, "grid", 1)
_knn("knn_fixed", "points_ord", 5, "grid", schedule=Schedule(heuristic="fixed", fixed_radius=4.0, multiplier=2.5))
_knn("knn_sampled_max", "points_ord", 5, "grid", schedule=Schedule(heuristic="max", multiplier=2.0))


@query("knn_k_gt_n", _knn_sql("points_tie", 10**9))
def knn_k_gt_n(spark, sf_dir):
    p = view(spark, sf_dir, "points_tie")
    return neighbours.knn(p, asked(p), p.count() + 1, method="grid")


@query("knn_summary", f"WITH found AS ({_knn_sql('points_ord', 5)}) SELECT 'points_ord' AS path, CAST((SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0) AS BIGINT) AS nq, CAST(5 AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS total_neighbours FROM found")
def knn_summary(spark, sf_dir):
    p, q = _ord(spark, sf_dir)
    return writers.summary(neighbours.knn(p, q, 5), q.count(), 5, "points_ord", 0.0).drop("ms")


@query("knn_dump", f"WITH found AS ({_knn_sql('points_ord', 5)}) SELECT qid, 'Q' || qid || ':[' || string_agg(CAST(id AS VARCHAR), ', ' ORDER BY rank) || ']' AS value FROM found GROUP BY qid")
def knn_dump(spark, sf_dir):
    return writers.neighbour_lines(neighbours.knn(*_ord(spark, sf_dir), 5))


# samples and radii


@query("stride_sample", "WITH n AS (SELECT count(*) AS n FROM events) SELECT event_id AS id FROM events, n WHERE event_id % greatest(1, n // 100) = 0 AND event_id // greatest(1, n // 100) < 100")
def stride_sample(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return sampling.stride_sample(events, events.count(), 100)


@query("every_10th", "SELECT event_id AS id FROM events WHERE event_id % 10 = 0")
def every_10th(spark, sf_dir):
    return sampling.every_nth(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")))


@query("stage_prefix", "SELECT event_id AS id FROM events WHERE event_id < 500")
def stage_prefix(spark, sf_dir):
    return sampling.prefix(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), 500)


@query(
    "lcg_sample",
    f"""WITH RECURSIVE draws(draw, state) AS (
  SELECT 0, (CAST({sampling.LCG_SEED} AS HUGEINT)*{sampling.LCG_A} + {sampling.LCG_C}) % 18446744073709551616
  UNION ALL SELECT draw+1, (((state % 4294967296)*{sampling.LCG_A}) % 18446744073709551616 + (((state // 4294967296)*{sampling.LCG_A % 2**32}) % 4294967296)*4294967296 + {sampling.LCG_C}) % 18446744073709551616 FROM draws WHERE draw < 99),
 n AS (SELECT count(*) AS n FROM events)
SELECT event_id AS id, CAST(draw AS BIGINT) AS draw FROM draws, n JOIN events ON event_id = CAST((state // 8589934592) % n AS BIGINT)""",
)
def lcg_sample(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return sampling.lcg_sample(events, 100, events.count())


_KTH = f"""WITH {duck('points_ord')}, pairs AS (SELECT q.id AS qid, p.id, {D2} AS d2 FROM points_ord p, points_ord q WHERE q.id % 150 = 0 AND p.id % 15 = 0),
 ranked AS (SELECT qid, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS k FROM pairs WHERE d2 > CAST(1e-10 AS FLOAT)),
 kth AS (SELECT qid, CAST(sqrt(max(d2)) AS FLOAT) AS dist FROM ranked WHERE k <= 5 GROUP BY qid)"""


def _kth(spark, sf_dir):
    p = view(spark, sf_dir, "points_ord")
    return neighbours.sampled_kth_distances(sampling.every_nth(p, 15), sampling.every_nth(p, 150), 5)


@query("sampled_radius_percentile", f"{_KTH}, numbered AS (SELECT dist, row_number() OVER (ORDER BY dist) - 1 AS i, count(*) OVER () AS n FROM kth) SELECT CAST(dist AS DOUBLE)*1.1e0 AS radius FROM numbered WHERE i = least(CAST(floor(n*0.1e0) AS BIGINT), n-1)")
def sampled_radius_percentile(spark, sf_dir):
    return neighbours.radius_percentile(_kth(spark, sf_dir), 0.1)


@query("sampled_radius_max", f"{_KTH} SELECT CAST(max(dist) AS DOUBLE)*1.1e0 AS radius FROM kth")
def sampled_radius_max(spark, sf_dir):
    return neighbours.radius_max(_kth(spark, sf_dir))


# octrees and gravity


def _octree_sql(levels: int, leaf: int) -> str:
    """The levels written out, as many as there could be at the driver's scales."""
    box = "box AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM bodies_cust), b0 AS (SELECT id, x, y, z, mass, '' AS key, (lx+hx)*0.5e0 AS cx, (ly+hy)*0.5e0 AS cy, (lz+hz)*0.5e0 AS cz, greatest(hx-lx, hy-ly, hz-lz) AS w FROM bodies_cust, box)"
    out = [f"WITH {duck('bodies_cust')}, {box}"]
    for i in range(levels):
        out.append(f"n{i} AS (SELECT key, CAST({i} AS INT) AS level, any_value(w) AS width, CAST(count(*) AS BIGINT) AS n, sum(mass) AS mass, sum(mass*x) AS sx, sum(mass*y) AS sy, sum(mass*z) AS sz, count(*) <= {leaf} OR any_value(w) < 1e-5 AS is_leaf FROM b{i} GROUP BY key)")
        out.append(f"b{i + 1} AS (SELECT id, x, y, z, b.mass, b.key || CAST((CASE WHEN x >= cx THEN 1 ELSE 0 END) + (CASE WHEN y >= cy THEN 2 ELSE 0 END) + (CASE WHEN z >= cz THEN 4 ELSE 0 END) AS VARCHAR) AS key, CASE WHEN x >= cx THEN cx+w/4 ELSE cx-w/4 END AS cx, CASE WHEN y >= cy THEN cy+w/4 ELSE cy-w/4 END AS cy, CASE WHEN z >= cz THEN cz+w/4 ELSE cz-w/4 END AS cz, w/2 AS w FROM b{i} b JOIN n{i} n ON b.key = n.key WHERE NOT n.is_leaf)")
    out.append("nodes AS (" + " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(levels)) + ")")
    return ", ".join(out)


_LEAF = 16
_TREE = _octree_sql(12, _LEAF)


@query("octree_nodes", f"{_TREE} SELECT key, level, width, n, is_leaf FROM nodes")
def octree_nodes(spark, sf_dir):
    return octree.build(view(spark, sf_dir, "bodies_cust"), _LEAF).nodes.select("key", "level", "width", "n", "is_leaf")


# centres of mass are decimal fractions that often end in a 5; a small shift keeps them off the edge of rounding
@query("octree_com", f"{_TREE} SELECT key, round(mass, 6) AS mass, round(sx/mass + 3e-8, 6) AS com_x, round(sy/mass + 3e-8, 6) AS com_y, round(sz/mass + 3e-8, 6) AS com_z FROM nodes")
def octree_com(spark, sf_dir):
    nodes = octree.build(view(spark, sf_dir, "bodies_cust"), _LEAF).nodes
    return nodes.select("key", F.round("mass", 6).alias("mass"), *(F.round(F.col(c) + 3e-8, 6).alias(c) for c in ("com_x", "com_y", "com_z")))


@query("octree_octants", f"{_TREE} SELECT key, n FROM nodes WHERE level = 1")
def octree_octants(spark, sf_dir):
    return octree.octants(octree.build(view(spark, sf_dir, "bodies_cust"), _LEAF))


@query("octree_ropes", f'{_TREE}, placed AS (SELECT key, is_leaf, row_number() OVER (ORDER BY key) - 1 AS i FROM nodes), sizes AS (SELECT a.key, count(*) AS size FROM nodes a JOIN nodes b ON starts_with(b.key, a.key) GROUP BY a.key) SELECT p.key, CAST(i AS BIGINT) AS "index", CAST(i+1 AS BIGINT) AS next_index, CAST(i+size AS BIGINT) AS rope, is_leaf FROM placed p JOIN sizes s ON p.key = s.key')
def octree_ropes(spark, sf_dir):
    return octree.ropes(octree.build(view(spark, sf_dir, "bodies_cust"), _LEAF))


_FORCE = f"""WITH {duck('bodies_cust')}, pairs AS (SELECT a.id, a.mass*b.mass AS mm, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz, ((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y))+(b.z-a.z)*(b.z-a.z) AS d2 FROM bodies_cust a, bodies_cust b),
 f AS (SELECT id, sum(CASE WHEN d2 > 1e-10 THEN mm*dx/(d2*sqrt(d2+1e-6)) ELSE 0 END) AS fx, sum(CASE WHEN d2 > 1e-10 THEN mm*dy/(d2*sqrt(d2+1e-6)) ELSE 0 END) AS fy, sum(CASE WHEN d2 > 1e-10 THEN mm*dz/(d2*sqrt(d2+1e-6)) ELSE 0 END) AS fz FROM pairs GROUP BY id)"""


def _rounded(forces: DataFrame) -> DataFrame:
    # what rounds to a negative zero is zero
    return forces.select("id", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("fx", "fy", "fz")))


@query("nbody_exact", f"{_FORCE} SELECT id, round(fx, 6)+0e0 AS fx, round(fy, 6)+0e0 AS fy, round(fz, 6)+0e0 AS fz FROM f")
def nbody_exact(spark, sf_dir):
    return _rounded(nbody.exact(view(spark, sf_dir, "bodies_cust"), 1.0))


@query("nbody_total_force", f"{_FORCE} SELECT round(sum(sqrt((fx*fx+fy*fy)+fz*fz)), 4) AS total_force, CAST(count(*) AS BIGINT) AS n_bodies FROM f")
def nbody_total_force(spark, sf_dir):
    return nbody.total_force(nbody.exact(view(spark, sf_dir, "bodies_cust"), 1.0)).select(F.round("total_force", 4).alias("total_force"), "n_bodies")


@query("barnes_hut_theta0", f"{_FORCE} SELECT id, round(fx, 6)+0e0 AS fx, round(fy, 6)+0e0 AS fy, round(fz, 6)+0e0 AS fz FROM f")
def barnes_hut_theta0(spark, sf_dir):
    return _rounded(nbody.barnes_hut(view(spark, sf_dir, "bodies_cust"), 0.0, 1.0))


def _barnes_hut_sql(levels: int, leaf: int, theta: float) -> str:
    """The frontier's levels written out over those of the tree."""
    pull = lambda m, *d: ", ".join(f"CASE WHEN d2 > 1e-10 THEN mass*{m}*d{c}/(d2*sqrt(d2+1e-6)) ELSE 0 END AS f{c}" for c in "xyz")
    gap = lambda x, y, z: f"{x}-s.x AS dx, {y}-s.y AS dy, {z}-s.z AS dz, (({x}-s.x)*({x}-s.x)+({y}-s.y)*({y}-s.y))+({z}-s.z)*({z}-s.z) AS d2"
    out = [_octree_sql(levels, leaf), "f0 AS (SELECT id, x, y, z, mass, '' AS key FROM bodies_cust)"]
    for i in range(levels):
        out.append(f"s{i} AS (SELECT f.*, n.is_leaf, n.mass AS cm, n.sx/n.mass AS px, n.sy/n.mass AS py, n.sz/n.mass AS pz, NOT n.is_leaf AND n.width <= greatest(1e-6, {theta}*sqrt((n.sx/n.mass-x)*(n.sx/n.mass-x)+(n.sy/n.mass-y)*(n.sy/n.mass-y)+(n.sz/n.mass-z)*(n.sz/n.mass-z)))+1e-5 AS far FROM f{i} f JOIN n{i} n ON f.key = n.key)")
        out.append(f"g{i} AS (SELECT s.id, s.mass, o.mass AS om, {gap('o.x', 'o.y', 'o.z')} FROM s{i} s JOIN b{i} o ON s.key = o.key WHERE s.is_leaf UNION ALL SELECT s.id, s.mass, s.cm, {gap('s.px', 's.py', 's.pz')} FROM s{i} s WHERE s.far)")
        if i + 1 < levels:
            out.append(f"f{i + 1} AS (SELECT s.id, s.x, s.y, s.z, s.mass, n.key FROM s{i} s JOIN n{i + 1} n ON s.key = left(n.key, {i}) WHERE NOT s.is_leaf AND NOT s.far)")
    out.append("pulls AS (" + " UNION ALL ".join(f"SELECT id, {pull('om')} FROM g{i}" for i in range(levels)) + ")")
    return ", ".join(out) + " SELECT id, round(sum(fx), 6)+0e0 AS fx, round(sum(fy), 6)+0e0 AS fy, round(sum(fz), 6)+0e0 AS fz FROM pulls GROUP BY id"


@query("barnes_hut", _barnes_hut_sql(9, 32, 0.5))
def barnes_hut(spark, sf_dir):
    return _rounded(nbody.barnes_hut(view(spark, sf_dir, "bodies_cust"), 0.5, 1.0, 32))


# sources and validation


@query("polyline_explode", "SELECT o_orderkey AS line_id, CAST(o_custkey + i AS FLOAT) AS x, CAST(i AS FLOAT) AS y, CAST(0 AS FLOAT) AS z FROM orders, (VALUES (0), (1), (2)) AS t(i)")
def polyline_explode(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    point = lambda i: F.concat(F.lit("["), (F.col("o_custkey") + i).cast("string"), F.lit(f", {i}]"))
    lines = orders.select("o_orderkey", F.concat(F.lit("["), F.concat_ws(", ", *(point(i) for i in range(3))), F.lit("]")).alias("line"))
    points = readers.polyline_points(lines.select(F.concat_ws("", "line").alias("line")).distinct(), "line")
    return lines.join(points, "line").select(F.col("o_orderkey").alias("line_id"), "x", "y", "z")


def altered(found: DataFrame) -> DataFrame:
    """Neighbours of which every second query's are wrong, in ids and distances."""
    wrong = F.col("qid") % 100 == 0
    return found.select("qid", "rank", F.when(wrong, F.col("id") + 1).otherwise(F.col("id")).alias("id"), F.when(wrong, F.col("d2") + F.lit(1.0).cast("float")).otherwise(F.col("d2")).alias("d2"))


ALTERED = f"truth AS ({_knn_sql('points_ord', 5)}), found AS (SELECT qid, rank, CASE WHEN qid % 100 = 0 THEN id+1 ELSE id END AS id, CASE WHEN qid % 100 = 0 THEN CAST(d2+CAST(1 AS FLOAT) AS FLOAT) ELSE d2 END AS d2 FROM truth)"
MATCHED = f"""{ALTERED}, pairs AS (SELECT t.qid, t.id = f.id AS same, sqrt(CAST(t.d2 AS DOUBLE)) AS far, sqrt(CAST(f.d2 AS DOUBLE)) AS found_far FROM truth t JOIN found f USING (qid, rank)),
  judged AS (SELECT qid, bool_and(same) OR max(found_far) <= max(far)+1e-5 AS ok FROM pairs GROUP BY qid)"""


@query("validate_match_ratio", f"WITH {MATCHED} SELECT CAST(count(*) FILTER (ok) AS BIGINT) AS matching, CAST(count(*) AS BIGINT) AS queries, count(*) FILTER (ok)/CAST(count(*) AS DOUBLE) AS ratio FROM judged")
def validate_match_ratio(spark, sf_dir):
    p, q = _ord(spark, sf_dir)
    return validation.match_ratio(altered(neighbours.knn(p, q, 5, method="grid")), neighbours.knn(p, q, 5, method="blocks"))


@query("knn_saturation", f"{_near_sql('points_ord', 6)}, n AS (SELECT qid, count(*) AS n_hits FROM near GROUP BY qid) SELECT CAST(sum(CASE WHEN n_hits >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS saturated, round(avg(CASE WHEN n_hits >= 3 THEN 1e0 ELSE 0e0 END), 9) AS ratio FROM n")
def knn_saturation(spark, sf_dir):
    found = neighbours.saturation(neighbours.radius_counts(*_ord(spark, sf_dir), 6), Schedule(cap=3).cap)
    return found.select("saturated", F.round("ratio", 9).alias("ratio"))


from orbweave.plans import tool_queries  # noqa: E402, F401  (adds its queries to these)
