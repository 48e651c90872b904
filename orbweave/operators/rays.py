"""Joins of rays with geometries.

Rays meet geometries in the cells of a grid, by an equi-join. A geometry is in the at most eight cells that its bounds
touch of the level whose cells are as wide as it or wider (twice as wide from one level to the next), a ray in the cells, of
every level that has geometries, along the stretch of it that is in the scene, found in steps of a cell's width. Pairs that meet
in several cells are made one after the exact test. No table is sent to all tasks, and none is paired with all of another.

Geometries that only give a function and no bounds can be anywhere: they are tested with every ray, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.geometry import Box, Geometry, Ray, SolidSphere, Sphere, Triangle, ray_hits_box
from orbweave.functions.vectors import vec
from orbweave.plans.cuts import Cuts, fresh, spread

#: Geometries without bounds of a block, each of some 50 bytes.
BLOCK = 100_000
#: Cells along the scene's longest side at the finest level.
FINEST = 1_024


def spheres() -> Sphere:
    """From columns x, y, z, radius."""
    return Sphere(vec("x", "y", "z"), F.col("radius").cast("float"))


def solid_spheres() -> SolidSphere:
    """As ``spheres``, hit at their surface."""
    return SolidSphere(vec("x", "y", "z"), F.col("radius").cast("float"))


def triangles() -> Triangle:
    """From columns ax … cz; the second vertex is bx, by_, bz, as ``by`` is a word of SQL."""
    return Triangle(vec("ax", "ay", "az"), vec("bx", "by_", "bz"), vec("cx", "cy", "cz"))


def joined(rays: DataFrame, prims: DataFrame, condition: Column, block: int = BLOCK) -> DataFrame:
    """All pairs that meet the condition, by testing all: for geometries without bounds."""
    n, rays = prims.count(), spread(rays)
    parts = [prims] if n <= block else [prims.where(F.pmod(F.xxhash64(*prims.columns), F.lit(-(-2 * n // block))) == i) for i in range(-(-2 * n // block))]
    out = None
    for part in parts:
        hits = rays.join(F.broadcast(part), condition)
        out = hits if out is None else out.unionByName(hits)
    return out


def near_pairs(rays: DataFrame, prims: DataFrame, box: Box, at_origin: bool = False) -> DataFrame:
    """Rows of rays and geometries whose cells meet, pairs that meet more than once as often as they do. ``box``: a geometry's bounds.

    With ``at_origin`` only the cell that a ray begins in counts.
    """
    cuts = Cuts(rays.sparkSession)
    names = {n: fresh(n, rays, prims) for n in ("lx", "ly", "lz", "hx", "hy", "hz", "level", "i", "j", "k", "begin", "end", "steps", "step")}
    low, high = [names["l" + c] for c in "xyz"], [names["h" + c] for c in "xyz"]
    level, cells = names["level"], [names[c] for c in "ijk"]
    padded = box.padded()
    boxed = prims.select("*", *(c.cast("double").alias(n) for c, n in zip((*padded.low, *padded.high), (*low, *high))))
    boxed = boxed.where(F.col(low[0]).isNotNull() & F.col(low[1]).isNotNull() & F.col(low[2]).isNotNull())
    scene = boxed.agg(*(F.min(n).alias(n) for n in low), *(F.max(n).alias(n) for n in high)).first()
    if scene[low[0]] is None:
        return rays.join(prims, F.lit(False))
    start, stop = [scene[n] for n in low], [scene[n] for n in high]
    finest = max(max(b - a for a, b in zip(start, stop)) / FINEST, 1e-9)
    edge = F.lit(finest) * F.pow(F.lit(2.0), F.col(level))
    side = F.greatest(*(F.col(h) - F.col(l) for l, h in zip(low, high)))
    boxed = cuts.cut(boxed.withColumn(level, F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(finest)) / finest))).cast("int")))
    for c, l, h, a in zip(cells, low, high, start):
        boxed = boxed.withColumn(c, F.explode(F.sequence(F.floor((F.col(l) - a) / edge), F.floor((F.col(h) - a) / edge))))
    levels = sorted(r[0] for r in boxed.select(level).distinct().collect())  # at most log2(FINEST) + 1
    ray = Ray.columns()
    origin, direction = [c.cast("double") for c in ray.origin], [c.cast("double") for c in ray.direction]
    begin, end, fast = ray.tmin.cast("double"), ray.tmax.cast("double"), F.greatest(*(F.abs(d) for d in direction))
    inside = F.lit(True)
    for o, d, a, b in zip(origin, direction, start, stop):
        one, two = F.try_divide(F.lit(a) - o, d), F.try_divide(F.lit(b) - o, d)
        begin, end = F.greatest(begin, F.least(one, two)), F.least(end, F.greatest(one, two))
        inside = inside & ((d != 0) | (o >= a) & (o <= b))
    if at_origin:
        begin = end = F.lit(0.0)
        inside = F.lit(True)
        for o, a, b in zip(origin, start, stop):
            inside = inside & (o >= a) & (o <= b)
    still = fast == 0
    on = rays.select("*", F.when(still, 0.0).otherwise(begin).alias(names["begin"]), F.when(still, 0.0).otherwise(end).alias(names["end"])).where(inside & (F.col(names["end"]) >= F.col(names["begin"])))
    on = on.withColumn(level, F.explode(F.array(*(F.lit(n) for n in levels))))
    length = F.col(names["end"]) - F.col(names["begin"])
    on = on.withColumn(names["steps"], F.greatest(F.lit(1), F.ceil(length * fast / edge)))
    on = on.withColumn(names["step"], F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(names["steps"]) - 1)))
    at = lambda n: F.col(names["begin"]) + length * (F.col(names["step"]) + n) / F.col(names["steps"])
    for c, o, d, a in zip(cells, origin, direction, start):
        one, two = o + d * at(0) - a, o + d * at(1) - a
        on = on.withColumn(c, F.explode(F.sequence(F.floor(F.least(one, two) / edge), F.floor(F.greatest(one, two) / edge))))
    on = on.select(*rays.columns, level, *cells).distinct()
    return on.join(boxed.select(*prims.columns, level, *cells), [level, *cells]).select(*rays.columns, *prims.columns)


def box_hits(rays: DataFrame, boxes: DataFrame, box: Box, box_id: str) -> DataFrame:
    """(ray_id, box_id) of the boxes that rays meet within [tmin, tmax]."""
    return near_pairs(rays, boxes, box).where(ray_hits_box(Ray.columns(), box)).select("ray_id", box_id).distinct()


def trace(rays: DataFrame, prims: DataFrame, geometry: Geometry | Callable[[Ray], Column], prim_id: str = "prim_id", block: int = BLOCK) -> DataFrame:
    """(ray_id, prim_id, t): every hit. ``geometry`` gives hits as distances, null for none. Rays' and geometries' ids are unique."""
    ray = Ray.columns()
    hit = geometry if callable(geometry) else geometry.hit
    if not getattr(geometry, "hits_in_bounds", False):
        found = joined(rays, prims, hit(ray).isNotNull(), block).withColumn("t", hit(ray))
        return found.select("ray_id", F.col(prim_id).alias("prim_id"), "t")
    pairs = near_pairs(rays, prims, geometry.bounds(), getattr(geometry, "hits_at_origin", False))
    # explode keeps the exact test out of the condition, which would work it out twice
    found = pairs.withColumn("t", F.explode(F.array(hit(ray)))).where("t is not null")
    return found.select("ray_id", F.col(prim_id).alias("prim_id"), "t").distinct()


def any_hit(hits: DataFrame, keep: Column | None = None, terminate: Column | None = None) -> DataFrame:
    """What an any-hit callback keeps, in the order of (t, prim_id).

    Hits for which ``keep`` isn't true are ignored. The first kept hit for which ``terminate`` is true ends its ray:
    it is the ray's last, and ``ended`` says so on all the ray's hits.
    """
    kept = hits if keep is None else hits.where(keep)
    if terminate is None:
        return kept.withColumn("ended", F.lit(False))
    order = Window.partitionBy("ray_id").orderBy("t", "prim_id")
    ends = F.sum(terminate.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = kept.withColumn("ends", F.coalesce(ends, F.lit(0))).where(F.col("ends") == 0).drop("ends")
    return out.withColumn("ended", F.max(terminate).over(Window.partitionBy("ray_id")))


def closest_hit(hits: DataFrame) -> DataFrame:
    """The nearest hit of each ray, the smaller id of equals; rays that an any-hit callback ended have none."""
    if "ended" in hits.columns:
        hits = hits.where(~F.col("ended")).drop("ended")
    rank = F.row_number().over(Window.partitionBy("ray_id").orderBy("t", "prim_id"))
    return hits.withColumn("rank", rank).where("rank = 1").drop("rank")


def outcome(rays: DataFrame, hits: DataFrame, on_hit: Column, on_miss: Column) -> DataFrame:
    """(ray_id, value): a branch on whether the ray hit anything; ``on_hit`` may use prim_id and t of the closest."""
    near = closest_hit(hits)
    return rays.select("ray_id").join(near, "ray_id", "left").select("ray_id", F.when(F.col("prim_id").isNotNull(), on_hit).otherwise(on_miss).alias("value"))


def triangle_buffers(prims: DataFrame, id_col: str = "tri_id") -> DataFrame:
    """(tri_id, corner, index, x, y, z): three rows per triangle; index is 3 * id + corner."""
    corner = lambda p: F.struct(*(F.col(c).cast("float").alias(n) for c, n in zip(p, "xyz")))
    rows = prims.select(F.col(id_col).alias("tri_id"), F.posexplode(F.array(corner(("ax", "ay", "az")), corner(("bx", "by_", "bz")), corner(("cx", "cy", "cz")))).alias("corner", "v"))
    return rows.select("tri_id", F.col("corner").cast("bigint").alias("corner"), (F.col("tri_id") * 3 + F.col("corner")).cast("bigint").alias("index"), "v.x", "v.y", "v.z")
