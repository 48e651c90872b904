"""Boxes, spheres, triangles and rays as Column expressions.

A geometry is anything with ``bounds()`` and ``hit(ray)``; ``hit`` gives the distance of a hit or null. Users
add their own by giving these two methods, in Columns. ``hits_in_bounds`` may say that rays only hit it within its
bounds, and ``hits_at_origin`` that they only do where they begin; both let joins look for pairs by cells.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbweave.functions import vectors as V
from orbweave.functions.vectors import Vec, vec

#: Triangles seen from the edge: determinants nearer to zero than this are misses.
FLAT = 1e-7


@dataclass(frozen=True)
class Box:
    low: Vec
    high: Vec

    def grow(self, p: Vec) -> Box:
        return Box(V.least(self.low, p), V.greatest(self.high, p))

    def merge(self, other: Box) -> Box:
        return Box(V.least(self.low, other.low), V.greatest(self.high, other.high))

    def padded(self) -> Box:
        """A little wider than the rounding of FLOAT tests near its size."""
        size = F.greatest(*(F.abs(c) for c in (*self.low, *self.high))) * F.lit(1e-3).cast("float") + F.lit(1e-6).cast("float")
        return Box(V.sub(self.low, (size,) * 3), V.add(self.high, (size,) * 3))

    def center(self) -> Vec:
        return V.scale(V.add(self.low, self.high), 0.5)


@dataclass(frozen=True)
class Ray:
    origin: Vec
    direction: Vec
    tmin: Column
    tmax: Column

    @classmethod
    def columns(cls, prefix: str = "") -> Ray:
        """From columns ox, oy, oz, dx, dy, dz, tmin, tmax."""
        names = [prefix + n for n in ("ox", "oy", "oz", "dx", "dy", "dz")]
        return cls(vec(*names[:3]), vec(*names[3:]), F.col(prefix + "tmin").cast("float"), F.col(prefix + "tmax").cast("float"))

    @classmethod
    def query(cls, point: Vec, radius) -> Ray:
        """A point query: along x, with the radius as its end."""
        r = radius if isinstance(radius, Column) else F.lit(float(radius))
        return cls(point, vec(1, 0, 0), F.lit(0.0).cast("float"), r.cast("float"))


class Geometry(Protocol):
    def bounds(self) -> Box: ...

    def hit(self, ray: Ray) -> Column: ...


@dataclass(frozen=True)
class Sphere:
    center: Vec
    radius: Column
    hits_in_bounds = hits_at_origin = True

    def with_radius(self, radius) -> Sphere:
        return replace(self, radius=(radius if isinstance(radius, Column) else F.lit(float(radius))).cast("float"))

    def bounds(self) -> Box:
        r = (self.radius,) * 3
        return Box(V.sub(self.center, r), V.add(self.center, r))

    def packed(self) -> Column:
        return F.array(*self.center, self.radius)

    def hit(self, ray: Ray) -> Column:
        """The ray's origin within the sphere, its surface included: the distance to the centre."""
        d2 = V.squared_distance(ray.origin, self.center)
        return F.when(d2 <= self.radius * self.radius, F.sqrt(d2).cast("float"))

    def hit_solid(self, ray: Ray) -> Column:
        """The ray's first crossing of the surface with tmin < t < tmax, in DOUBLE; the far one if the near one isn't."""
        o = [p.cast("double") - c.cast("double") for p, c in zip(ray.origin, self.center)]
        d = [p.cast("double") for p in ray.direction]
        total = lambda u, w: u[0] * w[0] + u[1] * w[1] + u[2] * w[2]
        a, b, c = total(d, d), total(o, d), total(o, o) - self.radius.cast("double") * self.radius.cast("double")
        disc = b * b - a * c
        root = F.sqrt(F.greatest(disc, F.lit(0.0)))
        near, far = F.try_divide(-b - root, a), F.try_divide(-b + root, a)
        low, high = ray.tmin.cast("double"), ray.tmax.cast("double")
        inside = lambda t: (t > low) & (t < high)
        return F.when((disc > 0) & inside(near), near).when((disc > 0) & inside(far), far)


@dataclass(frozen=True)
class SolidSphere(Sphere):
    """A sphere that rays hit where they cross its surface."""

    hits_at_origin = False

    def hit(self, ray: Ray) -> Column:
        return self.hit_solid(ray)


@dataclass(frozen=True)
class Triangle:
    a: Vec
    b: Vec
    c: Vec
    hits_in_bounds = True

    def bounds(self) -> Box:
        return Box(V.least(V.least(self.a, self.b), self.c), V.greatest(V.greatest(self.a, self.b), self.c))

    def packed(self) -> Column:
        return F.array(*self.a, *self.b, *self.c)

    def hit(self, ray: Ray) -> Column:
        """Ray parameter of the crossing with tmin < t < tmax, in FLOAT but for the quotients; null if there is none."""
        e1, e2, s = V.sub(self.b, self.a), V.sub(self.c, self.a), V.sub(ray.origin, self.a)
        h, q = V.cross(ray.direction, e2), V.cross(s, e1)

        def inside(m: Column) -> Column:
            ok = (m["det"] <= -FLAT) | (m["det"] >= FLAT)
            f = F.try_divide(F.lit(1.0), F.when(ok, m["det"].cast("double")))
            return _once({"u": f * m["u"].cast("double"), "v": f * m["v"].cast("double"), "t": f * m["t"].cast("double")}, lambda r: F.when(ok & (r["u"] >= 0) & (r["u"] <= 1) & (r["v"] >= 0) & (r["u"] + r["v"] <= 1) & (r["t"] > ray.tmin) & (r["t"] < ray.tmax), r["t"]))

        return _once({"det": V.dot(e1, h), "u": V.dot(s, h), "v": V.dot(ray.direction, q), "t": V.dot(e2, q)}, inside)


def _once(values: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """``then`` of a struct of values, each of which is worked out once and not again wherever it is used."""
    return F.get(F.transform(F.array(F.struct(*(c.alias(n) for n, c in values.items()))), then), F.lit(0))


def ray_hits_box(ray: Ray, box: Box) -> Column:
    """Slab test over [tmin, tmax]: true if the ray's stretch meets the box and doesn't end behind the origin."""
    low, high = ray.tmin.cast("double"), ray.tmax.cast("double")
    inside = F.lit(True)
    for o, d, b, t in zip(ray.origin, ray.direction, box.low, box.high):
        o, d, b, t = (c.cast("double") for c in (o, d, b, t))
        one, two = F.try_divide(b - o, d), F.try_divide(t - o, d)
        # a ray along the slab has no bounds from it, but has to be in it
        low = F.greatest(low, F.least(one, two))
        high = F.least(high, F.greatest(one, two))
        inside = inside & ((d != 0) | ((o >= b) & (o <= t)))
    return inside & (high >= low) & (high > 0)
