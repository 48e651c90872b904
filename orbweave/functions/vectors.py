"""Three-dimensional vectors as Column expressions over FLOAT components.

A vector is a triple of Columns; nothing is packed into structs until a result is selected. FLOAT plus, minus
and times stay FLOAT; quotients and roots are DOUBLE in Spark and are cast back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(x, y, z) -> Vec:
    """From columns, names of columns, or numbers."""
    make = lambda v: v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))
    return tuple(make(v).cast("float") for v in (x, y, z))


def packed(v: Vec) -> Column:
    return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def scale(a: Vec, s) -> Vec:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return tuple(p * s.cast("float") for p in a)


def divide(a: Vec, s) -> Vec:
    """Component-wise quotient; by zero it is an infinity with the component's sign, or NaN for zero, as floating point has it."""
    s = s if isinstance(s, Column) else F.lit(float(s))
    endless = lambda p: F.when(p > 0, F.lit(float("inf"))).when(p < 0, F.lit(float("-inf"))).when(p == 0, F.lit(float("nan")))
    return tuple(F.when(s == 0, endless(p)).otherwise(F.try_divide(p.cast("double"), s.cast("double"))).cast("float") for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return (a[0] * b[0] + a[1] * b[1]) + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def squared_distance(a: Vec, b: Vec) -> Column:
    """((ax-bx)^2 + (ay-by)^2) + (az-bz)^2 in FLOAT, in this order everywhere."""
    d = sub(a, b)
    return (d[0] * d[0] + d[1] * d[1]) + d[2] * d[2]


def distance(a: Vec, b: Vec) -> Column:
    return F.sqrt(squared_distance(a, b)).cast("float")


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a)).cast("float")


def normalize(a: Vec) -> Vec:
    """Unit vector; the zero vector stays as it is."""
    n = length(a)
    return tuple(F.when(n > 0, F.try_divide(p.cast("double"), n.cast("double")).cast("float")).otherwise(p) for p in a)


def least(a: Vec, b: Vec) -> Vec:
    return tuple(F.least(p, q) for p, q in zip(a, b))


def greatest(a: Vec, b: Vec) -> Vec:
    return tuple(F.greatest(p, q) for p, q in zip(a, b))
