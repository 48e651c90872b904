"""Morton codes of 30 bits, ten per axis, x the most significant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = 1024
#: Masks that leave two free bits after each of ten, by the shift before them.
SPREAD = ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249))


def expand_bits(v: Column) -> Column:
    """Ten bits, two apart."""
    out = v.cast("bigint").bitwiseAND(F.lit(CELLS - 1))
    for shift, mask in SPREAD:
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return out


def code(x: Column, y: Column, z: Column) -> Column:
    return F.shiftleft(expand_bits(x), 2).bitwiseOR(F.shiftleft(expand_bits(y), 1)).bitwiseOR(expand_bits(z))


def cell(v: Column, low: Column, extent: Column) -> Column:
    """0 to 1023 by the place within [low, low + extent], in FLOAT; an extent of nearly nothing counts as 1e-6."""
    wide = F.greatest(extent.cast("float"), F.lit(1e-6).cast("float"))
    part = ((v - low).cast("double") / wide.cast("double")).cast("float") * F.lit(float(CELLS - 1)).cast("float")
    return F.least(F.floor(part), F.lit(CELLS - 1)).cast("bigint")
