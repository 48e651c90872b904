"""Sums of pulls from distant cells, by expansions carried to the rounding of doubles (the fast multipole method).

Bodies lie in a cube that is cut in halves along each axis, ``levels`` times. Cells that are far enough from each other, but whose
parents aren't, meet through expansions; the cells that are too near to one of the last level are left to sums pair by pair. The pull's
formula is 1/d^3 but for a small rest. What goes with 1/d^3 is the gradient of 1/d, so solid harmonics up to ``ORDER`` say it:
with R(n, m) = r^n P(n, m) e^(i m phi) / (n + m)! and I(n, m) = (n - m)! P(n, m) e^(i m phi) / r^(n + 1),

    R(n, m)(a + b) = sum of R(j, k)(a) R(n - j, m - k)(b)
    1 / |D + t - s| = sum of conj R(a, b)(t) (-1)^a I(a + c, b + d)(D) conj R(c, d)(s).

The rest is under ``SMALL`` of the pull and is interpolated between Chebyshev nodes, ``NODES`` along an axis. Places are in widths of a cell.
Real vectors hold the real part of (n, m) at n*n + n + m and the imaginary one at n*n + n - m, as (n, -m) follows from (n, m).
"""

from __future__ import annotations

import numpy as np

ORDER, NODES = 37, 8
#: Cells meet whose centres are at least so far apart, in widths, squared.
APART = 8
#: A bound for what is left out of an expansion, relative to the pull of bodies in opposite corners of cells; all but these are much nearer.
LEFT_OUT = 1e-13
#: What softening may change a pull between cells that meet, at most.
SMALL = 2e-8
#: Where the rest is less than this part of the pull of the nearest places of two cells, it is under the rounding of a sum of doubles, and not summed.
NOTHING = 2.0**-50
TERMS = (ORDER + 1) ** 2


def _degrees(order: int) -> tuple[np.ndarray, np.ndarray]:
    """n and m of all terms, m from -n to n."""
    n = np.repeat(np.arange(order + 1), 2 * np.arange(order + 1) + 1)
    return n, np.arange(len(n)) - n * n - n


def basis(at: np.ndarray, order: int) -> np.ndarray:
    """The real parts of R, a column per place. Real and imaginary parts follow from those of lower n by the same steps."""
    x, y, z = at.T
    r2 = x * x + y * y + z * z
    out = np.empty(((order + 1) ** 2, len(at)))
    out[0] = 1
    for n in range(1, order + 1):
        own, one, two = n * n, (n - 1) ** 2, (n - 2) ** 2
        real, imaginary = out[own - 1], out[one] if n > 1 else 0.0
        out[own + 2 * n] = (x * real - y * imaginary) * (-0.5 / n)
        out[own] = (x * imaginary + y * real) * (-0.5 / n)
        inner = np.multiply(out[one:own], (2 * n - 1) * z, out=out[own + 1 : own + 2 * n])
        if n > 1:
            inner[1:-1] -= r2 * out[two:one]
        inner *= (1 / (n * n - np.arange(1.0 - n, n) ** 2))[:, None]
    return out


def _mirrored(half: np.ndarray, order: int) -> np.ndarray:
    """Also the terms with m < 0."""
    n, m = _degrees(order)
    out = half.copy()
    low = np.flatnonzero(m < 0)
    out[low] = (-1.0) ** m[low] * half[low - 2 * m[low]].conj()
    return out


def _irregular(at: np.ndarray, order: int) -> np.ndarray:
    """I(n, m) of one place, all m."""
    x, y, z = at
    turn, r2 = complex(x, y), float(at @ at)
    out = np.zeros((order + 1) ** 2, complex)
    out[0] = r2**-0.5
    for n in range(1, order + 1):
        own, one, two = n * n + n, n * n - n, (n - 2) * (n - 1)
        out[own + n] = -(2 * n - 1) * turn / r2 * out[one + n - 1]
        m = np.arange(n)
        term = (2 * n - 1) * z * out[one : one + n]
        term[:-1] -= (((n - 1) ** 2 - m * m) * out[two : two + n])[:-1]
        out[own : own + n] = term / r2
    return _mirrored(out, order)


def order_of(offset: np.ndarray) -> int:
    """The terms that cells at this offset need; the ratio is that of a corner's distance from its centre to that from the other's."""
    return min(ORDER, int(np.ceil(np.log(LEFT_OUT) / np.log(0.75**0.5 / (np.linalg.norm(offset) - 0.75**0.5)))))


def _real(half: np.ndarray, order: int) -> np.ndarray:
    """Rows of real and imaginary parts from rows with m >= 0."""
    n, m = _degrees(order)
    out = np.empty(half.shape)
    high, low = np.flatnonzero(m >= 0), np.flatnonzero(m < 0)
    out[high], out[low] = half[high].real, half[low - 2 * m[low]].imag
    return out


def _matrix(told: np.ndarray, conjugate: bool, order: int) -> np.ndarray:
    """What a complex matrix (rows with m >= 0 are used) does to a vector, or its conjugate, in real parts."""
    n, m = _degrees(order)
    high = np.flatnonzero(m > 0)
    low = high - 2 * m[high]
    sign = (-1.0) ** m[high]
    side = -1j if conjugate else 1j
    out = told.copy()
    out[:, high] = told[:, high] + sign * told[:, low]
    out[:, low] = side * (told[:, high] - sign * told[:, low])
    return _real(out, order)


def between(offset: np.ndarray, order: int) -> np.ndarray:
    """From moments around a cell's centre to the expansion around one whose centre is ``offset`` widths farther."""
    n, m = _degrees(order)
    table = _irregular(np.asarray(offset, float), 2 * order)
    both = n[:, None] + n[None, :]
    return _matrix(((-1.0) ** n)[:, None] * table[both * both + both + (m[:, None] + m[None, :])], True, order)


def _shifts(offset: np.ndarray) -> np.ndarray:
    """R(n - j, m - k) of an offset, zero where there is none, for (n, m) in rows and (j, k) in columns."""
    n, m = _degrees(ORDER)
    parts = basis(offset[None, :], ORDER)[:, 0]
    told = _mirrored(parts + 1j * np.where(m == 0, 0, parts[n * n + n - m]), ORDER)
    dn, dm = n[:, None] - n[None, :], m[:, None] - m[None, :]
    ok = np.abs(dm) <= dn
    return np.where(ok, told[np.where(ok, dn * dn + dn + dm, 0)], 0)


def upward(offset: np.ndarray) -> np.ndarray:
    """From a child's moments to its parent's; ``offset`` is the child's centre in widths of the parent."""
    return _matrix(_shifts(offset), False, ORDER) * 0.5 ** _degrees(ORDER)[0][None, :]


def downward(offset: np.ndarray) -> np.ndarray:
    """From a parent's expansion to a child's."""
    told = _shifts(offset).T.conj()
    return _matrix(told, False, ORDER) * 0.5 ** (_degrees(ORDER)[0] + 1)[:, None]


def gradient(local: np.ndarray) -> np.ndarray:
    """Three columns that give the gradient of the expansion at places by products with their ``basis``."""
    n, m = _degrees(ORDER)
    full = np.zeros((ORDER + 2) ** 2, complex)
    high, low = np.flatnonzero(m >= 0), np.flatnonzero(m > 0)
    full[high] = local[high]
    full[low] += 1j * local[low - 2 * m[low]]
    full = _mirrored(full, ORDER + 1)
    up = (n + 1) ** 2 + n + 1 + m
    less, more, same = full[up - 1], full[up + 1], full[up]
    told = np.column_stack(((less - more) / 2, 0.5j * (more + less), same))
    return _real(told, ORDER) * np.where(m == 0, 1.0, 2.0)[:, None]


NODE = 0.5 * np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
GRID = np.stack(np.meshgrid(NODE, NODE, NODE, indexing="ij"), axis=-1).reshape(-1, 3)


def weights(at: np.ndarray) -> np.ndarray:
    """Of every node at each place, a row per place."""
    axes = []
    for x in at.T:
        w = np.ones((len(at), NODES))
        for i in range(NODES):
            for j in range(NODES):
                if i != j:
                    w[:, i] *= (x - NODE[j]) / (NODE[i] - NODE[j])
        axes.append(w)
    return np.einsum("ia,ib,ic->iabc", *axes).reshape(len(at), -1)


#: From values at an axis's nodes to the derivative there.
SLOPE = np.column_stack((np.zeros(NODES), np.arange(1, NODES) * NODE[:, None] ** np.arange(NODES - 1))) @ np.linalg.inv(NODE[:, None] ** np.arange(NODES))


def rest(d2: np.ndarray, formula: str, soft: float) -> np.ndarray:
    """What the formula's potential has beyond 1/d, where that is small."""
    if formula == "plain":
        return -0.25e-12 / (d2 * d2)
    return (-soft / 6 + 0.075 * soft * soft / d2) / (d2 * np.sqrt(d2))


def is_small(width: float, soft: float) -> bool:
    """Whether the rest is as small as it has to be between cells that meet."""
    return max(soft / 2 / width**2, 1e-12 / width**3) <= SMALL if width > 0 else False


def is_nothing(offset: np.ndarray, width: float, formula: str, soft: float) -> bool:
    """Whether the rest between cells at this offset changes no pull, that of the nearest places of the cells included."""
    gap = np.maximum(np.abs(offset) - 1, 0) * width
    d2 = float(gap @ gap)
    return (1e-12 / d2**1.5 if formula == "plain" else soft / 2 / d2) < NOTHING if d2 > 0 else False


def moments(at: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Of bodies at places around their cell's centre: those of the harmonics, then one for each node."""
    return np.concatenate((basis(at, ORDER) @ mass, mass @ weights(at)))


LENGTH = TERMS + NODES**3
OCTANTS = np.array([(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)])
#: One of each two opposite offsets between cells that meet though their parents don't.
OFFSETS = np.array([(i, j, k) for i in range(-5, 6) for j in range(-5, 6) for k in range(-5, 6) if (i, j, k) > (0, 0, 0) and i * i + j * j + k * k >= APART])


def cells(level: int) -> np.ndarray:
    """Places of a level's cells, in order of their numbers."""
    m = 1 << level
    return np.stack(np.unravel_index(np.arange(m**3), (m, m, m)), axis=-1)


def number(places: np.ndarray, level: int) -> np.ndarray:
    m = 1 << level
    return (places[..., 0] * m + places[..., 1]) * m + places[..., 2]


def climb(last: np.ndarray, levels: int) -> dict[int, np.ndarray]:
    """The moments of all cells of the levels from 2 on."""
    out = {levels: last}
    for level in range(levels - 1, 1, -1):
        below = out[level + 1]
        told = np.zeros((8**level, LENGTH))
        for octant in OCTANTS:
            offset, child = octant * 0.5 - 0.25, below[number(cells(level) * 2 + octant, level + 1)]
            told[:, :TERMS] += child[:, :TERMS] @ upward(offset).T
            told[:, TERMS:] += child[:, TERMS:] @ weights(GRID * 0.5 + offset)
        out[level] = told
    return out


def meet(offset: np.ndarray, told: dict[int, np.ndarray], into: dict[int, np.ndarray], width: dict[int, float], formula: str, soft: float) -> None:
    """Adds to the expansions of all levels what comes from the cells that are ``offset`` before, and after."""
    order = order_of(offset)
    terms, matrix = (order + 1) ** 2, None
    sign = (-1.0) ** _degrees(order)[0]
    for level, have in told.items():
        w, at = width[level], cells(level)
        other = at - offset
        ok = ((other >= 0) & (other < 1 << level)).all(axis=1) & (((other // 2 - at // 2) ** 2).sum(axis=1) < APART)
        target, source = np.flatnonzero(ok), number(other[ok], level)
        if not len(target):
            continue
        matrix = between(offset, order) if matrix is None else matrix
        size = None
        if not is_nothing(offset, w, formula, soft):
            apart = GRID[:, None] + offset - GRID[None, :]
            size = rest((apart * apart).sum(axis=2) * w**2, formula, soft) * w
        for begin in range(0, len(target), 1024):
            t, s = target[begin : begin + 1024], source[begin : begin + 1024]
            into[level][t, :terms] += have[s, :terms] @ matrix.T
            into[level][s, :terms] += have[t, :terms] @ (matrix.T * sign[:, None] * sign)
            if size is not None:
                into[level][t, TERMS:] += have[s, TERMS:] @ size.T
                into[level][s, TERMS:] += have[t, TERMS:] @ size


def descend(into: dict[int, np.ndarray], levels: int) -> np.ndarray:
    """The expansions of the last level, with those of the cells above."""
    for level in range(2, levels):
        for octant in OCTANTS:
            offset, below = octant * 0.5 - 0.25, number(cells(level) * 2 + octant, level + 1)
            into[level + 1][below, :TERMS] += into[level][:, :TERMS] @ downward(offset).T
            into[level + 1][below, TERMS:] += into[level][:, TERMS:] @ weights(GRID * 0.5 + offset).T * 0.5
    return into[levels]


def pulls(local: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What pulls bodies at places around the cell's centre, in 1 / width^2."""
    nodes = local[TERMS:].reshape(NODES, NODES, NODES)
    slopes = [np.moveaxis(np.tensordot(SLOPE, nodes, (1, axis)), 0, axis).ravel() for axis in range(3)]
    return basis(at, ORDER).T @ gradient(local[:TERMS]) + weights(at) @ np.column_stack(slopes)
