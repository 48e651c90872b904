import numpy as np

from orbweave.operators import multipole, nbody
from tests.test_gravity import BODY, brute, forces


def clustered(n, seed=1, side=60.0):
    """Uniform bodies, a dense cluster, some in the corners of cells, and two at one place."""
    rng = np.random.default_rng(seed)
    at = rng.uniform(0, side, (n, 3))
    at[: n // 8] = side / 3 + rng.normal(size=(n // 8, 3))
    at[n // 8 : n // 4] = np.round(at[n // 8 : n // 4] / side * 8) * side / 8
    at[1] = at[0]
    return [(i, *map(float, x), float(m)) for i, (x, m) in enumerate(zip(at, rng.uniform(0.5, 1.5, n)))]


def kernel(d2, formula):
    if formula == "plain":
        return np.where(d2 > 1e-12, 1 / (np.where(d2 > 0, d2, 1) ** 1.5 + 1e-12), 0)
    return np.where(d2 > 1e-10, 1 / (np.where(d2 > 0, d2, 1) * np.sqrt(d2 + 1e-6)), 0)


def test_distant_cells_are_summed_to_rounding():
    """Cells that meet at all levels, in all corners, against sums of all pairs of these."""
    levels, side = 3, 50.0
    rows = np.array(clustered(1_500, 2, side * (1 - 1e-9)))
    at, mass = rows[:, 1:4], rows[:, 4]
    cube = nbody.Cube((0.0, 0.0, 0.0), side, levels)
    cell = cube.numbers(at)
    last = np.zeros((8**levels, multipole.LENGTH))
    for c in np.unique(cell):
        last[c] = multipole.moments(cube.within(c, at[cell == c]), mass[cell == c])
    told = multipole.climb(last, levels)
    width = {level: side / 2**level for level in told}
    d = at[None] - at[:, None]
    d2 = (d * d).sum(axis=2)
    apart = np.array([~np.isin(cell, cube.near(c)) for c in cell])
    for formula in ("softened", "plain"):
        into = {level: np.zeros_like(x) for level, x in told.items()}
        for offset in multipole.OFFSETS:
            multipole.meet(offset, told, into, width, formula, nbody.SOFT)
        local, got = multipole.descend(into, levels), np.zeros((len(at), 3))
        for c in np.unique(cell):
            got[cell == c] = multipole.pulls(local[c], cube.within(c, at[cell == c])) / cube.width**2
        size = np.where(apart, kernel(d2, formula), 0)
        want, sizes = np.einsum("ij,ijk,j->ik", size, d, mass), np.einsum("ij,ij,j->i", size, np.sqrt(d2), mass)
        error = np.abs(got - want).max(axis=1) / sizes
        assert apart.any(axis=1).all() and error.max() < 3e-14 and np.median(error) < 3e-15


def test_many_bodies_meet_by_cells(spark, monkeypatch):
    monkeypatch.setattr(nbody, "EXPANDED", 1_000)
    monkeypatch.setattr(nbody, "PER_CELL", 5)
    rows = clustered(2_500, 3)
    df = spark.createDataFrame(rows, BODY)
    want, at, mass = brute(rows), np.array(rows)[:, 1:4], np.array(rows)[:, 4]
    found = []
    by_cells, slab = nbody._by_cells, nbody.SLAB
    monkeypatch.setattr(nbody, "_by_cells", lambda every, cube, *rest: found.append(cube) or by_cells(every, cube, *rest))
    monkeypatch.setattr(nbody, "SLAB", 1)
    assert np.allclose(forces(nbody.exact(df.repartition(3), 1.0)), want, rtol=1e-11, atol=1e-12)
    monkeypatch.setattr(nbody, "SLAB", slab)
    d = at[None] - at[:, None]
    plain = np.einsum("ij,ijk,i,j->ik", kernel((d * d).sum(axis=2), "plain"), d, mass, mass)
    assert np.allclose(forces(nbody.exact(df, 1.0, "plain")), plain, rtol=1e-11, atol=1e-12)
    assert [c.levels for c in found] == [3, 3]
    # far fewer pairs than all are left to sums pair by pair
    n = np.bincount(found[0].numbers(at), minlength=512)
    assert sum(n[c] * n[found[0].near(c)].sum() for c in range(512)) < len(rows) ** 2 / 3


def test_bodies_without_cells_meet_pair_by_pair(spark, monkeypatch):
    monkeypatch.setattr(nbody, "EXPANDED", 100)
    cubes, cube = [], nbody._cube
    monkeypatch.setattr(nbody, "_cube", lambda *a: cubes.append(cube(*a)) or cubes[-1])
    for rows in ([(i, 1.0, 2.0, 3.0, 1.0) for i in range(200)], [(r[0], *(x * 1e-3 for x in r[1:4]), r[4]) for r in clustered(300, 4)]):
        assert np.allclose(forces(nbody.exact(spark.createDataFrame(rows, BODY), 1.0)), brute(rows))
    lost = spark.createDataFrame([(i, float("nan") if i == 7 else float(i), 0.0, 0.0, 1.0) for i in range(150)], BODY)
    assert nbody.exact(lost, 1.0).count() == 150 and cubes == [None] * 3


def test_a_rest_under_the_rounding_is_not_summed():
    width, levels = {2: 14.0, 3: 7.0}, (2, 3)
    told = {level: np.ones((8**level, multipole.LENGTH)) for level in levels}
    for x in told.values():
        x[:, multipole.TERMS :] = np.nan  # not to be read
    into = {level: np.zeros_like(x) for level, x in told.items()}
    multipole.meet(np.array([3, 0, 0]), told, into, width, "plain", 0.0)
    assert all(np.isfinite(x).all() and x[:, : multipole.TERMS].any() for x in into.values())
    for formula in ("plain", "softened"):
        for offset, w in ((np.array([2, 2, 0]), 7.0), (np.array([3, 0, 0]), 7.0), (np.array([5, 5, 5]), 50.0)):
            d = np.linalg.norm(np.maximum(np.abs(offset) - 1, 0)) * w  # the nearest places
            changed = abs(kernel(np.array([d * d]).astype(np.longdouble), formula)[0] * np.longdouble(d) ** 3 - 1)
            assert not multipole.is_nothing(offset, w, formula, nbody.SOFT) or changed < 2.0**-50
    assert not multipole.is_nothing(np.array([2, 0, 1]), 0.01, "plain", 0.0) and not multipole.is_nothing(np.array([5, 5, 5]), 50.0, "softened", nbody.SOFT)
