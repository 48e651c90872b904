import random

import numpy as np

from orbweave.operators import nbody, octree
from orbweave.operators.validation import force_error

BODY = "id long, x double, y double, z double, mass double"


def bodies(n, seed=1, at=None):
    rng = random.Random(seed)
    return [(i, *(at or (rng.uniform(-100, 100), rng.uniform(-100, 100), rng.uniform(-100, 100))), rng.uniform(0.5, 1.5)) for i in range(n)]


def brute(rows, g=1.0):
    at, m = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    d = at[None, :, :] - at[:, None, :]
    d2 = (d * d).sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        size = np.where(d2 > 1e-10, g * m[:, None] * m[None, :] / (d2 * np.sqrt(d2 + 1e-6)), 0)
    return np.einsum("ij,ijk->ik", size, d)


def forces(df):
    got = {r["id"]: (r["fx"], r["fy"], r["fz"]) for r in df.collect()}
    return np.array([got[i] for i in sorted(got)])


def test_exact_and_theta_zero(spark):
    rows = bodies(150) + [(150, *bodies(1)[0][1:4], 2.0)]
    df = spark.createDataFrame(rows, BODY)
    want = brute(rows)
    assert np.allclose(forces(nbody.exact(df, 1.0)), want) and np.allclose(forces(nbody.exact(df.repartition(3), 1.0, block=40)), want)
    assert np.allclose(forces(nbody.barnes_hut(df, 0.0, 1.0, 10)), want)
    assert np.allclose(forces(nbody.exact(df, 1.0, "plain")), want, rtol=1e-4, atol=1e-6)


def test_each_pair_is_computed_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    at, mass = rng.uniform(-9, 9, (70, 3)), rng.uniform(0.5, 1.5, 70)
    at[60] = at[3]
    want = brute([(i, *at[i], mass[i]) for i in range(70)])
    monkeypatch.setattr(nbody, "TILE", (8, 16))
    to, back = nbody._sums(at[:30], mass[:30], at[30:], mass[30:], "softened", True)
    own, other = nbody._sums(at[:30], mass[:30], at[:30], mass[:30], "softened", False)[0], nbody._sums(at[30:], mass[30:], at[30:], mass[30:], "softened", False)[0]
    assert np.allclose(np.concatenate((to + own, back + other)) * mass[:, None], want)
    rows = bodies(150) + [(150, *bodies(1)[0][1:4], 2.0)]
    df = spark.createDataFrame(rows, BODY)
    for block in (7, 40, 1_000):
        assert np.allclose(forces(nbody.exact(df, 1.0, block=block)), brute(rows))
    assert np.allclose(forces(nbody.exact(df, 1.0, "plain", block=40)), brute(rows), rtol=1e-4, atol=1e-6)


def test_theta_zero_lists_no_pairs(spark):
    df = spark.range(6_000).selectExpr("id", "double(id % 61) AS x", "double(id % 53) AS y", "double(id % 7) AS z", "1D AS mass")
    found = nbody.barnes_hut(df, 0.0, 1.0, 16)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    assert np.allclose(forces(found), brute([tuple(r) for r in df.collect()]), rtol=1e-9, atol=1e-9)


def test_approximation(spark):
    df = spark.createDataFrame(bodies(400, 2), BODY)
    exact = nbody.exact(df, 1.0)
    near = nbody.barnes_hut(df, 0.5, 1.0, 8)
    assert force_error(near, exact).first()["error"] < 0.02
    a, b = forces(near), forces(exact)
    size = np.linalg.norm(b, axis=1)
    assert np.median(np.linalg.norm(a - b, axis=1) / size) < 0.02 and nbody.barnes_hut(df, 2.0, 1.0, 8).count() == 400


def test_leaves(spark):
    for n, leaves in ((128, True), (129, False)):
        root = octree.build(spark.createDataFrame(bodies(n, 3), BODY)).nodes.where("key = ''").first()
        assert root["n"] == n and root["is_leaf"] == leaves
    same = octree.build(spark.createDataFrame(bodies(200, 4, (1.0, 2.0, 3.0)), BODY))
    assert same.levels == 1 and same.nodes.first()["width"] == 0
    assert octree.build(spark.createDataFrame([], BODY)).nodes.count() == 0
    assert nbody.barnes_hut(spark.createDataFrame([], BODY)).count() == 0 and nbody.exact(spark.createDataFrame([], BODY)).count() == 0


def test_tree(spark):
    rows = bodies(300, 5)
    tree = octree.build(spark.createDataFrame(rows, BODY), 8)
    nodes = {r["key"]: r for r in tree.nodes.collect()}
    assert sum(r["n"] for r in nodes.values() if r["is_leaf"]) == 300 and tree.members.count() == 300
    for key, node in nodes.items():
        if not node["is_leaf"]:
            below = [nodes[key + d] for d in "01234567" if key + d in nodes]
            assert sum(b["n"] for b in below) == node["n"] and np.isclose(sum(b["mass"] for b in below), node["mass"])
            assert np.isclose(sum(b["mass"] * b["com_x"] for b in below), node["mass"] * node["com_x"])
    ropes = {r["key"]: r for r in octree.ropes(tree).collect()}
    order = sorted(nodes)
    assert [ropes[k]["index"] for k in order] == list(range(len(order)))
    for k in order:
        assert ropes[k]["rope"] == ropes[k]["index"] + sum(x.startswith(k) for x in order) and ropes[k]["next_index"] == ropes[k]["index"] + 1
    massless = octree.build(spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0), (2, 2.0, 2.0, 2.0, -1.0)], BODY)).nodes.first()
    assert (massless["com_x"], massless["com_y"], massless["com_z"]) == (0, 0, 0)
    assert {r["key"]: r["n"] for r in octree.octants(tree).collect()} == {k: v["n"] for k, v in nodes.items() if len(k) == 1}


def test_command_line_at_theta_zero(spark, tmp_path, monkeypatch):
    from orbweave import __main__ as cli

    rows = bodies(300, 7)
    (tmp_path / "bodies.csv").write_text("".join(",".join(map(str, r[1:])) + "\n" for r in rows))
    frontiers = []
    monkeypatch.setattr(nbody, "_pull", lambda *a: frontiers.append(a))
    words = cli.main(["gravity", str(tmp_path / "bodies.csv"), "0", "--g", "1"]).split()
    assert not frontiers and int(words[0]) == 300
    assert np.isclose(float(words[4].rstrip(",")), np.linalg.norm(brute(rows), axis=1).sum(), rtol=1e-4)


def test_theta_zero_builds_no_tree(spark, monkeypatch):
    built = []
    monkeypatch.setattr(octree, "build", lambda *a: built.append(a))
    rows = bodies(200, 9)
    assert np.allclose(forces(nbody.barnes_hut(spark.createDataFrame(rows, BODY), 0.0, 1.0)), brute(rows)) and not built


def test_distant_tiles_by_products_are_exact(monkeypatch):
    rng = np.random.default_rng(10)
    at, mass = np.concatenate((rng.uniform(-100, 100, (900, 3)), rng.normal(size=(300, 3)) * 1e-3)), rng.uniform(0.5, 1.5, 1_200)
    at[1_000] = at[900]
    at, mass = np.concatenate((at, at[:50] + 1e-4)) + 1e4, np.concatenate((mass, mass[:50]))
    order = nbody._curve(at)
    at, mass = at[order], mass[order]
    near, close = [], nbody._near_sums
    monkeypatch.setattr(nbody, "_near_sums", lambda a, m, b, *rest: near.append(len(a) * len(b)) or close(a, m, b, *rest))
    monkeypatch.setattr(nbody, "TILE", (32, 64))
    monkeypatch.setattr(nbody, "PART", (8, 16))
    d = at[None] - at[:, None]
    d2 = (d * d).sum(axis=2)
    for formula, size in (("softened", np.where(d2 > 1e-10, 1 / np.where(d2 > 0, d2 * np.sqrt(d2 + 1e-6), 1), 0)), ("plain", np.where(d2 > 1e-12, 1 / (d2 * np.sqrt(d2) + 1e-12), 0))):
        near.clear()
        to, back = nbody._sums(at[:700], mass[:700], at, mass, formula, True)
        want, want_back = np.einsum("ij,ijk,j->ik", size, d, mass)[:700], -np.einsum("ij,ijk,i->jk", size[:700], d[:700], mass[:700])
        # against the sizes that are summed, as pulls from all sides cancel
        sizes = np.einsum("ij,ij,j->i", size, np.sqrt(d2), mass)[:, None]
        assert (np.abs(to - want) <= 1e-13 * sizes[:700]).all() and (np.abs(back - want_back) <= 1e-13 * sizes).all()
        assert 0 < sum(near) < 700 * len(at) / 2


def test_rounds_of_the_tree_use_all_cores(spark, monkeypatch):
    dealt, deal = [], nbody.spread
    monkeypatch.setattr(nbody, "spread", lambda df: dealt.append(df.columns) or deal(df))
    rows = bodies(100, 11)
    df = spark.createDataFrame(rows, BODY)
    levels = octree.build(df, 16).levels
    assert nbody.barnes_hut(df, 0.5, 1.0, 16).count() == 100
    assert len(dealt) == 2 * levels and all("key" in columns for columns in dealt)
