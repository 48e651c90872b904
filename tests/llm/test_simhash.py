import random
import re

import numpy as np
import xxhash

from orbweave.llm import simhash as S
from orbweave.llm.common import Cuts
from orbweave.llm.components import components
from tests.llm.helpers import Union, docs_frame, frame, odd_rows


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    groups = Union(fps)
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius:
                groups.join(a, b)
    return groups


def near_points(rng, n, centers, flips):
    base = [rng.getrandbits(64) for _ in range(centers)]
    out = []
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


def test_fingerprints():
    rng = random.Random(1)
    texts = [r[1] for r in odd_rows()] + [" ".join(f"W{rng.randrange(50)}" for _ in range(n)) for n in (1, 2, 3, 4, 254, 255, 256, 257, 258, 600)]
    got = S.fingerprints_of([(t or "").encode() for t in texts])
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in texts]


def test_a_shard_links_what_brute_force_links(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 8)
    monkeypatch.setattr(S, "AT_ONCE", 64)
    rng = random.Random(2)
    for flips in (0, 2, 5, 30):
        fps = near_points(rng, 300, 12, flips)
        arr = np.array(fps, np.uint64)
        a, b = S.link_shard(arr, arr, 3)
        want, got = brute_components(fps), Union(fps)
        for x, y in zip(a.tolist(), b.tolist()):
            got.join(x, y)
        assert {x: want.find(x) for x in fps} == {x: got.find(x) for x in fps}
        assert len(a) == len({x for x in fps}) - len({want.find(x) for x in fps})


def test_tree_sends_each_pair_to_a_shared_leaf():
    rng = random.Random(3)
    fps = np.array(near_points(rng, 600, 20, 6), np.uint64)
    tree = S.VantageTree.fit(fps[:200], 4)
    leaf, index, home = tree.visits(fps, 3)
    assert home.sum() == len(fps)
    own = dict(zip(index[home].tolist(), leaf[home].tolist()))
    seen = set(zip(index.tolist(), leaf.tolist()))
    for i in range(len(fps)):
        for j in range(len(fps)):
            if int(fps[i] ^ fps[j]).bit_count() <= 3:
                assert (j, own[i]) in seen


def test_shards_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    fps = sorted({x - (1 << 64) if x >= 1 << 63 else x for x in near_points(rng, 500, 30, 4)})
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    monkeypatch.setattr(S, "SHARD", 40)
    edges = S.link(table, len(fps)).collect()
    want, got = brute_components([x & (1 << 64) - 1 for x in fps]), Union([x & (1 << 64) - 1 for x in fps])
    for a, b in edges:
        got.join(a & (1 << 64) - 1, b & (1 << 64) - 1)
    assert all(want.find(x & (1 << 64) - 1) == got.find(x & (1 << 64) - 1) for x in fps)


def test_components_of_any_graph(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (3, None)]
    groups = Union(range(600))
    for a, b in edges:
        if a is not None and b is not None:
            groups.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Cuts(spark)).collect()}
    assert got == {x: groups.find(x) for x in range(600) if groups.find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), Cuts(spark)).count() == 0


def test_documents(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(400)) for _ in range(12)]
    texts = base + [base[i % 12] + " more" for i in range(24)] + base[:6] + [None, "", "  ", "one", "ONE", "two words"]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(frame(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    groups = brute_components(list(set(fps)))
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(groups.find(f), i)
    assert got == {i: (f"{f:016x}", first[groups.find(f)]) for i, f in enumerate(fps)}
    kept = sorted(r["doc_id"] for r in S.keep_first(frame(spark, texts)).collect())
    assert kept == sorted(first.values())


def test_odd_rows(spark):
    df = docs_frame(spark)
    found = S.near_duplicates(df).collect()
    assert len(found) == len(odd_rows())
    assert {r["fingerprint"] for r in found if r["doc_id"] in (0, 1, 2, 3)} == {"0" * 16}
    assert {r["component_id"] for r in found if r["doc_id"] in (0, 1, 2, 3)} == {0}
    kept = S.keep_first(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 1 and ids.count(8) == 1 and 9 not in ids and 0 in ids and 1 not in ids
    assert S.near_duplicates(docs_frame(spark, [])).count() == 0 and S.keep_first(docs_frame(spark, [])).count() == 0


def test_rows_of_one_id_that_are_no_copies_all_stay(spark):
    rng = random.Random(7)
    text = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(200))
    one, two, three = text(), text(), text()
    rows = [(1, one), (1, two), (2, one), (1, one), (None, two), (None, three), (None, three), *[(5, one)] * 300, *[(5, three + " " + str(i)) for i in range(3)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in S.keep_first(df).collect()]
    groups = brute_components([brute_fingerprint(t) for _, t in rows])
    root = {t: groups.find(brute_fingerprint(t)) for _, t in rows}
    assert len(kept) == len(set(root.values())) == len({root[t] for _, t in kept})
    assert sorted(kept, key=str)[:2] == sorted([(1, one), (1, two)]) and sum(i == 5 for i, _ in kept) == 1


def test_columns_named_like_the_operators_own_stay(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", 7, "y"), (2, "A b c d", "z", 8, "y")], "doc_id long, text string, row string, fp long, root string")
    kept = S.keep_first(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d", "x", 7, "y")]
