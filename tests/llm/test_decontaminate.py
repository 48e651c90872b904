import hashlib
import random
import re

from orbweave.llm import decontaminate as D
from orbweave.llm import subdedup as S
from orbweave.llm.common import Cuts
from tests.llm.helpers import docs_frame, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        windows += [(item, w[i : i + n]) for i in range(len(w) - n + 1) if w]
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= {*range(i, i + len(window))}
                    found.add(item)
        yield doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def rows(found):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect()), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    some = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(some) for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 20, 40])))) for i in range(25)] + [(90, None), (91, ""), (92, "..."), (93, "w1 w2"), (93, "w1 w2")]
    docs = []
    for i in range(120):
        parts = [" ".join(rng.choice(some + ["other", "Else", "X9"]) for _ in range(rng.randint(0, 40)))]
        if i % 3 == 0:
            parts.append(rng.choice(items)[1] or "")
            parts.append("tail " * rng.randint(0, 200))
        docs.append((i, ", ".join(parts)))
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = corpus()
    items = items[:-1]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items), key=str)
    assert rows(D.match(d, b)) == want
    kept = sorted(r["doc_id"] for r in D.clean(d, b).collect())
    assert kept == sorted(w[0] for w in want if not w[-1])
    # filters that are too small for the benchmark let more through, and the joins decide
    monkeypatch.setattr(S, "MOST_BITS", 64)
    assert rows(D.match(d, b)) == want


def test_prefix_is_the_rarest_shingle(spark):
    text = "a b c d e f g h i j k l m n"
    docs = spark.createDataFrame([(1, 0, text), (2, 0, "a b c d e f " * 3), (3, 0, "c d e f g h i"), (4, 0, "c d e f g h i j")], "id long, h long, text string")
    cuts = Cuts(spark)
    found = D.windows(spark.createDataFrame([(1, text), (2, "x y z")], "item_id long, text string"), cuts, "item_id", "text", 13)
    assert found.count() == 3
    by = {tuple(r["words"]): r["at"] for r in D.prefixes(docs, found, cuts, (3, 5)).collect()}
    # shingles of which only the first document has one; "x y z" is in none
    assert set(by) == {tuple(text.split()[:13]), tuple(text.split()[1:])} and by[tuple(text.split()[:13])] in (6, 7, 8)


def test_many_rows_of_one_id_and_of_none(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [(5 if i % 2 else None, f"Number {i} says {passage if i % 3 else 'nothing'}") for i in range(60)] * 2
    d, b = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame([("x", passage)], "item_id string, text string")
    assert sorted((r["doc_id"], r["contaminated"], r["n_hit"]) for r in D.match(d, b).collect() if r["doc_id"]) == sorted((i, "p0" in t, 20 * ("p0" in t)) for i, t in texts if i)
    assert sorted(r["text"] for r in D.clean(d, b).collect()) == sorted(t for _, t in texts if "p0" not in t)


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "no id at all"), (None, "before it all"), (2, None), (3, "日本語のテキスト。"), (3, "日本語のテキスト。")], "item_id long, text string")
    found = D.match(docs_frame(spark), bench).collect()
    assert len(found) == len(odd_rows())
    by = {r["doc_id"]: r for r in found}
    assert by[10]["n_hit"] == 3 and by[10]["n_items"] == 1 and by[10]["items"] == [] and by[10]["contaminated"]
    assert by[11]["n_items"] == 2 and by[11]["items"] == ["3", "3"]
    assert by[0]["n_words"] == by[1]["n_words"] == 0 and not by[0]["contaminated"]
    assert by[7]["n_words"] == 30_001
    kept = D.clean(docs_frame(spark), bench)
    assert kept.columns == docs_frame(spark).columns and kept.count() == sum(not r["contaminated"] for r in found)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert D.clean(docs_frame(spark), empty).count() == len(odd_rows())
    assert D.match(docs_frame(spark, []), bench).count() == 0
