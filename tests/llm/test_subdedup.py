import collections
import random
import re

import numpy as np
import pytest
import xxhash

from orbweave.llm import subdedup as S
from orbweave.llm.common import Cuts
from tests.llm.helpers import PASSAGE, Union, docs_frame, frame, odd_rows

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(data):
    return tuple(w.lower() for w in WORD.findall(data))


def shingles(line):
    return {line[i : i + 5] for i in range(len(line) - 4)}


def brute(docs):
    """Cleaned texts by comparing all paragraphs with each other, and then all windows."""
    have = collections.defaultdict(set)
    for i, text in docs:
        for line in (text or "").encode().split(b"\n"):
            if len(words(line)) >= 5:
                have[words(line)].add(i)
    paragraphs = list(have)
    sets, groups = {p: shingles(p) for p in paragraphs}, Union(paragraphs)
    for a in paragraphs:
        for b in paragraphs:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                groups.join(a, b)
    first = collections.defaultdict(lambda: float("inf"))
    for p in paragraphs:
        first[groups.find(p)] = min(first[groups.find(p)], *have[p])
    left = []
    for i, text in docs:
        lines = (text or "").encode().split(b"\n")
        marked = [len(words(x)) >= 5 and first[groups.find(words(x))] != i for x in lines]
        gone, at = set(), 0
        while at < len(lines):
            end = at
            while end < len(lines) and (marked[end] or marked[at] and not words(lines[end])):
                end += 1
            run = [k for k in range(at, end) if marked[k]]
            if sum(len(words(lines[k])) for k in run) >= 25:
                gone |= set(range(run[0], run[-1] + 1))
            at = max(end, at + 1)
        left.append((i, b"".join(x + (b"\n" if k < len(lines) - 1 else b"") for k, x in enumerate(lines) if k not in gone)))
    owner = {}
    for i, data in sorted(left):
        w = words(data)
        for k in range(len(w) - 49):
            owner.setdefault(w[k : k + 50], i)
    for (i, data), (_, text) in zip(left, docs):
        at = [m.span() for m in WORD.finditer(data)]
        w, gone = words(data), set()
        for k in range(len(w) - 49):
            if owner[w[k : k + 50]] != i:
                end = at[k + 50][0] if k + 50 < len(w) else len(data)
                line = data.find(b"\n", at[k + 49][1])
                gone |= set(range(at[k][0], end if line < 0 else min(end, line)))
        yield i, None if text is None else bytes(c for k, c in enumerate(data) if k not in gone).decode()


def made_up(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passages = [" ".join(sentence(rng.randint(3, 20)) for _ in range(6)) for _ in range(4)]
    docs = []
    for i in range(60):
        lines = [" ".join(sentence(rng.randint(1, 25)) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 5))]
        if i % 4 == 0:
            lines.append(sentence(7) + " " + rng.choice(passages))
        if i % 5 == 0:
            lines.insert(0, rng.choice(passages))
        if i % 6 == 0:
            changed = (passages[0] + " " + passages[1]).split()
            changed[rng.randrange(len(changed))] = "changed"
            lines.append(" ".join(changed))
        if i % 10 == 0 and lines:
            lines.append(lines[0])
        if i % 9 == 0:
            lines += ["", *(" ".join(passages[3].split()[k : k + 9]) for k in range(0, 27, 9)), " "]
        docs.append((i, "\n".join(lines)))
    return docs


def cleaned(df):
    return {r["doc_id"]: r["text"] for r in S.deduplicate(df).collect()}


def test_equals_brute_force(spark):
    docs = made_up()
    got = cleaned(spark.createDataFrame(docs, "doc_id long, text string"))
    want = dict(brute(docs))
    assert got == want and sum(want[i] != t for i, t in docs) > 15


def test_blocks_change_nothing(spark, monkeypatch):
    docs = made_up(2)
    monkeypatch.setattr(S, "BLOCK", 3)
    assert cleaned(spark.createDataFrame(docs, "doc_id long, text string")) == dict(brute(docs))


@pytest.mark.parametrize("place", ["own line", "inside a line"])
def test_a_passage_stays_once_and_clean_documents_stay(spark, place):
    join = "\n" if place == "own line" else " "
    own = [" ".join(f"own{i}x{j}" for j in range(30)) for i in range(5)]
    texts = [f"Number {i} starts with {own[i]}.{join}{PASSAGE}" for i in range(5)] + ["A clean document with nothing that anybody else has said before."] * 1
    got = cleaned(frame(spark, texts))
    assert got[0] == texts[0] and got[5] == texts[5]
    assert all(PASSAGE not in got[i] and got[i].startswith(f"Number {i} starts") for i in range(1, 5))


def test_short_repeats_stay(spark):
    texts = ["All rights reserved.\nSome text of my own number one.", "All rights reserved.\nSome text of my own number two."]
    assert cleaned(frame(spark, texts)) == dict(enumerate(texts))


def test_similar_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(40)]
    a, b = S.similar_pairs(sets, sets, 0.5)
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if len(np.intersect1d(x, y)) >= 0.5 * len(np.union1d(x, y))}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_recall_of_the_bands():
    n, rows = S.bands()
    assert (n, rows) == (12, 4) and 1 - (1 - S.SIMILARITY**rows) ** n >= S.RECALL
    assert S.bands(0.8, 0.99, 200)[1] > S.bands(0.8, 0.999, 64)[1]
    rng, found = np.random.default_rng(4), {0.3: 0, 0.8: 0, 0.9: 0}
    for similarity in found:
        for _ in range(400):
            common = round(60 * 2 * similarity / (1 + similarity))
            x = rng.integers(0, 1 << 63, 120 - common, dtype=np.uint64)
            both = np.concatenate((x[:60], x[:common], x[60:]))
            keys = S.signatures(both, np.array([0, 60, 120]), (n, rows))
            found[similarity] += any(k[0] == k[1] for k in keys)
    assert found[0.8] >= 396 and found[0.9] == 400 and found[0.3] < 80


def test_words_hash_by_all_their_bytes():
    rng = random.Random(8)
    every = {bytes(rng.choice(b"abcdefgh") for _ in range(n)) for n in (1, 2, 7, 8, 9, 15, 16, 17, 250, 256, 257, 300, 5_000) for _ in range(8)}
    every |= {w[:-1] + b"z" for w in every}
    every = sorted(every)
    units = S.Units([b" ".join(every[:40]), b"", b"\n".join(every[40:]) + b"\n"])
    alone = [int(S.Units([w]).hashes[0]) for w in every]
    assert units.hashes.tolist() == alone and len(set(alone)) == len(every)
    assert units.digests(np.array([0, 3]), np.array([2, 4])) == [xxhash.xxh3_128_digest(b" ".join(every[:2])), xxhash.xxh3_128_digest(every[3])]


def test_texts_that_polynomial_hashes_take_for_equal(spark):
    """The Thue-Morse sequence and its complement, as every second word: a sum of words times powers of any number, modulo 2^64, is the same for both."""
    bits = [i.bit_count() % 2 for i in range(1024)]
    rng = random.Random(9)
    filler = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in bits]
    docs = [" ".join(f"{f} {'xy'[b ^ flip]}" for f, b in zip(filler, bits)) for flip in (0, 1)]
    assert cleaned(frame(spark, docs)) == dict(enumerate(docs))
    units = S.Units([d.encode() for d in docs])
    assert len(set(units.digests(units.first[:2], units.first[1:3]))) == 2
    halves = S.sequence_hashes(units.hashes, 2048)
    assert halves[0] != halves[2048]


def test_a_large_group_of_near_copies_keeps_every_link(spark, monkeypatch):
    """Chains of near copies, of which the ends aren't similar, with few representatives in a band and small blocks."""
    monkeypatch.setattr(S, "BLOCK", 7)
    rng = random.Random(10)
    nodes, sets = [], []
    for g in range(6):
        base = [rng.getrandbits(63) for _ in range(40)]
        for i in range(30):
            base[rng.randrange(40)] = rng.getrandbits(63)
            nodes.append(rng.getrandbits(60))
            sets.append(set(base))
    rows = [(k, n) for k in range(3) for i, n in enumerate(nodes) if k == 0 or i % 30 // 10 == k]
    members = spark.createDataFrame(rows, "k long, node long")
    table = spark.createDataFrame([(n, bytearray(np.unique(np.array(list(x), np.uint64)).tobytes())) for n, x in zip(nodes, sets)], "node long, shingles binary")
    got, want = Union(nodes), Union(nodes)
    for r in S.links(members, table, Cuts(spark), 0.8).collect():
        got.join(r["a"], r["b"])
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                want.join(nodes[i], nodes[j])
    assert {n: got.find(n) for n in nodes} == {n: want.find(n) for n in nodes}
    assert 6 <= len({want.find(n) for n in nodes}) < 150


def test_prefilter_never_loses_a_key(spark):
    h = np.random.default_rng(2).integers(-(2**63), 2**63, 500)
    bits = S.Bits.build(spark.createDataFrame([(int(x),) for x in h], "h long"), "h", 500)
    assert bits(h.view(np.uint64)).all()
    other = np.random.default_rng(3).integers(0, 2**63, 5_000).astype(np.uint64)
    assert bits(other).mean() < 0.05


def test_equal_ids_with_other_texts(spark):
    own = [" ".join(f"own{i}x{j}" for j in range(40)) + "." for i in range(3)]
    rows = [(1, f"{own[0]}\n{PASSAGE}"), (2, f"{PASSAGE}\n{own[1]}"), (2, f"{own[2]}\n{own[1]} {PASSAGE}")]
    got = sorted(r["text"] for r in S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # rows of one id are one document, which keeps what it has twice, but not what an earlier one has
    assert got == sorted([rows[0][1], own[1], f"{own[2]}\n{own[1]} "])


def test_many_rows_of_one_id_and_of_none(spark):
    own = [" ".join(f"own{i}x{j}" for j in range(30)) for i in range(120)]
    rows = [(7 if i % 2 else None, f"{x}\n{PASSAGE}") for i, x in enumerate(own)] + [(3, PASSAGE), (None, own[1]), (None, "Only here. " + own[0] * 2)]
    got = sorted(r["text"] for r in S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    # what only rows without an id have stays in all of them
    assert got == sorted([*(x + "\n" for x in own), PASSAGE, "", "Only here. " + own[0] * 2])


def test_columns_named_like_the_operators_own_stay(spark):
    df = spark.createDataFrame([(i, f"Number {i}.\n{PASSAGE}", "x", 5, "l", "w") for i in range(3)], "doc_id long, text string, id string, h long, lines string, windows string")
    out = S.deduplicate(df)
    assert out.columns == [*df.columns, "cut_spans"]
    assert sorted(tuple(r)[:6] for r in out.collect())[1:] == [(i, f"Number {i}.\n", "x", 5, "l", "w") for i in (1, 2)]


def test_odd_rows(spark):
    df = docs_frame(spark)
    out = S.deduplicate(df)
    assert out.columns == [*df.columns, "cut_spans"]
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    texts = dict((r[0], r[1]) for r in odd_rows() if r[0] is not None)
    want = [(i, t) for i, t in texts.items()] + [(8, PASSAGE), (None, "no id at all"), (None, None)]
    want = [(i, "" if i in (9, 10) else t) for i, t in want]
    assert got == sorted(want, key=str)
    assert S.deduplicate(docs_frame(spark, [])).count() == 0


def shared(texts):
    """Windows of 50 words that several of the texts have."""
    count = collections.Counter()
    for t in texts:
        w = words(t.encode())
        count.update({w[i : i + 50] for i in range(len(w) - 49)})
    return [w for w, n in count.items() if n > 1]


def checked(spark, docs):
    got = {r["doc_id"]: r for r in S.deduplicate(frame(spark, docs)).collect()}
    out = [got[i]["text"] for i in range(len(docs))]
    for i, old in enumerate(docs):
        edges = [0, *got[i]["cut_spans"], len(old.encode())]
        assert out[i].encode() == b"".join(old.encode()[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return out


def test_no_window_of_an_unpunctuated_passage_stays_twice(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    docs = []
    for _ in range(60):
        passage = some(rng.randint(51, 60))
        docs += [f"{some(30)} {passage} {some(20)}" for _ in range(3)]
    docs[0] += "\n" + PASSAGE
    docs[1] = PASSAGE + "\n" + docs[1]
    assert len(shared(docs)) > 60
    out = checked(spark, docs)
    assert not shared(out)
    # what is a document's own stays
    assert all(o.split()[:5] == d.split()[:5] and o.split()[-5:] == d.split()[-5:] for o, d in zip(out[3:], docs[3:]))


def test_joined_spans():
    text, old, new = "".join(map(chr, range(48, 108))), [3, 6, 10, 12, 30, 40], [(4, 9), (18, 22), (40, 43)]
    cut = lambda t, s: "".join(t[a:b] for a, b in zip([0, *s[1::2]], [*s[::2], len(t)]))
    assert cut(cut(text, old), [x for s in new for x in s]) == cut(text, S._joined(old, new))


def test_lists_of_short_lines_stay_once(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    lines = [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(100)]
    intro = [" ".join(word() for _ in range(12)) + "." for _ in range(6)]
    talk = " ".join(word() + "!!" for _ in range(80))
    docs = [f"{x}\n" + "\n".join(lines) for x in intro[:3]] + [f"{x} {talk}" for x in intro[3:]]
    out = checked(spark, docs)
    assert out[0] == docs[0] and out[3] == docs[3] and not shared(out)
    assert [o.strip("! \n") for o in out[1:3] + out[4:]] == intro[1:3] + intro[4:]
