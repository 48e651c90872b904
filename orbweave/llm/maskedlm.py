"""Language-model scores by masked pseudo-likelihood.

A token is a byte of the UTF-8 of the text in lower case. The classes hold all bytes that UTF-8 can have, so every
text of every script is made of classes of their own; the class of all others is only for bytes that the corpus of
the model doesn't have. A small network sees ``REACH`` tokens on either side of a masked one: their embeddings, a weight matrix
for each place, a hidden layer of tanh and a softmax over the classes.

The network can't know what is in the corpus at length, so its prediction is the prior of a count. Every token has a context of
``SIDE`` tokens on either side, and what is counted is how often each token stands in each context. If a context occurs ``t`` times in
the rest of the corpus, and ``n`` times with the token, the token's probability is (n + PRIOR * p) / (t + PRIOR), p being the network's, which sums to one over the tokens. A
text's own row isn't in the rest of the corpus; another row with the same text is. A text's score is the sum over
all its tokens of the log-probability of the token given both its sides.

What is learned from is the count of every window and every context in all texts, so it grows with the corpus.
Tasks count windows, an aggregation adds them up, and the distinct windows are dealt to shards by a
hash. Training is data-parallel in rounds: each shard goes on from the round's parameters with Adam in whole passes
over all its windows, weighted by their counts, and the parameters are averaged by the shards' counts, in fixed
point, so that the sum doesn't depend on its order. Contexts are counted in rounds, by a hash of their left sides; a round deals them to tasks by the ranges of their hashes. A task gets
all tokens whose contexts are in its range, with the network's word on each, and gives every row the sum over these. The network is
evaluated once per distinct window of a task, as far as it remembers them.

Nulls and empty texts have no tokens, a sum of 0 and no mean. A corpus without text gives a uniform model.
Repeated rows count as often as they occur. Other columns are neither read nor returned, but for a hash of them that tells
rows of one id apart; the id column may have any type.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import Cuts, chunks, keep, map_batches, release, row_hash, small_batches
from orbweave.llm.subdedup import _mix
from orbweave.plans.cuts import sweep

CLASSES, BITS = 256, 8
REACH = 2
DIM, HIDDEN = 16, 48
#: A round is one pass over all windows, or as many as take STEPS steps.
ROUNDS, STEPS, BATCH = 5, 64, 1_024
RATE = 6e-3
#: Distinct windows of a shard.
SHARD = 1 << 15
#: Windows that a task counts before it hands them on.
TASK_WINDOWS = 1 << 22
#: Tokens on either side of a context, and how many counts the network's word is worth.
SIDE, PRIOR = 16, 1.0
#: Text whose contexts a task has in memory at once.
CONTEXT_BYTES = 1 << 18
#: Rounds that contexts are counted in, bytes of text that a round has for a task that counts, and contexts that a task holds before it hands them on.
PASSES, SLOT, ASKED = 6, 1 << 22, 1 << 20
#: Parts of 1 in the sums of log-probabilities.
_PARTS = 2.0**28
_FIXED = 2.0**32
_NO_BYTE = 0xFF
_OWNER = "maskedlm"
#: Whether Spark deletes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
EDGE, OTHER = 0, 1


@dataclass(frozen=True)
class Alphabet:
    """Bytes of the classes from 2 on."""

    points: tuple[int, ...]

    def table(self) -> np.ndarray:
        out = np.full(256, OTHER, np.uint8)
        out[list(self.points)] = np.arange(2, len(self.points) + 2)
        return out

    @property
    def used(self) -> int:
        """Classes up to the last that a token can have."""
        return len(self.points) + 2


def _points(texts: list[str | None]) -> list[np.ndarray]:
    return [np.frombuffer((t or "").lower().encode("utf-8", "surrogatepass"), np.uint8) for t in texts]


def alphabet(df: DataFrame, text_col: str = "text") -> Alphabet:
    """The bytes of all texts, the most frequent first; ties by value. UTF-8 in lower case has fewer than CLASSES - 2 of them."""

    def run(batches):
        counts = np.zeros(256, np.int64)
        for batch in batches:
            for part in chunks(batch, text_col):
                counts += np.bincount(np.concatenate([np.zeros(0, np.uint8), *_points(part.column(0).to_pylist())]), minlength=256)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["point", "n"])

    found = map_batches(df.select(text_col), run, "point int, n long").groupBy("point").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point")
    return Alphabet(tuple(r["point"] for r in found.collect()))


def windows(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of the window around each token, the token itself lowest, and how many each text has."""
    points = _points(texts)
    size = np.array([len(p) for p in points], np.int64)
    edge = np.zeros(REACH, np.uint8)
    line = np.concatenate([edge, *(x for p in points for x in (table[p], edge))]).astype(np.int64)
    n = max(len(line) - 2 * REACH, 0)
    code = line[REACH : REACH + n].copy()
    for k, offset in enumerate((*range(-REACH, 0), *range(1, REACH + 1)), 1):
        code |= line[REACH + offset : REACH + offset + n] << (BITS * k)
    return code[code & (CLASSES - 1) != EDGE], size


def _parts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes at the places of the windows, and the tokens."""
    mask = CLASSES - 1
    return np.column_stack([(code >> (BITS * k)) & mask for k in range(1, 2 * REACH + 1)]), code & mask


SHAPES = ((CLASSES, DIM), (2 * REACH * DIM, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))
SIZES = tuple(int(np.prod(s)) for s in SHAPES)


def start(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([(rng.normal(size=s) * (0.0 if len(s) == 1 else 1.0 / np.sqrt(s[0]) if i else 0.3)).ravel() for i, s in enumerate(SHAPES)])


def _split(flat: np.ndarray) -> list[np.ndarray]:
    return [x.reshape(s) for x, s in zip(np.split(flat, np.cumsum(SIZES)[:-1]), SHAPES)]


def log_probabilities(flat: np.ndarray, code: np.ndarray, step: int = 1 << 14, used: int = CLASSES) -> np.ndarray:
    """Of each window's token given its sides, among the first ``used`` classes."""
    embed, inner, bias, outer, last = (x.astype(np.float32) for x in _split(flat))
    outer, last = np.ascontiguousarray(outer[:, :used]), last[:used]
    out = np.empty(len(code))
    for at in range(0, len(code), step):
        places, token = _parts(code[at : at + step])
        hidden = np.tanh(embed[places].reshape(len(token), -1) @ inner + bias)
        logits = hidden @ outer + last
        logits[:, EDGE] = -30  # no token is an edge
        top = logits.max(axis=1)
        out[at : at + step] = logits[np.arange(len(token)), token] - top - np.log(np.exp(logits - top[:, None]).sum(axis=1))
    return out


def _passes(code: np.ndarray, n: np.ndarray, rng: np.random.Generator):
    """Batches (code, weight) of one pass over all windows after another, without end. In a pass each window has its whole
    count as weight; a count over the mean one is dealt in equal parts to several places, so that no batch hangs on one window.
    Weights are relative to a batch's mean sum."""
    parts = np.ceil(n / n.mean()).astype(np.int64)
    index = np.repeat(np.arange(len(code)), parts)
    batches = -(-len(index) // BATCH)
    weight = np.repeat(n / parts, parts) * (batches / n.sum())
    while True:
        order = rng.permutation(len(index))
        for at in np.array_split(order, batches):
            yield code[index[at]], weight[at].astype(np.float32)


def pass_steps(n: np.ndarray, steps: int) -> int:
    """Steps of the least number of whole passes that takes ``steps`` or more."""
    batches = -(-int(np.ceil(n / n.mean()).sum()) // BATCH)
    return -(-steps // batches) * batches


def train_shard(flat: np.ndarray, code: np.ndarray, n: np.ndarray, seed: int, steps: int, rate: float, used: int = CLASSES) -> np.ndarray:
    """Adam in whole passes over all windows, weighted by their counts: one pass at least, and ``steps`` steps at least. Only the first ``used`` classes are told apart."""
    flat = flat.astype(np.float32)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    batches = _passes(code, n, np.random.default_rng(seed))
    for t in range(1, pass_steps(n, steps) + 1):
        drawn, weight = next(batches)
        places, token = _parts(drawn)
        embed, inner, bias, outer, last = _split(flat)
        outer, last = outer[:, :used], last[:used]
        x = embed[places].reshape(len(token), -1)
        hidden = np.tanh(x @ inner + bias)
        logits = hidden @ outer + last
        logits[:, EDGE] = -30
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(token)), token] -= 1
        p *= weight[:, None]
        back = (p @ outer.T) * (1 - hidden * hidden)
        to_embed = np.zeros_like(embed)
        np.add.at(to_embed, places.ravel(), (back @ inner.T).reshape(-1, DIM))
        rest = ((0, 0), (0, CLASSES - used))
        gradient = np.concatenate([to_embed.ravel(), (x.T @ back).ravel(), back.sum(axis=0), np.pad(hidden.T @ p, rest).ravel(), np.pad(p.sum(axis=0), rest[1])])
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient * gradient - v)
        flat -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return flat.astype(np.float64)


def count_windows(df: DataFrame, letters: Alphabet, text_col: str = "text") -> DataFrame:
    """(code, n) of every window of all texts."""

    def run(batches):
        table = letters.table()
        codes, counts, held = [], [], 0

        def merged():
            code, where = np.unique(np.concatenate(codes), return_inverse=True)
            return code, np.bincount(where, np.concatenate(counts).astype(np.float64)).astype(np.int64)

        def batch_of(code, n):
            for at in range(0, len(code), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(code[at : at + (1 << 18)]), pa.array(n[at : at + (1 << 18)])], ["code", "n"])

        for batch in batches:
            for part in chunks(batch, text_col):
                code, n = np.unique(windows(part.column(0).to_pylist(), table)[0], return_counts=True)
                codes.append(code)
                counts.append(n)
                held += len(code)
                if held > TASK_WINDOWS:
                    code, n = merged()
                    codes, counts, held = [code], [n], len(code)
                    if held > TASK_WINDOWS // 2:
                        yield from batch_of(code, n)
                        codes, counts, held = [], [], 0
        if codes:
            yield from batch_of(*merged())

    return map_batches(df.select(text_col), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class MaskedModel:
    letters: Alphabet
    flat: np.ndarray


def _shard_trainer(sent, k: int, steps: int, rate: float, used: int):
    def shard(key: tuple, table: pa.Table) -> pa.Table:
        code, n = table.column("code").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(code)
        new = train_shard(sent.value, code[order], n[order], 1_000_003 * k + key[0].as_py(), steps, rate, used)
        moved = np.round((new - sent.value) * _FIXED).astype(np.int64)
        release()
        return pa.table([pa.array(np.arange(len(new), dtype=np.int32)), pa.array(moved), pa.array(np.full(len(new), int(n.sum())))], names=["i", "moved", "weight"])

    return shard


def fit(df: DataFrame, text_col: str = "text", rounds: int = ROUNDS, steps: int = STEPS) -> MaskedModel:
    small_batches(df.sparkSession)
    letters = alphabet(df, text_col)
    cuts = Cuts(df.sparkSession)
    counted = cuts.cut(count_windows(df, letters, text_col))
    distinct = counted.count()
    flat = start()
    if not distinct:
        return MaskedModel(letters, flat * 0)
    shards = -(-distinct // SHARD)
    dealt = cuts.cut(counted.withColumn("shard", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int")))
    cuts.drop(counted)
    for k in range(rounds):
        sent = df.sparkSession.sparkContext.broadcast(flat)
        moved = dealt.groupBy("shard").applyInArrow(_shard_trainer(sent, k, steps, RATE * (1 - k / rounds), letters.used), "i int, moved long, weight long")
        # decimal sums are exact, whatever their order
        rows = moved.groupBy("i").agg(F.sum(F.col("moved").cast("decimal(38,0)") * F.col("weight").cast("decimal(18,0)")).alias("s"), F.sum("weight").alias("w")).collect()
        step = np.zeros(len(flat))
        for r in rows:
            step[r["i"]] = float(r["s"]) / float(r["w"]) / _FIXED
        flat = flat + step
    cuts.close()
    return MaskedModel(letters, flat)


def _line(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts with ``SIDE`` edges (a byte that UTF-8 doesn't have) around each, and where each text ends."""
    points = _points(texts)
    edge = np.full(SIDE, _NO_BYTE, np.uint8)
    line = np.concatenate([edge, *(x for p in points for x in (p, edge))])
    return line, np.cumsum([SIDE + len(p) for p in points], dtype=np.int64)


def _context_hashes(line: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of the tokens on both sides of each place, eight at a time; every step mixes, so that it is no polynomial."""
    words = np.ndarray((len(line) - 7,), "<u8", line, strides=(1,))
    h = np.zeros(len(place), np.uint64)
    for offset in (*range(-SIDE, 0, 8), *range(1, SIDE + 1, 8)):
        h += words[place + offset]
        h *= np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return _mix(h)


def _round_hashes(line: np.ndarray) -> np.ndarray:
    """Of each ``SIDE`` tokens in a row, by doubling, in 32 bits."""
    h, have = (line.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1), 1
    while have < SIDE:
        step = min(have, SIDE - have)
        out = h[: len(h) - step] * np.uint32(0x85EBCA6B)
        out += h[step:]
        out ^= out >> np.uint32(15)
        h, have = out, have + step
    return h * np.uint32(0xC2B2AE35)


def contexts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, token, text, place among all tokens) of the context of every token. Beyond a text's ends are edges."""
    line, end = _line(texts)
    place = np.flatnonzero(line != _NO_BYTE)
    return _context_hashes(line, place), line[place].astype(np.int16), np.searchsorted(end, place, side="right"), np.arange(len(place))


class _Network:
    """Log-probabilities of tokens at places of a line. What windows give is remembered, a window for each of ``PLACES`` hashes."""

    PLACES = 21

    def __init__(self, model: MaskedModel):
        self.model, self.code, self.value = model, np.full(1 << self.PLACES, -1, np.int64), np.zeros(1 << self.PLACES, np.float32)
        self.classes = model.letters.table().astype(np.int64)
        self.classes[_NO_BYTE] = EDGE

    def __call__(self, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        code = self.classes[line[place]]
        for k, offset in enumerate((*range(-REACH, 0), *range(1, REACH + 1)), 1):
            code |= self.classes[line[place + offset]] << (BITS * k)
        at = self._at(code)
        out, unknown = self.value[at], np.flatnonzero(self.code[at] != code)
        if len(unknown):
            new, where = np.unique(code[unknown], return_inverse=True)
            each = log_probabilities(self.model.flat, new, used=self.model.letters.used).astype(np.float32)
            # the class of all others is as many bytes as the corpus doesn't have
            each -= np.where(new & (CLASSES - 1) == OTHER, np.float32(np.log(256 - len(self.model.letters.points))), np.float32(0))
            out[unknown] = each[where]
            at = self._at(new)
            self.code[at] = new
            stays = self.code[at] == new
            self.value[at[stays]] = each[stays]
        return out

    def _at(self, code: np.ndarray) -> np.ndarray:
        return (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.PLACES)).view(np.int64)


def _ask(sent, key: str, k: int, slots: int):
    """What a round's contexts are asked for: a row is a slot's contexts in some texts, packed by ``_packed``."""
    begin, end = (k << 32) // PASSES, ((k + 1) << 32) // PASSES

    def run(batches):
        network, held, n, docs = keep(_OWNER, (key,), lambda: _Network(sent.value)), [], 0, 0

        def told():
            c, token, p, count, doc, h = (np.concatenate(x) for x in zip(*held))
            slot = ((c >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.uint16 if slots < 1 << 16 else np.int64)
            order = np.argsort(slot, kind="stable")
            c, token, p, count, doc = c[order], token[order], p[order], count[order], doc[order]
            cuts = np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=slots))))
            parts = [_packed(c[a:b], token[a:b], p[a:b], count[a:b], doc[a:b], h) for a, b in zip(cuts[:-1], cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(slots), pa.int32()), pa.array(parts, pa.binary())], ["slot", "told"])

        for batch in batches:
            for part in chunks(batch, "text", CONTEXT_BYTES):
                h = part.column(0).to_numpy(zero_copy_only=False)
                line, ends = _line(part.column(1).to_pylist())
                # equal contexts have equal left sides, and so are in one round
                left = _round_hashes(line)[: -SIDE]
                some = left - np.uint32(begin) < np.uint32(end - begin) if PASSES > 1 else np.ones(len(left), bool)
                place = np.flatnonzero(some & (line[SIDE:] != _NO_BYTE)[: len(left)]) + SIDE
                c, p, token = _context_hashes(line, place), network(line, place), line[place]
                doc = np.repeat(np.arange(docs, docs + len(h)), np.diff(np.searchsorted(place, ends), prepend=0))
                # a run of one token is one context over and over
                same = (c[1:] == c[:-1]) & (token[1:] == token[:-1]) & (doc[1:] == doc[:-1])
                first = np.flatnonzero(np.concatenate(([True], ~same))) if len(c) else np.zeros(0, np.int64)
                count = np.diff(np.append(first, len(c))).astype(np.uint32)
                held.append((c[first], token[first], p[first], count, doc[first], h) if same.any() else (c, token, p, count, doc, h))
                docs, n = docs + len(h), n + len(first)
                if n >= ASKED:
                    yield told()
                    held, n, docs = [], 0, 0
        if held:
            yield told()

    return run


def _packed(c, token, p, count, doc, h) -> bytes:
    """Contexts in order of their texts; a slot's hashes differ in their last seven bytes, and the first one says hardly more than the slot."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    head = np.array([len(c), len(first)], np.int64)
    return b"".join(x.tobytes() for x in (head, h[doc[first]], np.diff(np.append(first, len(c))).astype(np.uint32), c.astype(np.uint32), (c >> np.uint64(32)).astype(np.uint16), (c >> np.uint64(48)).astype(np.uint8), token, p, count))


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    """(h, entries) of the texts, then (hash, token, p, count) of the contexts."""
    n, docs = np.frombuffer(blob, np.int64, 2).tolist()
    out, at = [], 16
    for kind, size in ((np.int64, docs), (np.uint32, docs), (np.uint32, n), (np.uint16, n), (np.uint8, n), (np.uint8, n), (np.float32, n), (np.uint32, n)):
        out.append(np.frombuffer(blob, kind, size, at))
        at += out[-1].nbytes
    h, entries, low, middle, high, *rest = out
    return h, entries, low | middle.astype(np.uint64) << np.uint64(32) | high.astype(np.uint64) << np.uint64(48), *rest


def _begins(key: np.ndarray) -> np.ndarray:
    """Where each value of a sorted key begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))


def _each(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of runs, for every entry of these."""
    return np.repeat(np.add.reduceat(values, first), np.diff(np.append(first, len(values))))


def _several(c: np.ndarray) -> np.ndarray:
    """Entries whose hash others may have: sorted by as much of it as leaves room for the entry's number, which costs less than an order."""
    bits = np.uint64(len(c).bit_length())
    z = np.sort(c << np.uint64(8) >> bits << bits | np.arange(len(c), dtype=np.uint64))
    same = z[1:] >> bits == z[:-1] >> bits
    some = np.zeros(len(c), bool)
    some[1:] = same
    some[:-1] |= same
    return (z[some] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _sums_of(blobs: list[bytes]) -> list[np.ndarray]:
    """Of the texts' contexts in a slot: how many there are, and the sums of their log-probabilities with and without the counts in the
    other texts, in fixed point; and how many contexts others have."""
    h, entries, c, token, p, count = (np.concatenate(x) for x in zip(*map(_unpacked, blobs)))
    doc = np.repeat(np.arange(len(h)), entries)
    n = np.bincount(doc, weights=count, minlength=len(h))
    plain = np.bincount(doc, weights=np.rint(p * np.float64(_PARTS)) * count, minlength=len(h))
    gain = met = np.zeros(len(h))
    if len(c) > 1 and len(order := _several(c)):
        by, at = c[order], doc[order]
        group = np.unique(by, return_inverse=True)[1]
        key = (group * 256 + token[order]) * len(h) + at
        place = np.argsort(key)
        order, group, at, key = order[place], group[place], at[place], key[place]
        often, symbol = count[order].astype(np.int64), key // len(h)
        t, theirs = _each(often, _begins(group)), _each(often, _begins(symbol)) - _each(often, _begins(key))
        # a text's own, whatever the token
        key = group * len(h) + at
        place = np.argsort(key)
        own = np.empty(len(key), np.int64)
        own[place] = _each(often[place], _begins(key[place]))
        t -= own
        known = t > 0
        alone, often, at = p[order[known]].astype(np.float64), often[known], at[known]
        more = np.log((theirs[known] + PRIOR * np.exp(alone)) / (t[known] + PRIOR)) - alone
        gain = np.bincount(at, weights=np.rint(more * _PARTS) * often, minlength=len(h))
        met = np.bincount(at, weights=often, minlength=len(h))
    return [h, *(x.astype(np.int64) for x in (n, plain + gain, plain, met))]


def _added(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sums of texts that are in several parts."""
    h, *values = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h)
    first = _begins(h[order])
    return [h[order[first]], *(np.add.reduceat(x[order], first) if len(first) else x for x in values)]


def _by_slot(batches) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for batch in batches:
        for slot, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out.setdefault(slot, []).append(told)
    return out


def _answer(slots: int):
    """What a slot's contexts give the texts, packed for the slots that the texts' sums are added up in."""

    def run(batches):
        blobs = _by_slot(batches)
        while blobs:
            sums = _added([_sums_of(blobs.popitem()[1])])
            to = (_mix(sums[0].view(np.uint64)) % np.uint64(slots)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(slots + 1))
            sums = [x[order] for x in sums]
            parts = [b"".join(x[a:b].tobytes() for x in sums) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(slots), pa.int32()), pa.array(parts, pa.binary())], ["slot", "told"])

    return run


def _total(batches):
    blobs = _by_slot(batches)
    while blobs:
        found = _added([list(np.frombuffer(x, np.int64).reshape(5, -1)) for x in blobs.popitem()[1]])
        for low in range(0, len(found[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[low : low + (1 << 16)]) for x in found], ["h", "n", "total", "plain", "met"])


def sums(df: DataFrame, model: MaskedModel, cuts: Cuts, text_col: str = "text") -> DataFrame:
    """(h, n, total, plain, met) of all rows with a hash h, added up: tokens, the fixed-point sums of ``_sums_of``, and tokens in contexts that other rows have.

    Contexts are dealt to ``PASSES`` rounds, and there to slots, one task each, so that a round's shuffle is a small part of what
    all contexts take; its files are deleted before the next. No text is shuffled.
    """
    spark, out = df.sparkSession, None
    docs = df.select(row_hash(df).alias("h"), F.col(text_col).alias("text")).where("text is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(2 * spark.sparkContext.defaultParallelism, -(-size // (PASSES * SLOT)))
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        for k in range(PASSES):
            asked = map_batches(docs, _ask(sent, key, k, slots), "slot int, told binary", _OWNER)
            found = map_batches(asked.repartitionById(slots, "slot"), _answer(slots), "slot int, told binary", _OWNER)
            part = cuts.cut(map_batches(found.repartitionById(slots, "slot"), _total, "h long, n long, total long, plain long, met long", _OWNER))
            out = part if out is None else out.unionByName(part)
            del asked, found
            sweep(spark)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return out.groupBy("h").agg(*(F.sum(x).alias(x) for x in ("n", "total", "plain", "met")))


def elsewhere(df: DataFrame, cuts: Cuts, id_col: str, text_col: str, model: MaskedModel | None = None) -> DataFrame | None:
    """The ``sums`` of the rows that share a context with another one; None if there are none. Without a model the network is uniform."""
    found = cuts.cut(sums(df, model or MaskedModel(Alphabet(()), start() * 0), cuts, text_col).where("met > 0"))
    return found if found.limit(1).count() else None


def score(df: DataFrame, model: MaskedModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens``, ``log_prob`` (the sum), ``mean_log_prob`` and ``mean_gain`` (what the mean would lose without the contexts' counts) of every row."""
    cuts, work = Cuts(df.sparkSession), Cuts(df.sparkSession)
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), row_hash(df).alias("h"), F.col(text_col).isNotNull().alias("has"))
    # rows that are the same in all columns have the same sums, which were added up
    times = docs.where("has").groupBy("h").agg(F.count("*").alias("times"))
    found = cuts.cut(sums(df, model, work, text_col).join(times, "h"))
    work.close()
    each = [F.round(F.col(x) / F.col("times") / _PARTS, 4).alias(x) for x in ("total", "plain")]
    found = found.select(F.col("h").alias("h2"), (F.col("n") / F.col("times")).cast("long").alias("n"), *each).hint("merge")
    both = docs.join(found, (F.col("h") == F.col("h2")) & F.col("has"), "left")
    n = F.when(F.col("n") > 0, F.col("n"))
    return both.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_tokens"),
        F.coalesce("total", F.lit(0.0)).alias("log_prob"),
        F.round(F.col("total") / n, 6).alias("mean_log_prob"),
        F.round((F.col("total") - F.col("plain")) / n, 6).alias("mean_gain"),
    )
