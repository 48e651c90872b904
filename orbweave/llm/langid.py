"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language is kept as a suffix automaton. A text is parsed greedily, from its first
byte to its last, into the longest phrases that occur in a language's sample; the language that needs the fewest phrases,
normalised as phrases * log2(sample length) / text length, wins. Texts are folded first: lower case, UTF-8 bytes, all
ASCII but letters as one space. A byte that a language's sample hasn't ends a phrase and begins the next.

Automata are transition tables that many blocks of ``BLOCK`` bytes walk abreast. A block is first walked as if a phrase
began with it. Then it is walked again from the state that the block before ended in, until a phrase begins where one
did the first time: from there on both walks are the same, which is mostly after some bytes. Where they don't meet within a
block, the next is walked once more. So the phrases are those of the whole text, wherever blocks are cut.

Bound of the sample: ``ROWS`` whole documents per language, chosen by a hash of their text among those of at most
``MOST_CHARS`` characters (or the shortest ones, where a language has only longer ones), so that repeated documents count
once; with more than ``ALL_ROWS`` / ``ROWS`` languages fewer each.

Nulls and texts without a letter are ``und`` with score 0. A tie goes to the first language by name. Without
any labelled text every text is ``und``. Repeated rows give equal rows. Labels, sources and ids are never
inputs of a prediction. Other columns are neither read nor returned by ``predict``; ``keep_known`` returns the
kept rows with all columns unchanged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.common import keep, learnable, map_chunks

#: Documents that a language's sample is made of, of all languages' together, and their length.
ROWS, ALL_ROWS, MOST_CHARS = 16, 256, 4_000
BLOCK = 256
#: Blocks that walk abreast.
LANES = 1 << 14
#: Hashes are compared on so many levels when documents are chosen.
_LEVELS = 1 << 30
#: A text that parsing makes longer than this many bits a byte in every language, its first phrase not counted, is in none.
MOST_BITS = 8.0
UND = "und"
_FOLD = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_SPACES = re.compile(rb"  +")


def fold(text: str) -> bytes:
    return _SPACES.sub(b" ", text.lower().encode().translate(_FOLD))


def has_letter(text: str, folded: bytes) -> bool:
    if folded.strip(b" ") == b"":
        return False
    return not folded.translate(None, bytes(range(0x80, 0x100))).strip(b" ") == b"" or any(c.isalpha() for c in text)


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    goto: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in data:
        now = len(goto)
        goto.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = now
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if longest[p] + 1 == longest[q]:
                link[now] = q
            else:
                copy = len(goto)
                goto.append(dict(goto[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return goto


@dataclass(frozen=True)
class CrossParser:
    """Samples by language, sorted by its name; small enough to be sent with each task."""

    languages: tuple[str, ...]
    samples: tuple[bytes, ...]

    def parse(self, texts: list[str]) -> tuple[list[str], list[float], np.ndarray, np.ndarray]:
        """Language and score of each text, its bits a byte in the best language, and the same without the first phrase's."""
        folded = [fold(t) for t in texts]
        size = np.array([len(f) for f in folded], np.int64)
        known = np.array([has_letter(t, f) for t, f in zip(texts, folded)], bool)
        if not len(self.languages) or not known.any():
            return [UND] * len(texts), [0.0] * len(texts), np.full(len(texts), np.inf), np.full(len(texts), np.inf)
        classes, tables, width = _tables(self)
        lanes = _Lanes(folded, size, classes)
        phrases = np.stack([lanes.phrases(t) for t in tables], axis=1).astype(float)
        each = np.log2([max(2, len(s)) for s in self.samples])
        bits = phrases * each / np.maximum(size, 1)[:, None]
        best = bits.argmin(axis=1)
        # each phrase more than the best language needs makes a language so many times less likely
        odds = np.exp(-np.minimum(700.0, (bits - bits.min(axis=1, keepdims=True)) * np.maximum(size, 1)[:, None] / 16))
        score = 1 / odds.sum(axis=1)
        lang = [self.languages[b] if k else UND for b, k in zip(best, known)]
        least, later = bits.min(axis=1), ((phrases - 1) * each / np.maximum(size, 1)[:, None]).min(axis=1)
        return lang, np.where(known, score, 0.0).tolist(), np.where(known, least, np.inf), np.where(known, later, np.inf)


def _tables(parser: CrossParser) -> tuple[np.ndarray, list[np.ndarray], int]:
    """The tables of a parser, kept by a worker."""
    return keep("langid", (parser,), lambda: _made(parser))


def _made(parser: CrossParser) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Byte classes and, per language, the flat table of (state, class) to the next state's row; negative, by its complement, where a phrase ends before this byte."""
    found = sorted(set(b"".join(parser.samples)))
    classes = np.ones(256, np.uint8)
    classes[found] = np.arange(2, len(found) + 2)
    width = len(found) + 2  # class 0 pads, class 1 is a byte that no sample has
    tables = []
    for sample in parser.samples:
        goto = suffix_automaton(sample)
        root = np.full(width, -1, np.int32)
        for c, t in goto[0].items():
            root[classes[c]] = ~(t * width)
        table = np.tile(root, (len(goto), 1))
        table[:, 0] = np.arange(len(goto)) * width
        state, column, to = [], [], []
        for s, edges in enumerate(goto):
            state += [s] * len(edges)
            column += edges
            to += edges.values()
        table[state, classes[column]] = np.array(to, np.int32) * width
        tables.append(table.ravel())
    return classes, tables, width


class _Lanes:
    """Texts cut into blocks, a row of byte classes each."""

    def __init__(self, folded: list[bytes], size: np.ndarray, classes: np.ndarray):
        blocks = -(-size // BLOCK)
        self.total = int(blocks.sum())
        self.first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
        self.full = np.flatnonzero(blocks)
        self.texts = len(size)
        flat = np.zeros(self.total * BLOCK, np.uint8)
        for f, a in zip(folded, self.first * BLOCK):
            flat[a : a + len(f)] = classes[np.frombuffer(f, np.uint8)]
        self.rows = flat.reshape(self.total, BLOCK)
        #: Blocks that go on in the next one.
        self.goes_on = np.ones(self.total, bool)
        self.goes_on[np.append(self.first[self.full][1:], self.total) - 1] = False

    def phrases(self, table: np.ndarray) -> np.ndarray:
        """Phrases of each text by the table of one language."""
        begins = np.zeros((self.total, BLOCK), bool)
        ended = np.zeros(self.total, np.int32)
        for low in range(0, self.total, LANES):
            columns = np.ascontiguousarray(self.rows[low : low + LANES].T)
            state, at = np.zeros(columns.shape[1], np.int32), np.empty(columns.shape, bool)
            for j, column in enumerate(columns):
                state += column
                state = table.take(state, mode="clip")
                sign = state >> 31
                at[j] = sign
                state ^= sign
            begins[low : low + LANES], ended[low : low + LANES] = at.T, state
        count = begins.sum(axis=1, dtype=np.int64)
        after = np.flatnonzero(self.goes_on) + 1
        begins[after, 0] = True
        again = after
        while len(again):
            again = self._again(table, again, begins, ended, count)
        out = np.zeros(self.texts, np.int64)
        if self.total:
            out[self.full] = 1 + np.add.reduceat(count, self.first[self.full])
        return out

    def _again(self, table: np.ndarray, blocks: np.ndarray, begins: np.ndarray, ended: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Walks blocks from where those before them ended; sets their counts, and returns the blocks after those that end otherwise than before."""
        state, here, so_far = ended[blocks - 1], blocks, np.zeros(len(blocks), np.int64)
        for j in range(BLOCK):
            state = table.take(state + self.rows[here, j])
            new = state < 0
            state = np.where(new, ~state, state)
            so_far += new
            met = new & begins[here, j]
            if met.any():
                at = here[met]
                count[at] = so_far[met] + begins[at, j + 1 :].sum(axis=1)
                go = ~met
                state, here, so_far = state[go], here[go], so_far[go]
                if not len(here):
                    break
        other = ended[here] != state
        count[here], ended[here] = so_far, state
        begins[here] = False  # what they are compared with is no walk of theirs any more, but for the last state
        return here[other & self.goes_on[here]] + 1


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", everything: bool = False, rows_each: int = ROWS) -> CrossParser:
    """Learns from text and label of the rows that aren't held out (of all with ``everything``)."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    if not everything:
        rows = rows.where(learnable(F.col(id_col)))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), F.length(text_col).alias("n"))
    short = F.col("n") <= MOST_CHARS
    counts = rows.groupBy("lang").agg(F.count(F.when(short, 1)).alias("n"), F.min("n").alias("least")).collect()
    limit = {r["lang"]: MOST_CHARS if r["n"] else r["least"] for r in counts}
    number = {r["lang"]: max(1, r["n"]) for r in counts}
    each, got, want = max(1, min(rows_each, ALL_ROWS // max(1, len(counts)))), {}, 4
    while len(got) < len(limit):
        left = [k for k in limit if k not in got]
        share = {k: min(_LEVELS, max(1, want * each * _LEVELS // number[k])) if limit[k] == MOST_CHARS else _LEVELS for k in left}
        table = lambda d: F.create_map(*[x for k in left for x in (F.lit(k), F.lit(d[k]))])[F.col("lang")]
        chosen = rows.withColumn("h", F.xxhash64("t")).where((F.col("n") <= F.coalesce(table(limit), F.lit(-1))) & (F.pmod("h", F.lit(_LEVELS)) < F.coalesce(table(share), F.lit(0))))
        # each task hands on a language's least hashes only
        ranked = chosen.groupBy("lang", "h").agg(F.first("t").alias("t")).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each)
        found: dict[str, list[tuple[int, str]]] = {}
        for r in ranked.collect():
            found.setdefault(r["lang"], []).append((r["h"], r["t"]))
        for k in left:
            if len(found.get(k, [])) == each or share[k] == _LEVELS:
                got[k] = b" ".join(fold(t) for _, t in sorted(found.get(k, [])))
        want *= 8
    names = tuple(sorted(k for k, v in got.items() if v.strip()))
    return CrossParser(names, tuple(got[k] for k in names))


def predict(df: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``lang_pred``, ``score`` (0 to 1: the winner's share when a phrase is worth as much as log2 of the sample's length over 16) and ``bits`` a byte."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, bits, _ = parser.parse([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits)], [id_col, "lang_pred", "score", "bits"])

    return map_chunks(df.select(id_col, text_col), run, f"`{id_col}` {kind}, lang_pred string, score double, bits double", text_col, owner="langid")


def keep_known(df: DataFrame, parser: CrossParser, text_col: str = "text", most_bits: float = MOST_BITS) -> DataFrame:
    """The rows whose text is in one of the languages: those with a letter that the best language doesn't make longer than ``most_bits`` a byte.

    The default is what the bytes themselves take: a language that can't code a text in less says nothing about it. The first
    phrase isn't counted, as a text of some letters has no more.
    """
    at = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        *_, later = parser.parse([t or "" for t in batch.column(at).to_pylist()])
        return batch.filter(pa.array(later <= most_bits))

    return map_chunks(df, run, df.schema, text_col, owner="langid")
