"""Substring deduplication: repeated passages are cut out of all documents but the first that has them.

*Paragraphs* (lines) of at least ``SHINGLE`` words match nearly: MinHash signatures over shingles of five words are cut into
bands, as many as ``bands`` works out for the wanted recall at the wanted similarity; paragraphs that collide in a band are
compared by exact Jaccard similarity, and links make components. In every document but the first of a component (or of
equal paragraphs) its paragraphs are marked, and runs of marked lines, blank lines between them included, are cut if they
have ``least_words`` words or more.

What this leaves is searched for every stretch of ``WINDOW`` words that several documents still share, wherever it begins
and however its sentences and lines are cut. Of each ``WINDOW`` words the least hash of ``ANCHOR`` words in a row is an
anchor, so equal stretches have equal anchors; where an anchor is in several documents, all windows around it are
compared, and those that an earlier document has are cut, word by word.

Words are runs of ASCII letters and digits, in lower case, and of bytes past ASCII. Nothing is cut on a 64-bit hash:
paragraphs and windows are equal if the 128-bit XXH3 digests of their words are. Smaller hashes only choose what is
compared; they mix after every step, so that no family of texts collides in them.

A band's paragraphs are first compared with the band's representative, each pair once whatever bands it is from. Only
where that leaves a band in several components are the smaller ones compared with all of the band, in blocks of ``BLOCK``;
so a large group of near copies costs a comparison a member, no group meets in one task, and no link is lost.

The first document is the one with the least id; null ids come last and keep all that only they have. Rows with equal ids
are one document: none of them is cut for another. Repeats within a document stay. Null texts stay null, empty ones
empty. Rows are joined by their id and a hash of all columns, so neither many rows of one id nor of none meet in one task.
Other columns are returned unchanged, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import Cuts, chunks, map_batches, map_chunks, row_hash, text_bytes
from orbweave.llm.components import components
from orbweave.llm.simhash import _Forest
from orbweave.plans.cuts import fresh

SHINGLE = 5
SIMILARITY = 0.8
#: Share of the pairs at SIMILARITY that the bands have to bring together, and the most hashes that may be spent on it.
RECALL, HASHES = 0.998, 64
#: Marked lines are cut from so many words in a row on.
RUN_WORDS = 25
#: Words of a stretch that no two documents keep, and of the anchors in it.
WINDOW, ANCHOR = 50, 25
BLOCK = 512
#: A prefilter has at most so many bits (32 MB); with more keys it lets more through, and the join after it decides.
MOST_BITS = 1 << 28
#: Bytes of text that are looked at once; words, digests and signatures take up to a hundred times as much in a worker.
SLICE_BYTES = 1 << 20
#: Words longer than this many bytes have their rest hashed one by one.
LONG_WORD = 256

_FOLD = np.array([b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint8)
_BY_SIZE, _BY_BLOCK, _BY_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_ROW = np.random.default_rng(20).integers(1, 1 << 63, 4 * HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = HASHES) -> tuple[int, int]:
    """(bands, rows): as many rows a band as ``most`` hashes allow, with the bands that find a pair of the similarity with the wanted probability."""
    best = None
    for rows in range(1, most + 1):
        n = 1 if similarity >= 1 else int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if n * rows > most:
            break
        best = n, rows
    return best or (most, 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sequence_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """Of each ``size`` words in a row, by doubling: two halves are mixed into one, which overlap at the last step."""
    if len(word) < size:
        return np.zeros(0, np.uint64)
    h, have = word, 1
    while have < size:
        step = min(have, size - have)
        h = _mix(h[: len(h) - step] * _BY_STEP + h[step:])
        have += step
    return h


class Units:
    """Words and lines of many texts at once. Texts are joined by newlines, so each ends with one of its own."""

    def __init__(self, texts: list[bytes]):
        self.data = data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.folded = _FOLD[data]
        word = self.folded != 32
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
        #: Begins and ends of the words.
        self.begins, self.ends = edge[::2], edge[1::2]
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(size)))
        #: Begins of the lines, and the end of all.
        self.line = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
        #: The first word of each line, and the number of all words.
        self.first = np.searchsorted(self.begins, self.line)
        self.line_text = np.searchsorted(self.text_start, self.line[:-1], side="right") - 1

    @cached_property
    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        size = self.ends - self.begins
        h = _mix(size.astype(np.uint64) * _BY_SIZE)
        padded = np.concatenate((self.folded, np.zeros(8, np.uint8)))
        eights = np.lib.stride_tricks.as_strided(padded, (len(self.folded) + 1, 8), (1, 1))
        active, place = np.arange(len(size)), 0
        while len(active) and place < LONG_WORD:
            block = np.ascontiguousarray(eights[self.begins[active] + place]).view("<u8").ravel()
            left = size[active] - place
            part = left < 8
            block[part] &= (np.uint64(1) << (np.uint64(8) * left[part].astype(np.uint64))) - np.uint64(1)
            h[active] = _mix((h[active] ^ block) * _BY_BLOCK)
            place += 8
            active = active[left > 8]
        for i in active.tolist():
            rest = self.folded[self.begins[i] + LONG_WORD : self.ends[i]].tobytes()
            h[i] = xxhash.xxh3_64_intdigest(rest, int(h[i]))
        return h

    @cached_property
    def plain(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each begins and ends there."""
        words = self.folded.tobytes().split()
        size = self.ends - self.begins
        end = np.cumsum(size + 1) - 1
        return b" ".join(words), end - size, end

    def digests(self, low: np.ndarray, high: np.ndarray) -> list[bytes]:
        """128 bits of the words from ``low`` to before ``high``."""
        plain, begin, end = self.plain
        digest = xxhash.xxh3_128_digest
        return [digest(plain[a:b]) for a, b in zip(begin[low].tolist(), end[high - 1].tolist())]

    def paragraphs(self, least: int = SHINGLE) -> np.ndarray:
        """Numbers of the lines of so many words or more."""
        return np.flatnonzero(np.diff(self.first) >= least)

    def shingles(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of the given lines, one line after another, and where each line's begin."""
        every = sequence_hashes(self.hashes, SHINGLE)
        low = self.first[lines]
        n = self.first[lines + 1] - low - SHINGLE + 1
        start = np.concatenate(([0], np.cumsum(n)))
        return every[np.arange(start[-1]) + np.repeat(low - start[:-1], n)], start


class Bits:
    """A Bloom filter over hashes; made of the whole column, checked by the array."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    @staticmethod
    def places(h: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
        step = (h >> np.uint64(33)) | np.uint64(1)
        return [(h + np.uint64(i) * step) & mask for i in range(4)]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self.places(h, self.mask):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out

    @classmethod
    def build(cls, df: DataFrame, column: str, n: int) -> Bits:
        bits = min(MOST_BITS, max(1 << 12, 1 << int(12 * max(1, n)).bit_length()))
        mask = np.uint64(bits - 1)

        def run(batches):
            for batch in batches:
                h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                if len(h):
                    p = np.unique(np.concatenate(cls.places(h, mask)))
                    at, first = np.unique(p >> np.uint64(6), return_index=True)
                    word = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first)
                    yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(word.view(np.int64))], ["at", "word"])

        got = map_batches(df.select(column), run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        words = np.zeros(bits >> 6, np.uint64)
        words[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
        return cls(words)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text) of the rows with a text; h tells rows of one id apart by all their columns, repeated rows excepted."""
    return df.select(F.col(id_col).alias("id"), row_hash(df).alias("h"), F.col(text_col).alias("text")).where("text is not null")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """(key, first): the least id of what several documents have."""
    found = rows.groupBy(key).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("unnamed"))
    return found.select(key, "first", ((F.col("first") != F.col("last")) | F.col("first").isNotNull() & F.col("unnamed")).alias("shared"))


def _of_each(rows: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
    """(id, h, name): the keys of each row that an earlier document has."""
    gone = rows.join(known.select(key, "first"), key).where(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
    return gone.groupBy("id", "h").agg(F.collect_set(key).alias(name))


def paragraph_rows(docs: DataFrame, id_type: str) -> DataFrame:
    """(d, id, h): the digests of each row's paragraphs, each once."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", SLICE_BYTES):
                units = Units(text_bytes(part.column(2)))
                lines = units.paragraphs()
                found = units.digests(units.first[lines], units.first[lines + 1])
                each = sorted(set(zip(units.line_text[lines].tolist(), found)))
                at = pa.array([t for t, _ in each], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([d for _, d in each], pa.binary()), part.column(0).take(at), part.column(1).take(at)], ["d", "id", "h"])

    return map_batches(docs, run, f"d binary, id {id_type}, h long")


def signatures(shingles: np.ndarray, start: np.ndarray, shape: tuple[int, int]) -> list[np.ndarray]:
    """A key for each band, of each of the sets of shingles that begin at ``start``."""
    out = []
    for b in range(shape[0]):
        key = np.full(len(start) - 1, b + 1, np.uint64)
        for row in _ROW[b * shape[1] : (b + 1) * shape[1]]:
            key = _mix(key * _BY_STEP + np.minimum.reduceat(_mix(shingles * row), start[:-1]))
        out.append(key)
    return out


def _bands(docs: DataFrame, shape: tuple[int, int], only: object | None = None) -> DataFrame:
    """(k, node) for each paragraph and band, equal paragraphs of a batch once; with ``only``, of the bands that pass it, and also (null, node, shingles) of these paragraphs."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", SLICE_BYTES):
                units = Units(text_bytes(part.column(2)))
                lines = units.paragraphs()
                distinct = dict(zip(units.digests(units.first[lines], units.first[lines + 1]), lines.tolist()))
                if not distinct:
                    continue
                node = np.array([xxhash.xxh64_intdigest(d, 42) for d in distinct], np.uint64)  # as xxhash64 in SQL
                shingles, start = units.shingles(np.array(list(distinct.values()), np.int64))
                keys = signatures(shingles, start, shape)
                if only is None:
                    for k in keys:
                        yield pa.RecordBatch.from_arrays([_long(k), _long(node)], ["k", "node"])
                    continue
                some = np.zeros(len(node), bool)
                for k in keys:
                    pick = only.value(k)
                    some |= pick
                    yield pa.RecordBatch.from_arrays([_long(k[pick]), _long(node[pick]), pa.nulls(int(pick.sum()), pa.binary())], ["k", "node", "shingles"])
                which = np.flatnonzero(some)
                sets = [np.unique(shingles[start[i] : start[i + 1]]).tobytes() for i in which.tolist()]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(which), pa.int64()), _long(node[which]), pa.array(sets, pa.binary())], ["k", "node", "shingles"])

    return map_batches(docs, run, "k long, node long" + ("" if only is None else ", shingles binary"))


def similar_pairs(sets: list[np.ndarray], other: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs with an exact Jaccard similarity of ``least`` or more; each array has distinct values."""
    size, size2 = np.array([len(s) for s in sets]), np.array([len(s) for s in other])
    if not size.sum() or not size2.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values, code = np.unique(np.concatenate([*sets, *other]), return_inverse=True)
    owner = np.repeat(np.arange(len(size) + len(size2)), np.concatenate((size, size2)))
    common = np.zeros((len(size), len(size2)), np.float32)
    for at in range(0, len(values), 4096):
        here = (code >= at) & (code < at + 4096)
        hot = np.zeros((len(size) + len(size2), min(4096, len(values) - at)), np.float32)
        hot[owner[here], code[here] - at] = 1
        common += hot[: len(size)] @ hot[len(size) :].T
    joined = size[:, None] + size2[None, :] - common
    return np.nonzero(common >= least * joined - 1e-6)


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets have a Jaccard similarity of ``least`` or more; their sizes alone may rule it out."""
    small, large = sorted((len(x), len(y)))
    if small < least * large - 1e-6:
        return False
    joined = len(np.unique(np.concatenate((x, y))))
    return small + large - joined >= least * joined - 1e-6


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yes = [similar(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), least) for s, t in zip(x, y)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

    own = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return map_batches(pairs.join(own, "a").join(other, "b").select("a", "b", "x", "y"), run, "a long, b long")


def links(members: DataFrame, sets: DataFrame, cuts: Cuts, least: float) -> DataFrame:
    """Edges (a, b) that connect what is similar among the members (k, node) of each band. ``sets`` has each node's shingles."""
    tops = cuts.cut(members.groupBy("k").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1"))
    pairs = members.join(tops, "k").where("node != b").select(F.col("node").alias("a"), "b").distinct()
    stars = cuts.cut(_checked(cuts.cut(pairs), sets, least))
    roots = components(stars, cuts)
    # bands that are still in several components: all but the largest are compared with the whole band
    named = cuts.cut(members.join(tops.select("k"), "k", "left_semi").join(roots, "node", "left").select("k", "node", F.coalesce("root", "node").alias("part")))
    sizes = named.groupBy("k", "part").agg(F.count("*").alias("size"))
    open_bands = cuts.cut(sizes.groupBy("k").agg(F.count("*").alias("parts"), F.sum("size").alias("n"), F.max("size").alias("largest")).where("parts > 1"))
    if not open_bands.limit(1).count():
        return stars
    largest = sizes.join(open_bands, "k").where("size = largest").groupBy("k").agg(F.min("part").alias("main"))
    open_bands = cuts.cut(open_bands.join(largest, "k").select("k", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("largest")) / BLOCK).cast("int").alias("others")))
    rows = cuts.cut(named.join(open_bands, "k").join(sets, "node").withColumn("place", F.xxhash64("node", F.lit(1))))
    # block i of all meets block j of those outside the main component in task (i, j)
    one = rows.select("k", F.pmod("place", "blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("j"), F.lit(False).alias("other"), "node", "part", "shingles")
    two = rows.where("part != main").select("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("others")).cast("int").alias("j"), F.lit(True).alias("other"), "node", "part", "shingles")

    def verify(batches):
        """Group after group of sorted rows; a group has two blocks' rows at most."""
        held, rows, found = None, [], ([], [])
        for batch in batches:
            k, i, j, other, node, part = (batch.column(x).to_pylist() for x in range(6))
            for key, row in zip(zip(k, i, j), zip(other, node, part, batch.column(6).to_pylist())):
                if key != held:
                    _compared(rows, least, found)
                    held, rows = key, []
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])
            found = ([], [])
        _compared(rows, least, found)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    dealt = one.unionByName(two).repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return stars.unionByName(map_batches(dealt, verify, "a long, b long"))


def _compared(rows: list[tuple[bool, int, int, bytes]], least: float, out: tuple[list[int], list[int]]) -> None:
    """Adds a spanning forest, beside the known parts, of the links between the rows of two blocks."""
    left, right = [r for r in rows if not r[0]], [r for r in rows if r[0]]
    if not left or not right:
        return
    a, b = similar_pairs([np.frombuffer(r[3], np.uint64) for r in left], [np.frombuffer(r[3], np.uint64) for r in right], least)
    known: dict[int, int] = {}
    part = np.array([known.setdefault(r[2], len(known)) for r in (*left, *right)], np.int64)
    up = list(range(len(known)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    apart = part[a] != part[len(left) + b]
    for x, y in zip(a[apart].tolist(), b[apart].tolist()):
        p, q = root(int(part[x])), root(int(part[len(left) + y]))
        if p != q:
            up[p] = q
            out[0].append(left[x][1])
            out[1].append(right[y][1])


def paragraph_roots(docs: DataFrame, cuts: Cuts, least: float, recall: float) -> DataFrame | None:
    """(node, root): paragraphs, by the hash of their digest, with the least of their component; None if no band has two paragraphs."""
    spark, shape = docs.sparkSession, bands(least, recall)
    keys = cuts.cut(_bands(docs, shape).groupBy("k").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("k"))
    n = keys.count()
    if not n:
        return None
    found = cuts.cut(_bands(docs, shape, spark.sparkContext.broadcast(Bits.build(keys, "k", n))))
    members = cuts.cut(found.where("k is not null").select("k", "node").join(keys, "k", "left_semi").distinct())
    sets = cuts.cut(found.where("k is null").select("node", "shingles").dropDuplicates(["node"]))
    roots = components(cuts.cut(links(members, sets, cuts, least)), cuts)
    for table in (keys, found, members, sets):
        cuts.drop(table)
    return cuts.cut(roots.union(roots.select("root", "root")).distinct())


def repeated(df: DataFrame, cuts: Cuts, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(id, h, lines): the digests of each row's paragraphs that an earlier document has, or has near copies of."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = _keyed(df, id_col, text_col)
    roots = paragraph_roots(docs, cuts, least, recall)
    rows = cuts.cut(paragraph_rows(docs, kind))
    known = _shared(rows, "d")
    if roots is None:
        return _of_each(rows, cuts.cut(known.where("shared")), "d", "lines")
    known = cuts.cut(known.withColumn("node", F.xxhash64("d")).join(roots, "node", "left").where("shared or root is not null"))
    # a node of several digests is none; its paragraphs match exactly
    clear = known.where("root is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("root").alias("root"), F.min("first").alias("first")).where("n = 1")
    clear = cuts.cut(clear.select("node", "root", "first"))
    earliest = cuts.cut(clear.groupBy("root").agg(F.min("first").alias("least")))
    least_of = cuts.cut(clear.join(earliest, "root").select("node", "least"))
    known = cuts.cut(known.join(least_of, "node", "left").select("d", F.coalesce("least", "first").alias("first")))
    return _of_each(rows, known, "d", "lines")


def line_spans(texts: list[bytes], gone: list[set[bytes]], least_words: int = RUN_WORDS) -> list[list[tuple[int, int]]]:
    """Stretches of bytes of each text that go: runs of lines with the given digests, of ``least_words`` words or more. Blank lines don't end a run."""
    units = Units(texts)
    words = np.diff(units.first)
    lines = units.paragraphs()
    marked = np.zeros(len(words), bool)
    marked[lines] = [d in gone[t] for t, d in zip(units.line_text[lines].tolist(), units.digests(units.first[lines], units.first[lines + 1]))]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    telling = np.flatnonzero(marked | (words > 0))
    on = marked[telling]
    new = np.ones(len(telling), bool)
    new[1:] = (on[1:] != on[:-1]) | (units.line_text[telling][1:] != units.line_text[telling][:-1])
    begin = np.flatnonzero(new)
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(telling)]):
        if on[a] and words[telling[a:b]].sum() >= least_words:
            t = int(units.line_text[telling[a]])
            base, stop = int(units.text_start[t]), int(units.text_start[t + 1]) - 1
            out[t].append((int(units.line[telling[a]]) - base, min(int(units.line[telling[b - 1] + 1]), stop) - base))
    return out


def _windows(units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all windows within a text, the words that they begin with, and their texts."""
    text = np.searchsorted(units.text_start, units.begins, side="right") - 1
    if len(text) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, have, want = sequence_hashes(units.hashes, ANCHOR), 1, WINDOW - ANCHOR + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    at = np.flatnonzero(text[: len(least)] == text[WINDOW - 1 :])
    return least[at], at, text[at]


def shared_windows(df: DataFrame, cuts: Cuts, id_col: str, text_col: str) -> DataFrame | None:
    """(id, h, windows): digests of the windows of each row that an earlier document has; None if no anchor is shared."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    docs = _keyed(df, id_col, text_col)

    def anchors(batches):
        for batch in batches:
            for part in chunks(batch, "text", SLICE_BYTES):
                anchor, _, text = _windows(Units(text_bytes(part.column(2))))
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])  # neighbours mostly share theirs
                yield pa.RecordBatch.from_arrays([_long(anchor[new]), part.column(0).take(pa.array(text[new]))], ["a", "id"])

    keys = cuts.cut(_shared(map_batches(docs, anchors, f"a long, id {kind}"), "a").where("shared").select("a"))
    n = keys.count()
    if not n:
        return None
    some = spark.sparkContext.broadcast(Bits.build(keys, "a", n))

    def around(batches):
        for batch in batches:
            for part in chunks(batch, "text", SLICE_BYTES):
                units = Units(text_bytes(part.column(2)))
                anchor, at, text = _windows(units)
                keep = some.value(anchor)
                low, text = at[keep], text[keep]
                each = sorted(set(zip(text.tolist(), units.digests(low, low + WINDOW)))) if len(low) else []
                for begin in range(0, len(each), 1 << 16):
                    some_of = each[begin : begin + (1 << 16)]
                    owner = pa.array([t for t, _ in some_of], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([d for _, d in some_of], pa.binary()), part.column(0).take(owner), part.column(1).take(owner)], ["d", "id", "h"])

    rows = cuts.cut(map_batches(docs, around, f"d binary, id {kind}, h long"))
    return _of_each(rows, cuts.cut(_shared(rows, "d").where("shared")), "d", "windows")


def window_spans(texts: list[bytes], gone: list[set[bytes]]) -> list[list[tuple[int, int]]]:
    """Stretches of bytes of each text that its windows with the given digests make up. A stretch goes up to the next word, or to the line's end."""
    units = Units(texts)
    _, at, text = _windows(units)
    digests = units.digests(at, at + WINDOW) if len(at) else []
    newline = units.line[1:] - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, t, d in zip(at.tolist(), text.tolist(), digests):
        if d in gone[t]:
            if spans[t] and a <= spans[t][-1][1]:
                spans[t][-1] = (spans[t][-1][0], a + WINDOW)
            else:
                spans[t].append((a, a + WINDOW))
    out = []
    for t, found in enumerate(spans):
        base, begins = int(units.text_start[t]), units.begins
        ends = [int(min(newline[np.searchsorted(newline, begins[b - 1])], begins[b] if b < len(begins) else len(units.data))) for _, b in found]
        out.append([(int(begins[a]) - base, e - base) for (a, _), e in zip(found, ends)])
    return out


def _joined(old: list[int], new: list[tuple[int, int]]) -> list[int]:
    """Begins and ends in the first text of what ``old`` cut out of it and ``new`` then cut out of the rest."""
    spans, shift, k = [], 0, 0
    cut = list(zip(old[::2], old[1::2]))
    for a, b in new:
        while k < len(cut) and cut[k][0] - shift <= a:
            spans.append(cut[k])
            shift += cut[k][1] - cut[k][0]
            k += 1
        start = a + shift
        while k < len(cut) and cut[k][0] - shift <= b:
            shift += cut[k][1] - cut[k][0]
            k += 1
        spans.append((start, b + shift))
    out: list[int] = []
    for a, b in [*spans, *cut[k:]]:
        if out and a <= out[-1]:
            out[-1] = max(b, out[-1])
        else:
            out += [a, b]
    return out


def _without(df: DataFrame, gone: DataFrame, column: str, find, id_col: str, text_col: str, spans_col: str) -> DataFrame:
    """``df`` without what ``find(texts, digests of each)`` gives as spans; ``gone`` has the digests of the rows that lose something."""
    at, names = df.columns.index(text_col), df.columns
    where, key = names.index(spans_col), [fresh(n, df) for n in ("id", "h", column)]
    other = gone.select(F.col("id").alias(key[0]), F.col("h").alias(key[1]), F.col(column).alias(key[2]))
    # texts are dealt by their keys at every size, so that the plan is the same for all
    joined = df.join(other.hint("merge"), df[id_col].eqNullSafe(other[key[0]]) & (row_hash(df) == other[key[1]]), "left").select(*(df[f"`{c}`"] for c in names), key[2])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lost = batch.column(len(names)).to_pylist()
        rows = [i for i, x in enumerate(lost) if x]
        columns = list(batch.columns[: len(names)])
        if rows:
            texts, spans = columns[at].to_pylist(), columns[where].to_pylist()
            data = [texts[i].encode() for i in rows]
            for i, old, cut in zip(rows, data, find(data, [set(lost[i]) for i in rows])):
                edges = [0, *(x for s in cut for x in s), len(old)]
                texts[i] = b"".join(old[a:b] for a, b in zip(edges[::2], edges[1::2])).decode(errors="ignore")
                spans[i] = _joined(spans[i], cut)
            columns[at], columns[where] = pa.array(texts, columns[at].type), pa.array(spans, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(columns, names)

    return map_chunks(joined, run, df.schema, text_col, SLICE_BYTES)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, recall: float = RECALL, least_words: int = RUN_WORDS) -> DataFrame:
    """``df`` with the passages cut out of the texts, and with ``cut_spans``: begins and ends, in turn, of what was cut, in bytes of the old text."""
    cuts, work = Cuts(df.sparkSession), Cuts(df.sparkSession)
    whole = df.withColumn("cut_spans", F.array().cast("array<int>"))
    gone = cuts.cut(repeated(whole, work, id_col, text_col, least, recall))
    work.close()
    left = cuts.cut(_without(whole, gone, "lines", lambda texts, lost: line_spans(texts, lost, least_words), id_col, text_col, "cut_spans"))
    cuts.drop(gone)
    gone = shared_windows(left, work, id_col, text_col)
    gone = None if gone is None else cuts.cut(gone)
    work.close()
    return left if gone is None else _without(left, gone, "windows", window_spans, id_col, text_col, "cut_spans")
