"""Near-duplicate documents: SimHash fingerprints, linked within a Hamming radius by vantage-point trees.

The distinct fingerprints are partitioned by a tree of vantage points fitted to a bounded sample: each inner
node holds a point and a distance, and sends what is nearer to one side. A fingerprint lives in one leaf
(shard) and is a query in every leaf that the triangle inequality doesn't rule out, so each pair within the
radius meets in the leaf of its smaller member. In a shard the same tree goes on in memory, many queries at
a time, down to small blocks that are compared outright. Shards return a spanning forest of their links,
never all pairs of a group; equal fingerprints are one node from the start.

A null or empty text, or one of white space alone, has the fingerprint zero, linked like any other. Repeated
rows and equal ids are rows of their own with equal results. Null ids are allowed and never name a component
unless all its ids are null. An empty table gives no rows. Other columns are neither read nor returned, but
for ``keep_first``, which returns all columns unchanged.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import Cuts, map_batches, map_chunks, release, row_hash, text_bytes
from orbweave.llm.components import components
from orbweave.plans.cuts import fresh

LOWER = bytes(range(256)).lower()
SEED = 42
SHINGLE = 3
RADIUS = 3
#: Distinct fingerprints that a shard should hold.
SHARD = 32_768
#: Sampled fingerprints per shard that the tree's points and distances are fitted to, fewer if they would be more than SAMPLE
#: in all; with so many shards that they had less than LEAST_SAMPLE each, shards grow instead.
SAMPLE_PER_SHARD, SAMPLE, LEAST_SAMPLE = 128, 1 << 20, 16
#: A block of at most so many residents isn't split further.
BLOCK = 128
#: Comparisons made at once.
AT_ONCE = 1 << 21
_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, width: int = SHINGLE) -> array:
    """XXH64 of each run of ``width`` words, repeats included; of the whole sequence if it is shorter."""
    words = text.translate(LOWER).split()
    if not words:
        return array("Q")
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return array("Q", [digest(line, SEED)])
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-width])]
    return array("Q", [digest(line[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])])


def fingerprints_of(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprints. Bits are counted in byte lanes of 64-bit sums over at most 255 hashes each."""
    parts = [shingle_hashes(t, width) for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    hashes = np.frombuffer(b"".join(parts[i].tobytes() for i in full), np.uint64)
    size = n[full]
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    runs = -(-size // 255)
    first = np.concatenate(([0], np.cumsum(runs)[:-1]))
    starts = np.repeat(begin, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    counts = np.empty((len(starts), 8, 8), np.uint8)  # run, byte of the hash, bit of the byte
    for k in range(8):
        counts[:, :, k] = np.add.reduceat((hashes >> np.uint64(k)) & _ONES, starts).view(np.uint8).reshape(-1, 8)
    totals = np.add.reduceat(counts.reshape(-1, 64).astype(np.int64), first, axis=0)
    out[full] = np.packbits(2 * totals > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """The columns of ``df`` but the text, and ``fp``, the fingerprint as a signed long."""
    others = [c for c in df.columns if c != text_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprints_of(text_bytes(batch.column(len(others))), width).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(fp)], [*others, "fp"])

    return map_chunks(df.select(*others, text_col), run, df.select(*others).schema.add("fp", "long"), text_col)


@dataclass
class VantageTree:
    """The upper part of a tree: node i has its sides at 2i+1 (distance at most ``cut``) and 2i+2; leaves come after the inner nodes."""

    point: np.ndarray
    cut: np.ndarray
    depth: int

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int) -> VantageTree:
        inner = (1 << depth) - 1
        point, cut = np.zeros(inner, np.uint64), np.zeros(inner, np.int64)
        parts = {0: np.unique(sample)}
        for i in range(inner):
            part = parts.pop(i)
            if len(part):
                point[i] = part[(i * 7919) % len(part)]
                d = np.bitwise_count(part ^ point[i]).astype(np.int64)
                cut[i] = int(np.median(d))
                parts[2 * i + 1], parts[2 * i + 2] = part[d <= cut[i]], part[d > cut[i]]
            else:
                parts[2 * i + 1] = parts[2 * i + 2] = part
        return cls(point, cut, depth)

    def visits(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, index into fps, whether the leaf is its home) for all leaves that a ball of the radius may touch."""
        node, index, home = np.zeros(len(fps), np.int64), np.arange(len(fps)), np.ones(len(fps), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(fps[index] ^ self.point[node]).astype(np.int64)
            cut = self.cut[node]
            near, far = d - radius <= cut, d + radius > cut
            node = np.concatenate((2 * node[near] + 1, 2 * node[far] + 2))
            home = np.concatenate((home[near] & (d[near] <= cut[near]), home[far] & (d[far] > cut[far])))
            index = np.concatenate((index[near], index[far]))
        return node - ((1 << self.depth) - 1), index, home


class _Forest:
    """Union-find over 0..n-1 that takes pairs by the array."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def link_shard(residents: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (fingerprint, root), of the pairs (resident, query) within the radius."""
    nodes = np.unique(np.concatenate((residents, queries)))
    forest = _Forest(len(nodes))
    stack = [(np.searchsorted(nodes, np.unique(residents)), np.searchsorted(nodes, np.unique(queries)))]
    while stack:
        r, q = stack.pop()
        if not len(r) or not len(q):
            continue
        if len(r) > BLOCK:
            v = nodes[r[7919 % len(r)]]
            dr, dq = np.bitwise_count(nodes[r] ^ v).astype(np.int64), np.bitwise_count(nodes[q] ^ v).astype(np.int64)
            cut = int(np.median(dr))
            if (dr > cut).any():
                stack.append((r[dr <= cut], q[dq - radius <= cut]))
                stack.append((r[dr > cut], q[dq + radius > cut]))
                continue
            if (dr < cut).any():
                stack.append((r[dr < cut], q[dq - radius < cut]))
                stack.append((r[dr == cut], q[dq + radius >= cut]))
                continue
        step = max(1, AT_ONCE // len(r))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            i, j = np.nonzero(np.bitwise_count(nodes[r][:, None] ^ nodes[part][None, :]) <= radius)
            i, j = r[i], part[j]
            other = i != j
            forest.add(i[other], j[other])
    moved = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[moved], nodes[forest.root[moved]]


def link(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect what is linked, from ``n`` distinct fingerprints in the column ``fp``."""
    depth = min(int(np.log2(SAMPLE // LEAST_SAMPLE)), max(0, int(np.ceil(np.log2(max(1, n / SHARD))))))
    want = min(SAMPLE_PER_SHARD << depth, SAMPLE)
    share = min(1.0, 2 * want / max(1, n))
    # a fingerprint's own hash decides, and only distinct ones are here, so the sample's size is near 2 * want
    chosen = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("fp") if depth else distinct.select("fp").limit(0)
    sample = np.array([r[0] for r in chosen.collect()], np.int64).view(np.uint64)
    tree = VantageTree.fit(sample, depth)

    def send(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 1 << 14):
                part = fps[at : at + (1 << 14)]
                leaf, index, home = tree.visits(part, radius)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(part[index].view(np.int64)), pa.array(home)], ["leaf", "fp", "home"])

    def shard(table: pa.Table) -> pa.Table:
        fps, home = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy()
        a, b = link_shard(fps[home], fps, radius)
        release()
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    sent = map_batches(distinct.select("fp"), send, "leaf int, fp long, home boolean")
    return sent.groupBy("leaf").applyInArrow(shard, "a long, b long")


def _rooted(rows: DataFrame, cuts: Cuts, least: tuple, radius: int) -> DataFrame:
    """(fp, root, *least): each fingerprint of ``rows`` with its component and what ``least`` aggregates of its rows."""
    distinct = cuts.cut(rows.groupBy("fp").agg(*least) if least else rows.select("fp").distinct())
    roots = components(cuts.cut(link(distinct, distinct.count(), radius)), cuts)
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    return cuts.cut(known.select("fp", F.coalesce("root", "fp").alias("root"), *(c for c in distinct.columns if c != "fp")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """id, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` (the least id of the row's component) of every row."""
    cuts = Cuts(df.sparkSession)
    rows = cuts.cut(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", width))
    work = Cuts(df.sparkSession)
    known = _rooted(rows, work, (F.min("id").alias("first"),), radius)
    least = work.cut(known.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cuts.cut(known.join(least, "root").select("fp", "component_id"))
    work.close()
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component, the one with the least id, null ids last; of rows of one id the one with the least hash of its columns.

    Rows are told apart by their id and a hash of all columns, so rows of one id that aren't near copies all stay. Winners are
    chosen among narrow rows, and texts are only joined with the keys of what goes; of repeated rows, equal in all columns, one
    is picked out by a step of its own, which there is only if some are to stay.
    """
    cuts, work = Cuts(df.sparkSession), Cuts(df.sparkSession)
    keyed = df.select(F.col(id_col).alias("id"), row_hash(df).alias("h"), F.col(text_col).alias("text"))
    rows = work.cut(fingerprints(keyed, "text", width))
    known = _rooted(rows, work, (), radius)
    placed = work.cut(rows.groupBy("fp", "id", "h").agg(F.count("*").alias("n")).join(known, "fp").select("root", "id", "h", "n"))
    best = work.cut(placed.groupBy("root").agg(F.min("id").alias("best")))
    tied = work.cut(placed.join(best, "root").where(F.col("id").eqNullSafe(F.col("best"))).groupBy("root").agg(F.min("h").alias("top")))
    judged = placed.join(best, "root").join(tied, "root").withColumn("stays", F.col("id").eqNullSafe(F.col("best")) & (F.col("h") == F.col("top")))
    judged = cuts.cut(judged.where("not stays or n > 1").select("id", "h", "stays"))
    work.close()
    names = [fresh(n, df) for n in ("id", "h")]
    named = lambda part: part.select(*(F.col(c).alias(n) for c, n in zip(("id", "h"), names)))
    match = lambda part: df[id_col].eqNullSafe(part[names[0]]) & (row_hash(df) == part[names[1]])
    gone = named(judged)
    kept = df.join(gone, match(gone), "left_anti")
    if not judged.where("stays").limit(1).count():
        return kept
    again, key = named(judged.where("stays")), fresh("key", df)
    return kept.unionByName(df.join(again, match(again), "left_semi").withColumn(key, row_hash(df)).dropDuplicates([id_col, key]).select(*df.columns))
