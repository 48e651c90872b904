"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item gives windows of ``width`` consecutive words, or one window if it is shorter; a window is the set of its
shingles of ``SHINGLE`` words with their places, or is one shingle itself if it is shorter. A document has a window only if it
has all its shingles, so the overlap asked for is the whole set, and the prefix that must be shared is a single shingle:
the rarest by its count in the documents (ties by the shingle's hash). Windows whose rarest shingle is in no document go.

Documents are read twice, whatever the benchmark's size: once for the counts of the benchmark's shingles, once for the
places of prefix shingles, which are joined with the table of prefixes on the shingle's hash. A place and the shingle's offset
in the window say where the window would begin and end (positional and length bound), and the words there are compared with
the window's, word by word. Broadcast Bloom filters of at most 32 MB thin out both passes' rows; what they let through the
joins decide.

Nulls and texts without words have no words, are never hit and hit nothing. Repeated items and documents are items and
documents of their own. Null item ids are left out of the list of items but count as items. Rows of documents are told apart
by their id and a hash of all columns, so rows of one id or of none may be many. Other columns of the documents are not
returned by ``match``; ``clean`` returns the kept rows with all columns unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import Cuts, chunks, map_batches, row_hash, text_bytes
from orbweave.llm.subdedup import Bits, Units, sequence_hashes
from orbweave.plans.cuts import fresh

WIDTH = 13
SHINGLE = 5
#: A document is contaminated from one hit word in so many on.
ONE_IN = 20


def _by_size(units: Units, sizes: tuple[int, ...]):
    """(size, keys, first words, texts) of the shingles of each size within a text."""
    text = np.searchsorted(units.text_start, units.begins, side="right") - 1
    for size in sizes:
        keys = sequence_hashes(units.hashes, size) ^ np.uint64(size)
        at = np.flatnonzero(text[: len(keys)] == text[size - 1 :]) if len(keys) else np.zeros(0, np.int64)
        yield size, keys[at], at, text[at]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def windows(benchmark: DataFrame, cuts: Cuts, item_col: str, text_col: str, width: int) -> DataFrame:
    """(wid, words, items): the distinct windows with the items, as (number, id), that have them."""
    numbered = cuts.cut(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).withColumn("k", F.monotonically_increasing_id()))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                of, every = [], []
                for i, text in enumerate(text_bytes(part.column(1))):
                    words = Units([text]).plain[0].decode().split(" ")
                    size = min(width, len(words)) if words != [""] else 0
                    every += [words[at : at + size] for at in range(len(words) - size + 1)] if size else []
                    of += [i] * (len(every) - len(of))
                at = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(2).take(at), part.column(0).take(at), pa.array(every, pa.list_(pa.string()))], ["k", "item", "words"])

    each = map_batches(numbered, run, "k long, item string, words array<string>")
    return cuts.cut(each.groupBy("words").agg(F.collect_set(F.struct("k", "item")).alias("items")).withColumn("wid", F.monotonically_increasing_id()))


def _shingles(found: DataFrame) -> DataFrame:
    """(wid, at, key) of each window's shingles."""

    def run(batches):
        for batch in batches:
            wid, out = batch.column(0).to_pylist(), ([], [], [])
            for w, words in zip(wid, batch.column(1).to_pylist()):
                size = min(SHINGLE, len(words))
                _, keys, at, _ = next(_by_size(Units([" ".join(words).encode()]), (size,)))
                out[0].extend([w] * len(keys))
                out[1].extend(at.tolist())
                out[2].extend(keys.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], ["wid", "at", "key"])

    return map_batches(found.select("wid", "words"), run, "wid long, at int, key long")


def count_shingles(docs: DataFrame, some: object, sizes: tuple[int, ...]) -> DataFrame:
    """(key, n) of the documents' shingles that pass a filter."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                for _, keys, _, _ in _by_size(Units(text_bytes(part.column(0))), sizes):
                    key, n = np.unique(keys[some.value(keys)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([_long(key), _long(n)], ["key", "n"])

    return map_batches(docs.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def prefixes(docs: DataFrame, found: DataFrame, cuts: Cuts, sizes: tuple[int, ...]) -> DataFrame:
    """(key, at, wid, words): each window that may occur in the documents, by its rarest shingle."""
    each = cuts.cut(_shingles(found))
    some = docs.sparkSession.sparkContext.broadcast(Bits.build(each.select("key").distinct(), "key", each.count()))
    counts = cuts.cut(count_shingles(docs, some, sizes))
    least = each.join(counts, "key", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "at")).alias("s"))
    return cuts.cut(least.where("s.n > 0").select("wid", "s.key", "s.at").join(found.select("wid", "words"), "wid"))


def places(docs: DataFrame, id_type: str, some: object | None, sizes: tuple[int, ...], width: int) -> DataFrame:
    """(id, h, n_words) of every row, with null key; and (id, h, key, begin, around, before) of each place of a shingle that passes the filter: the words around it, and how many come before."""

    def run(batches):
        names = ["id", "h", "n_words", "key", "begin", "around", "before"]
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = text_bytes(part.column(2))
                units, n = Units(texts), len(texts)
                first = np.searchsorted(units.begins, units.text_start)
                whole = [_long(np.diff(first)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *whole], names)
                for size, keys, at, text in _by_size(units, sizes) if some is not None else ():
                    pick = np.flatnonzero(some.value(keys))
                    words = units.plain[0].split(b" ") if len(pick) else []
                    for low in range(0, len(pick), 1 << 14):
                        here = pick[low : low + (1 << 14)]
                        a, t = at[here], text[here]
                        begin, end = np.maximum(first[t], a - width + size), np.minimum(first[t + 1], a + width)
                        around = [[w.decode() for w in words[i:j]] for i, j in zip(begin.tolist(), end.tolist())]
                        own = pa.array(t)
                        yield pa.RecordBatch.from_arrays([
                            part.column(0).take(own), part.column(1).take(own), pa.nulls(len(here), pa.int64()), _long(keys[here]),
                            pa.array((a - first[t]).astype(np.int32)), pa.array(around, pa.list_(pa.string())), pa.array((a - begin).astype(np.int32)),
                        ], names)

    return map_batches(docs, run, f"id {id_type}, h long, n_words long, key long, begin int, around array<string>, before int")


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, width: int, one_in: int, cuts: Cuts) -> DataFrame:
    """id, h and what ``match`` returns of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), row_hash(docs).alias("h"), F.col(text_col).alias("text"))
    found = windows(benchmark, cuts, item_col, item_text_col, width)
    sizes = tuple(sorted({min(SHINGLE, r["n"]) for r in found.select(F.size("words").alias("n")).distinct().collect()}))  # at most SHINGLE numbers
    by_key = prefixes(keyed, found, cuts, sizes) if sizes else None
    n = by_key.select("key").distinct().count() if sizes else 0
    some = docs.sparkSession.sparkContext.broadcast(Bits.build(by_key.select("key").distinct(), "key", n)) if n else None
    seen = cuts.cut(places(keyed, kind, some, sizes, width))
    rows = seen.where("key is null").select("id", "h", "n_words")
    if not n:
        hit = rows.select("id", "h").limit(0).withColumns({"spans": F.array().cast("array<struct<a:int,b:int>>"), "items": F.array().cast("array<struct<k:bigint,item:string>>")})
    else:
        start = F.col("before") - F.col("at")
        met = seen.where("key is not null").join(by_key, "key").where((start >= 0) & (start + F.size("words") <= F.size("around")))
        met = met.where(F.slice("around", start + 1, F.size("words")) == F.col("words"))
        begin = F.col("begin") - F.col("at")
        met = cuts.cut(met.select("id", "h", F.struct(begin.alias("a"), (begin + F.size("words")).alias("b")).alias("span"), "wid").distinct())
        hit = met.join(found.select("wid", "items"), "wid").groupBy("id", "h").agg(F.collect_set("span").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    joined = rows.join(hit.withColumnsRenamed({"id": "id2", "h": "h2"}), F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left").select("id", "h", "n_words", "spans", "items")

    def run(batches):
        for batch in batches:
            spans = [_covered([(s["a"], s["b"]) for s in x or ()]) for x in batch.column(3).to_pylist()]
            items = batch.column(4).to_pylist()
            ids = [sorted(i["item"] for i in x or () if i["item"] is not None) for x in items]
            n_hit = [sum(b - a for a, b in x) for x in spans]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), pa.array(n_hit, pa.int64()), pa.array([len(x or ()) for x in items], pa.int64()), pa.array(ids, pa.list_(pa.string())),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids], pa.string()), pa.array([[e for s in x for e in s] for x in spans], pa.list_(pa.int32())),
                pa.array([k > 0 and one_in * k >= n for k, n in zip(n_hit, batch.column(2).to_pylist())], pa.bool_()),
            ], ["id", "h", "n_words", "n_hit", "n_items", "items", "items_sha256", "spans", "contaminated"])

    return map_batches(joined, run, f"id {kind}, h long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, spans array<int>, contaminated boolean")


def match(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, one_in: int = ONE_IN) -> DataFrame:
    """id, ``n_words``, ``n_hit``, ``n_items``, ``items`` (ids as sorted strings), ``items_sha256``, ``spans`` (flat) and ``contaminated`` of every document."""
    return _found(docs, benchmark, id_col, text_col, item_col, item_text_col, width, one_in, Cuts(docs.sparkSession)).drop("h").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, one_in: int = ONE_IN) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    cuts, work, names = Cuts(docs.sparkSession), Cuts(docs.sparkSession), [fresh(n, docs) for n in ("id", "h")]
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, width, one_in, work)
    gone = cuts.cut(found.where("contaminated").select(F.col("id").alias(names[0]), F.col("h").alias(names[1])).distinct())
    work.close()
    return docs.join(gone, docs[id_col].eqNullSafe(gone[names[0]]) & (row_hash(docs) == gone[names[1]]), "left_anti")
