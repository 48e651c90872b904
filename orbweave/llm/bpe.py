"""Byte-level BPE encoding and decoding as a monoid of token sequences.

A text is a product of its bytes, and its encoding a product of the encodings of its parts under ``join``.
The pre-tokenizer's matches never merge with each other, so between them ``join`` is concatenation. Within a
match the two halves are encoded recursively and joined: a window of tokens around the seam is encoded again,
and grows until the pairs of tokens at both its edges are *stable*, i.e. encoding the two tokens' bytes
together gives the two tokens back. A sequence of tokens of which every adjacent pair is stable is the
encoding of its bytes: take the first merge, in the order of BPE, that would cross a token's edge; up to it
each token has evolved alone, so the same merge would come up in the pair's own encoding, which has none.
This needs a vocabulary in which each token's bytes encode to that token, which ``load`` verifies.

Nulls are empty texts, which give no tokens and no bytes. Repeated rows give equal rows. Other columns of the
input are neither read nor returned; the id column may have any type and any values.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from orbweave.llm.common import keep, map_chunks

#: Matches longer than this are encoded anew each time, shorter ones once per worker.
MEMO_CHARS = 48
#: Entries of each of the two generations of a worker's memo, about 70 MB. A full young one becomes the old one, whose
#: entries come back as they are met, so that frequent words stay and rare ones go.
MEMO_ENTRIES = 300_000
#: Entries of its memos of pairs, subtrees and windows each, about 15 MB.
SMALL_ENTRIES = 100_000
#: Halving ends at so many bytes.
LEAF = 2
#: Tokens of a leaf when ids are decoded.
DECODE_LEAF = 256
#: Subtrees over at most so many bytes are encoded once per worker.
SUBTREE = 8


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class TreeBpe:
    """Encoder and decoder for a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = [b""] * (max(ranks.values()) + 1)
        for data, i in ranks.items():
            self.token[i] = data
        self.pairs: dict[tuple[int, int], list[int] | None] = {}
        self.subtrees: dict[bytes, list[int]] = {}
        self.windows: dict[bytes, list[int]] = {}
        self.memo = _Memo(self)

    def window(self, data: bytes) -> list[int]:
        """``merged``, remembered for the short windows that come up at seams again and again."""
        known = self.windows.get(data)
        if known is None:
            known = self.merged(data)
            if len(data) <= 2 * SUBTREE:
                if len(self.windows) >= SMALL_ENTRIES:
                    self.windows.clear()
                self.windows[data] = known
        return known

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a few bytes by its definition: the lowest rank first, the leftmost of equals."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            found = [ranks.get(a + b, 1 << 32) for a, b in zip(parts, parts[1:])]
            best = min(found)
            if best == 1 << 32:
                break
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def seam(self, a: int, b: int) -> list[int] | None:
        """None if the two tokens are stable, i.e. their bytes, encoded together, give the two tokens; else what they give."""
        known = self.pairs.get((a, b), 0)
        if known == 0:
            if len(self.pairs) >= SMALL_ENTRIES:
                self.pairs.clear()
            found = self.merged(self.token[a] + self.token[b])
            known = self.pairs[a, b] = None if found == [a, b] else found
        return known

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two encoded strings' concatenation."""
        if not a or not b:
            return a + b
        window = self.seam(a[-1], b[0])
        if window is None:
            return a + b
        left = right = 1
        while True:
            wider, further = left, right
            if left < len(a) and self.seam(a[-left - 1], window[0]) is not None:
                wider = min(len(a), 2 * left)
            if right < len(b) and self.seam(window[-1], b[right]) is not None:
                further = min(len(b), 2 * right)
            if wider == left and further == right:
                return a[: len(a) - left] + window + b[right:]
            left, right = wider, further
            window = self.window(b"".join([self.token[t] for t in a[len(a) - left :] + b[:right]]))

    def encode_piece(self, data: bytes) -> list[int]:
        """One match of the pattern."""
        if data in self.ranks:
            return [self.ranks[data]]
        return self._tree(data)

    def _tree(self, data: bytes) -> list[int]:
        known = self.subtrees.get(data)
        if known is not None:
            return known
        n = len(data)
        if n <= LEAF:
            out = self.merged(data)
        else:
            half = 1 << (n - 1).bit_length() - 1  # the left half is a full tree, and so often met before
            out = self.join(self._tree(data[:half]), self._tree(data[half:]))
        if n <= SUBTREE:
            if len(self.subtrees) >= SMALL_ENTRIES:
                self.subtrees.clear()
            self.subtrees[data] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        """Concatenation up the tree: runs of tokens are its leaves, and neighbours are joined level by level."""
        tokens = [self.token[t] for t in np.frombuffer(ids, "<u4").tolist()]
        level = [b"".join(tokens[i : i + DECODE_LEAF]) for i in range(0, len(tokens), DECODE_LEAF)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


class _Memo(dict):
    def __init__(self, bpe: TreeBpe):
        super().__init__()
        self.bpe, self.old = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            ids = array("I", self.bpe.encode_piece(piece.encode()))
            if sys.byteorder == "big":
                ids.byteswap()
            out = ids.tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = self.copy()
                self.clear()
            self[piece] = out
        return out


def load(path: str, pattern: str) -> TreeBpe:
    """An encoder for a rank file, kept by a worker; raises ValueError if some token doesn't encode to itself."""
    return keep("bpe", (path, pattern), lambda: _read(path, pattern))


def _read(path: str, pattern: str) -> TreeBpe:
    bpe = TreeBpe(read_ranks(path), pattern)
    for data, rank in bpe.ranks.items():
        if len(data) > 1 and bpe.merged(data) != [rank]:
            raise ValueError(f"token {rank} doesn't encode to itself, so joins can't be proven")
    return bpe


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` (binary, little-endian unsigned 32-bit integers) of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path, pattern)
        ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    return map_chunks(df.select(id_col, text_col), run, f"`{id_col}` {kind}, ids binary", text_col, owner="bpe")


def decode_ids(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ``ids`` and ``decoded`` (binary) of every row; null ids give no bytes."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path, pattern)
        out = [bpe.decode(x or b"") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], [id_col, "ids", "decoded"])

    return map_chunks(df.select(id_col, ids_col), run, f"`{id_col}` {kind}, ids binary, decoded binary", ids_col, owner="bpe")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_texts`` and ``decode_ids`` in one pass, with digests in place of the bytes, so that no tokens travel."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, n, a, b = load(path, pattern), [], [], []
        for text in batch.column(1).to_pylist():
            ids = bpe.encode(text or "")
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_chunks(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", text_col, owner="bpe")
