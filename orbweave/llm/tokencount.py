"""Token counts by byte-pair merging with a heap of adjacent pairs over a doubly linked list of symbols.

The pair of lowest rank is popped again and again, the leftmost of equals; a pop whose symbols have changed
meanwhile is stale and skipped. The count is the number of initial symbols less that of merges; no
identifiers are made. Added tokens (such as ``<|endoftext|>``) inside a text count as one each, as the library
does by default, and split the text before the pattern is matched.

Nulls are empty texts and count 0. Repeated rows give equal rows. Other columns are neither read nor
returned; the id column may have any type and any values.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from orbweave.llm.common import keep, map_chunks

#: The pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_CHARS = 48
MEMO_ENTRIES = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(rest)) for b in range(256)]


class HeapCounter(dict):
    """Counts of pieces, remembered for short ones."""

    def __init__(self, spec: dict):
        super().__init__()
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        before = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or odd or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only plain byte-level BPE files can be counted")
        self.symbol = byte_symbols()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        n = self.merge(piece.encode())
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = n
        return n

    def merge(self, data: bytes) -> int:
        part = [self.symbol[b] for b in data]
        n, rank = len(part), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = a + b, ""
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := rank.get((a + b, part[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, part[k]))
            if (h := before[i]) >= 0 and (r := rank.get((part[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, part[h], a + b))
        return n - merges

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return sum(map(self.__getitem__, self.pattern.findall(text)))
        parts = self.added.split(text)
        return len(parts) - 1 + sum(self[p] for part in parts for p in self.pattern.findall(part))


def load(path: str) -> HeapCounter:
    """A counter for a vocabulary file, kept by a worker."""
    return keep("tokencount", (path,), lambda: _read(path))


def _read(path: str) -> HeapCounter:
    with open(path, encoding="utf-8") as file:
        return HeapCounter(json.load(file))


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id, ``n_bytes`` of UTF-8, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = load(path)
        n = [counter.count(t or "") for t in batch.column(1).to_pylist()]
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return map_chunks(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean", text_col, owner="tokencount")
