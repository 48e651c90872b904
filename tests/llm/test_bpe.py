import base64
import functools
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orbweave.llm import bpe, tokencount
from tests.llm.helpers import docs_frame, odd_rows

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return Tokenizer.from_file(JSON)


def ids(text):
    return np.frombuffer(bpe.load(RANKS, PATTERN).encode(text), "<u4").tolist()


def odd_texts():
    rng = random.Random(3)
    out = ["a" * 4_000, "ab" * 1_500, "é" * 500, " " * 300 + "x", "日本語" * 100, "zzzz!!!!????", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|><|endoftext|>\n\n x", "it's we'll I'd"]
    out += ["".join(rng.choice("abcdefgh") for _ in range(800)), "".join(chr(rng.randrange(32, 0x3000)) for _ in range(800)), "".join(rng.choice("aA1 \n\t.") for _ in range(800))]
    return out + [r[1] or "" for r in odd_rows()]


def test_encoding_equals_the_library(library):
    for text in odd_texts():
        assert ids(text) == library.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    coder = bpe.load(RANKS, PATTERN)
    assert coder.decode(coder.encode(text)) == text.encode()
    assert ids(text) == tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={}).encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=40))
def test_join_is_the_encoding_of_the_concatenation(a, b):
    coder = bpe.load(RANKS, PATTERN)
    assert coder.join(coder.merged(a), coder.merged(b)) == coder.merged(a + b)


def test_memo_keeps_results_when_it_turns_over(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    monkeypatch.setattr(bpe, "SMALL_ENTRIES", 2)
    coder = bpe.TreeBpe(bpe.read_ranks(RANKS), PATTERN)
    text = "one two three four five one two three four five six seven eight nine ten unbelievable"
    assert coder.encode(text) == bpe.load(RANKS, PATTERN).encode(text)


def test_a_vocabulary_that_cannot_be_joined_is_refused(tmp_path):
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256}
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
    with pytest.raises(ValueError):
        bpe.load(str(path), PATTERN)


def test_operators_on_odd_rows(spark, library):
    df = docs_frame(spark)
    got = sorted(bpe.round_trip(df, RANKS, PATTERN).collect(), key=str)
    want = []
    for row in odd_rows():
        e = library.encode_ordinary(row[1] or "")
        want.append((row[0], len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(got[0].__class__) and f"Row(doc_id={r[0]}, n_tokens={r[1]}, ids_sha256='{r[2]}', decoded_sha256='{r[3]}')")
    two = bpe.decode_ids(bpe.encode_texts(df, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(bytes(r["decoded"]) for r in two.collect()) == sorted((r[1] or "").encode() for r in odd_rows())
    assert bpe.round_trip(docs_frame(spark, []), RANKS, PATTERN).count() == 0


def test_counts_equal_the_library(counter):
    own = tokencount.load(JSON)
    for text in odd_texts():
        assert own.count(text) == len(counter.encode(text, add_special_tokens=False).ids)


@functools.cache
def json_library():
    return Tokenizer.from_file(JSON)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_counts_of_any_text(text):
    assert tokencount.load(JSON).count(text) == len(json_library().encode(text, add_special_tokens=False).ids)


def test_decoding_of_any_number_of_tokens(library):
    coder = bpe.load(RANKS, PATTERN)
    for n in (0, 1, 255, 256, 257, 511, 513, 1_300):
        text = " the" * n
        ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert coder.decode(ids) == text.encode() and len(ids) == 4 * n


def test_count_operator_on_odd_rows(spark, counter):
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.count_tokens(docs_frame(spark), JSON).collect()}
    want = set()
    for row in odd_rows():
        n = len(counter.encode(row[1] or "", add_special_tokens=False).ids)
        want.add((row[0], len((row[1] or "").encode()), n, n > 512))
    assert got == want
    assert tokencount.count_tokens(docs_frame(spark, []), JSON).count() == 0
