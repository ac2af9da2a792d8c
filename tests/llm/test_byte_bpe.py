from __future__ import annotations

import array
import hashlib

import pytest

from viewtrail.llm import byte_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", "a" * 2000, "ab" * 900, "日本語テキスト 😀😀 \x1c \x85 x", "'s don't I'LL   \n\n  x", "!!!***???" * 50, "<|endoftext|>", "Un été où\r\n\tl'on n'oublia rien", "0123456789" * 40, "\x00\x01\x02"]


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.ByteBpe.from_file(FILE, public_tokenizers.PATTERN)


def test_equals_the_library(codec):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for text in TEXTS:
        ids = codec.encode(text)
        assert array.array("I", ids).tolist() == library.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


def test_backtracking_equals_merging():
    import random

    ranks = {bytes([i]): i for i in range(256)} | {t: 256 + k for k, t in enumerate([b"ab", b"bc", b"abc", b"cd", b"bcd", b"aa", b"aab", b"dd", b"cdd"])}
    codec = byte_bpe.ByteBpe(ranks, ".+")
    rng = random.Random(4)
    for _ in range(3000):
        data = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 14)))
        want = [ranks[data]] if data in ranks else [ranks[t] for t in codec.merged(data)]
        assert codec.piece(data) == want


def test_defined_cases(spark):
    rows = [(1, None, "x"), (None, "a b", "y"), (2, "a b", "z"), (2, "a b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = byte_bpe.digests(docs, FILE, public_tokenizers.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 4 and {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got if r["doc_id"] == 1} == {(0, empty, empty)}
    assert {r["decoded_sha256"] for r in got if r["doc_id"] != 1} == {hashlib.sha256(b"a b").hexdigest()}
    assert byte_bpe.digests(docs.filter("false"), FILE, public_tokenizers.PATTERN).collect() == []
    kept = byte_bpe.encode_texts(docs, FILE, public_tokenizers.PATTERN).collect()
    assert {bytes(r["decoded"]) for r in kept} == {b"", b"a b"}


def test_common_pieces_stay_in_a_full_memo(codec, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 20)
    codec.memo, codec.older, met, piece = {}, {}, [], codec.piece
    monkeypatch.setattr(codec, "piece", lambda data: met.append(data) or piece(data))
    for k in range(300):
        codec.encode(f" common x{k * 7919:o}".replace("7", "z"))
    assert met.count(b" common") == 1 and len(codec.memo) + len(codec.older) <= 20


def test_long_texts_in_parts(codec, monkeypatch):
    whole = [codec.encode(t) for t in TEXTS]
    monkeypatch.setattr(byte_bpe, "LISTED_CHARS", 8)
    assert [codec.encode(t) for t in TEXTS] == whole
