from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from viewtrail.llm import periodic_runs as pr


def brute(words, least: int = 12) -> list[tuple[int, int, int]]:
    """Every maximal stretch of every period, the smallest period of each."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            start = i
            while i < n - p and words[i] == words[i + p]:
                i += 1
            if i - start >= max(p, least - p):
                out.setdefault((start, i - start + p), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in out.items())


def made(rng, most: int = 160) -> list[bytes]:
    n, letters = rng.randrange(most), rng.choice([1, 2, 2, 3, 5, 50])
    words = [b"%d" % rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(3) if n > 4 else 0):
        start, p = rng.randrange(n), rng.randrange(1, 25)
        for i in range(start + p, min(n, start + rng.randrange(1, 90))):
            words[i] = words[i - p]
    return words


def test_runs_against_brute_force(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(pr, "TOGETHER", 500)
    for _ in range(150):
        texts = [made(rng) for _ in range(rng.randrange(10))]
        assert pr.runs_of_texts(texts) == [brute(t) for t in texts]


def test_bounds_of_a_run():
    a, b = np.zeros(12, np.int64), np.zeros(11, np.int64)
    assert pr.find_runs(a) == [(0, 12, 1)] and pr.find_runs(b) == [] == pr.find_runs(a[:0])
    assert pr.find_runs(np.tile(np.arange(6), 2)) == [(0, 12, 6)] and pr.find_runs(np.tile(np.arange(7), 2)[:13]) == []
    assert pr.find_runs(np.tile(np.arange(100), 2)) == [(0, 200, 100)]
    with pytest.raises(ValueError):
        pr.find_runs(a, 11)


def test_long_texts_take_no_square():
    assert pr.find_runs(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]
    assert len(pr.find_runs(np.repeat(np.arange(20_000), 12))) == 20_000


def test_repeated_tail_by_definition():
    import zlib

    words = [b"%d" % i for i in range(50)]
    for doc in range(60):
        h = zlib.crc32(str(doc).encode())
        want = list(words)
        if h % 10 == 0:
            g = h // 10
            a = g % 50
            p = 1 + (50 - a) // (3 + g % 8)
            want = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert pr.repeated_tail(doc, words) == want
    assert pr.repeated_tail(None, words) == words and pr.repeated_tail(10, []) == []


def test_defined_cases(spark):
    run = "a b " * 6
    rows = [(1, None, 1), (2, "", 1), (3, " \t\n", 1), (4, f"x {run}y", 1), (4, f"x {run}y", 1), (None, run, 1), (5, "é " * 30_000 + "\u00a0 end", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in pr.detect(docs).collect()), key=lambda r: r[:2])
    assert got == [(0, 12, [(0, 12, 2)], "a b"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 14, [(1, 12, 2)], "x a b y"), (4, 14, [(1, 12, 2)], "x a b y"), (5, 30_002, [(0, 30_000, 1)], "é \u00a0 end")]
    rows = {r["doc_id"]: r for r in pr.digests(pr.detect(docs)).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert rows[1]["runs_sha256"] == sha(b"") == rows[1]["collapsed_sha256"] and rows[1]["n_runs"] == 0 and rows[1]["start"] is rows[1]["length"] is rows[1]["period"] is rows[1]["exponent_milli"] is None
    assert tuple(rows[4])[1:6] == (1, 1, 12, 2, 6000) and rows[4]["runs_sha256"] == sha(b"1,12,2\n") and rows[4]["collapsed_sha256"] == sha(b"x a b y")
    assert pr.digests(pr.detect(docs.filter("false"))).collect() == []


def test_longest_run_is_the_first_of_ties(spark):
    text = "a " * 12 + "- " + "b " * 12 + "- " + "c d " * 6
    (row,) = pr.digests(pr.detect(spark.createDataFrame([(3, text)], "doc_id long, text string"))).collect()
    assert tuple(row)[1:6] == (3, 0, 12, 1, 12000)
