from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

from viewtrail.llm import spelling as sp


def one_apart(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts: dict[str, int], times: int = 2) -> set[tuple]:
    near = {w: set() for w in counts}
    for a, b in combinations(counts, 2):
        if one_apart(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def edited(rng, w: str, letters: str) -> str:
    i, c = rng.randrange(len(w) + 1), rng.choice(letters)
    return rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])


def test_variants_against_all_pairs(spark):
    rng, letters = random.Random(11), "abcéÿ𝒳"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(250)}
    for w in list(words):
        for _ in range(4):
            words.add(w := edited(rng, w, letters))
    counts = {w: 3 + int(2 ** rng.uniform(0, 12)) for w in words if len(w) >= 5}
    got = sp.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {tuple(r) for r in got} == brute(counts) and len(got) == len(counts)


def test_every_near_pair_shares_a_key():
    rng = random.Random(3)
    for letters in ("ab", "abcdefg"):
        for _ in range(2000):
            a = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 12)))
            b = edited(rng, a, letters)
            if a == b or len(b) < 5:
                continue
            counts = {x + y: rng.randrange(1, 4) for x in letters for y in letters}  # ties of all kinds
            (own_a, long_a), (own_b, long_b) = sp.word_keys(a, counts), sp.word_keys(b, counts)
            meet = {-1: own_a & long_b, 0: own_a & own_b, 1: long_a & own_b}[len(a) - len(b)]
            assert meet, (a, b)


def test_long_chain_of_forms(spark):
    chain = [("a" * 5 + "b" * k, 3 * 2 ** (12 - k)) for k in range(13)]
    got = {r["word"]: r for r in sp.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert {r["root"] for r in got.values()} == {"aaaaa"} and got["aaaaa"]["form"] is None and got["aaaaab"]["form_n"] == 3 * 2**12


def test_counts_and_slips(spark):
    texts = [(1, "Straße STRASSE, naïve-naïve x9y Ünder×÷"), (1, "Straße STRASSE, naïve-naïve x9y Ünder×÷"), (2, None), (3, ""), (None, "naïve " * 3), (4, "wordy " * 200_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS word")
    plain, slips = Counter(), Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            plain[w] += 1
            h = zlib.crc32(f"{doc}:{w}".encode())
            if doc is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            slips[w] += 1
    assert {r["word"]: r["n"] for r in sp.word_counts(docs).collect()} == plain
    many = spark.range(3000).selectExpr("id AS doc_id", "'wordy other' AS text")
    found = {r["word"]: r["n"] for r in sp.word_counts(many, change=sp.slipped).collect()}
    want = Counter((sp.slipped(i) or str)(w) for i in range(3000) for w in ("wordy", "other"))
    assert found == want and len(found) > 5
    assert {r["word"]: r["n"] for r in sp.word_counts(docs, change=sp.slipped).collect()} == slips


def test_empty_and_lonely(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sp.variants(sp.word_counts(none)).collect() == []
    one = spark.createDataFrame([("abcde", 3), ("vwxyz", 9), ("abcd", 50), ("abcdf", 2)], "word string, n long")
    assert {tuple(r) for r in sp.variants(one).collect()} == {("abcde", None, "abcde", 3, 0, None), ("vwxyz", None, "vwxyz", 9, 0, None)}
