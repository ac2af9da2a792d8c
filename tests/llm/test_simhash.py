from __future__ import annotations

import numpy as np
import pytest

from viewtrail.llm import simhash
from viewtrail.llm._components import components


def brute(fps: dict[int, int], radius: int) -> dict[int, int]:
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(rng, base: int, bits: int) -> int:
    for b in rng.choice(64, bits, replace=False):
        base ^= 1 << int(b)
    return base


def test_fingerprint_by_definition():
    import xxhash

    text = "One two THREE four\x0bfive  ñÑ"
    words = ["one", "two", "three", "four", "five", "ñÑ"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 4)
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("a b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_shard_links_against_brute_force(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    rng = np.random.default_rng(3)
    bases = [int(x) for x in rng.integers(0, 2**63, 60)]
    fps = sorted({near(rng, b, int(rng.integers(0, 4))) for b in bases for _ in range(12)})
    points, everyone = np.array(fps, np.uint64), np.arange(len(fps))
    i, j = simhash.shard_links(points, everyone, everyone, 3, rng)
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(i.tolist(), j.tolist()):
        assert (fps[a] ^ fps[b]).bit_count() <= 3
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {a: find(a) for a in everyone.tolist()} == brute(dict(enumerate(fps)), 3)


@pytest.mark.parametrize("chunk", [400_000, 20])
def test_links_over_shards_and_chunks(spark, chunk):
    rng = np.random.default_rng(5)
    bases = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = sorted({near(rng, b, int(rng.integers(0, 4))) for b in bases for _ in range(8)})
    signed = {int(np.uint64(f).view(np.int64)): f for f in fps}
    df = spark.createDataFrame([(k,) for k in signed], "fp long")
    found = components(simhash.links(df, 3, shard_rows=40, chunk_rows=chunk))
    got = {r["node"]: r["root"] for r in found.collect()}
    want = brute(dict(signed.items()), 3)
    assert {k: got.get(k, k) for k in signed} == want


def test_defined_cases(spark):
    rows = [(3, "a b c d", "x"), (1, "A b C d", "y"), (2, None, None), (5, "", "z"), (None, "a b c d", "q"), (4, "other words entirely here", "x"), (4, "other words entirely here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    by_id = {r[1]: r for r in got}
    assert len(got) == 7 and by_id[3][3] == by_id[1][3] == 1 and by_id[0][3] == 1
    assert by_id[2][2] == "0" * 16 and by_id[2][3] == by_id[5][3] == 2
    assert by_id[4][3] == 4
    assert simhash.near_duplicates(docs.filter("false")).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 1000 for i in range(1000, 1100)}
