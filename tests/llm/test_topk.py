from __future__ import annotations

import math
import random

from viewtrail.llm import topk_search as m

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, k):
    ok = [(i, [max(-(2**63), min(2**63 - 1, math.floor(1024 * x))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in ok if i % 100 == 0}:
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return out


def test_against_brute_force_with_ties_and_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(6)], "x") for i in range(400)]
    rows += [(1000 + i, [0.25] * 6, "x") for i in range(50)] + [(500, None, "x"), (None, [1.0] * 6, "x"), (600, [float("nan")] * 6, "x"), (700, [1.0, None], "x"), (800, [], "x"), (900, [1.0, 2.0], "x"), (901, [3.0, 4.0], "x")]
    rows += [(7, rows[7][1], "x"), (100, [1.0, -0.5, 0.25, 0.0, 0.25, 1.0], "x"), (100, [0.0, 0.25, 1.0, 1.0, -0.5, 0.0], "x"), (200, rows[200][1], "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for block in (m.BLOCK_BYTES, 200):
        got = sorted(tuple(r) for r in m.top_k(df.filter("vec_id % 100 = 0"), df, block_bytes=block).collect())
        assert got == sorted(brute(rows, 10))
        assert sum(r[0] == 100 for r in got) == 30  # three vectors of one id


def test_large_components_stay_exact(spark):
    rows = [(100, [3e7, -2e7, 1.0], ""), (1, [4e7, 1e7, 3.0], ""), (2, [4e7, 1e7, 2.0], ""), (3, [1e30, 0.0, 0.0], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in m.top_k(df.filter("vec_id = 100"), df).collect()) == sorted(brute(rows, 10))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert m.top_k(df, df).collect() == []
