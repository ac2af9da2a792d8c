"""The fitted models' vectorised scores against plain loops over their parameters."""

from __future__ import annotations

import math
import random
from pathlib import Path

import numpy as np
import pytest

from viewtrail.llm import quality_gam as gam
from viewtrail.llm import secret_scan, toxicity_gru as gru

DATA = "/root/testdata/sf0.01"


def test_gam_is_the_sum_of_its_table_cells():
    rng = np.random.default_rng(2)
    x = rng.random((1500, len(gam.FEATURES))).round(2)  # many values on a bin's edge
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y, rounds=30)
    assert model.pairs
    for row, got in zip(x[:200], model.score(x[:200]), strict=True):
        z, places = model.intercept, []
        for value, edges, cells in zip(row, model.edges, model.tables, strict=True):
            place = sum(1 for e in edges if e <= value)
            places.append(place)
            z += cells[place]
        for (f, g), grid in zip(model.pairs, model.grids, strict=True):
            z += grid[model.coarse[f][places[f]]][model.coarse[g][places[g]]]
        assert abs(1 / (1 + math.exp(-z)) - got) < 1e-12


def network(net: gru.Net, words: list[str]) -> float:
    """One window's score, a unit and a step at a time."""
    p, H = net.p, gru.HIDDEN
    sig = lambda v: 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))
    inputs = []
    for w in words:
        grams = gru.trigrams(w)
        chars = [sum(float(p["char"][t][k]) for t in grams) / len(grams) for k in range(gru.CHAR_DIM)]
        inputs.append([float(v) for v in p["word"][net.words.get(w, 0)]] + chars)
    states = []
    for d in (0, 1):
        h, out = [0.0] * H, {}
        for t in range(len(words)) if d == 0 else reversed(range(len(words))):
            g = [sum(x * float(p["in"][d][e][k]) for e, x in enumerate(inputs[t])) + float(p["in_bias"][d][k]) for k in range(3 * H)]
            a = [sum(h[e] * float(p["rec"][d][e][k]) for e in range(H)) for k in range(3 * H)]
            z, r = [sig(g[k] + a[k]) for k in range(H)], [sig(g[H + k] + a[H + k]) for k in range(H)]
            c = [math.tanh(g[2 * H + k] + r[k] * a[2 * H + k]) for k in range(H)]
            h = [(1 - z[k]) * c[k] + z[k] * h[k] for k in range(H)]
            out[t] = h
        states.append([out[t] for t in range(len(words))])
    both = [f + b for f, b in zip(*states, strict=True)]
    e = [sum(float(u) * v for u, v in zip(p["att"], s, strict=True)) for s in both]
    w = [math.exp(v - max(e)) for v in e]
    pooled = [sum(w[t] * both[t][k] for t in range(len(words))) / sum(w) for k in range(2 * H)]
    return sig(sum(v * float(o) for v, o in zip(pooled, p["out"], strict=True)) + float(p["out_bias"][0]))


def test_gru_is_the_highest_of_all_overlapping_windows():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)] + ["grax", "grix", "é" * 30]
    texts = [" ".join(rng.choices(vocabulary[:60] if i % 2 else vocabulary, k=30)) for i in range(80)]
    net = gru.fit(texts, np.array([float("gr" in t) for t in texts], np.float32), epochs=3)
    tried = [" ".join(rng.choices(vocabulary + ["unseen", "Grax!"], k=n)) for n in (1, 2, 63, 64, 65, 111, 112, 113, 200)]
    for text, got in zip(tried, gru.Scorer(net).texts(tried), strict=True):
        words = text.lower().split()
        windows = [words[s : s + 64] for s in range(0, max(1, len(words) - 16), 48)]
        assert sum(map(len, windows)) >= len(words)
        assert abs(max(network(net, w) for w in windows) - got) < 2e-4


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_toxicity_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = gru.query(spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count() and all(0 <= r["score"] <= 1 for r in got)
    pairs = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(pairs) > 60 and np.mean([a == b for a, b in pairs]) >= 0.9


def test_forest_expression_walks_its_trees(spark):
    from pyspark.sql import functions as F

    forest = secret_scan.train(secret_scan.example_findings(spark, 1500))
    x = secret_scan.features(*map(F.col, ("candidate", "before", "after", "path")))
    rows = secret_scan.example_findings(spark, 2000).select(F.array(*(v.cast("double") for v in x.values())).alias("x"))
    got = rows.select("x", secret_scan.score(forest, [F.col("x")[k] for k in range(len(x))]).alias("score")).collect()

    def walk(node, values) -> float:
        while isinstance(node, tuple):
            f, threshold, left, right = node
            node = left if values[f] <= threshold else right
        return float(node)

    assert len(got) == 2000 and len({round(r["score"], 6) for r in got}) > 20
    for r in got:
        assert abs(sum(walk(t, r["x"]) for t in forest) / len(forest) - r["score"]) < 1e-9
