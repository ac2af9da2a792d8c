"""Held-out accuracy and defined cases of the two classifiers."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from viewtrail.llm import quality_gam as gam
from viewtrail.llm import toxicity_gru as gru

DATA = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@here
def test_quality_held_out(spark):
    got = gam.query(spark, DATA).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    pairs = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(pairs) > 80 and np.mean([a == b for a, b in pairs]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = np.zeros((4000, len(gam.FEATURES)))
    x[:, :3] = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9 and (0, 1) in model.pairs
    order = rng.permutation(3000)
    assert np.allclose(gam.fit(x[:3000][order], y[:3000][order]).score(x[3000:]), model.score(x[3000:]))


def test_gam_without_labels_is_constant(spark):
    model = gam.fit(np.zeros((0, len(gam.FEATURES))), np.zeros(0))
    docs = spark.createDataFrame([(1, "a", 5), (None, None, 5), (1, "a", 5)], "doc_id long, text string, words int")
    assert {r["quality_score"] for r in gam.classify(docs, model).collect()} == {0.5}
    assert gam.classify(docs.filter("false"), model).collect() == []


def toxic_corpus(count, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    texts, y = [], []
    for k in range(count):
        body = list(rng.choice(words, int(rng.integers(20, 200))))
        y.append(k % 4 == 0)
        if y[-1]:
            for _ in range(3):
                body[int(rng.integers(len(body)))] = f"grax{rng.integers(40)}"
        texts.append(" ".join(body))
    return texts, np.array(y, np.float32)


def test_gru_generalises_by_characters():
    texts, y = toxic_corpus(400, 1)
    net = gru.fit(texts, y, epochs=6)
    later, want = toxic_corpus(200, 2)
    later = [t.replace("grax1", "graxz") for t in later]  # words never seen
    assert ((gru.Scorer(net).texts(later) >= 0.3) == want).mean() > 0.95


def test_gru_gradients():
    texts, y = toxic_corpus(8, 3)
    net = gru.fit(texts, y, epochs=1)
    docs = [gru.words_of(t)[: gru.WINDOW] for t in texts]
    rows = {w: n for n, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
    index, x = gru._index(docs, rows, len(rows)), net.inputs(list(rows))[0].astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    weight = np.ones(8)

    def loss():
        s = np.clip(net.forward(net.projected(x), index), 1e-9, 1 - 1e-9)
        return float(-(y * np.log(s) + (1 - y) * np.log(1 - s)).mean())

    grad, _ = gru._backward(net, x, net.projected(x), index, y, weight)
    for name in ("rec", "in", "att", "out"):
        flat, g = net.p[name].reshape(-1), grad[name].reshape(-1)
        at = int(np.abs(g).argmax())
        old = flat[at]
        flat[at] = old + 1e-2
        up = loss()
        flat[at] = old - 1e-2
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-4, name


def test_windows_cover_all_words_and_long_texts_score_alike():
    for n in (1, 15, 16, 17, 63, 64, 65, 112, 113, 1000):
        covered = set()
        for s in gru.starts(n):
            covered |= set(range(s, min(n, s + gru.WINDOW)))
        assert covered == set(range(n))
    texts, y = toxic_corpus(120, 4)
    net = gru.fit(texts, y, epochs=2)
    long = " ".join(texts[1::4] * 90)
    words = gru.words_of(long)
    want = gru._scored(net, [words[s : s + gru.WINDOW] for s in gru.starts(len(words))]).max()
    assert abs(gru.Scorer(net).texts([None, "", long])[2] - want) < 1e-5
    assert gru.Scorer(net).texts([None, ""]).tolist() == [0, 0]


@here
def test_toxicity_rows(spark):
    from viewtrail.llm._common import table

    docs = table(spark, DATA, "documents").limit(30)
    net = gru.fit(["a b", "c d"], np.array([1, 1], np.float32))
    got = gru.classify(docs, net).collect()
    assert len(got) == 30 and {r["toxicity"] for r in got} == {net.prior}


def test_columns_of_the_results_names_and_defined_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1, 2), (None, None, "y", 3, 4), (1, "a b", "x", 1, 2), (2, "", "z", 5, 6)], "doc_id long, text string, toxicity string, quality_score int, quality_kept int")
    net = gru.fit(["a b", "c d"], np.array([1, 1], np.float32))
    got = gru.classify(docs, net)
    assert got.columns == ["doc_id", "text", "quality_score", "quality_kept", "toxicity"]
    assert sorted((r["doc_id"] or 0, r["toxicity"]) for r in got.collect()) == [(0, 0.0), (1, net.prior), (1, net.prior), (2, 0.0)]
    assert [r["own"] for r in gru.classify(docs, net, "own").filter("doc_id = 1").collect()] == [net.prior] * 2
    assert gru.classify(docs.filter("false"), net).collect() == []
    model = gam.fit(np.zeros((0, len(gam.FEATURES))), np.zeros(0))
    rows = gam.classify(docs, model).collect()
    assert {r["quality_score"] for r in rows} == {0.5} and {r["toxicity"] for r in rows} == {"x", "y", "z"}


def test_the_sample_is_bounded_by_rows(spark):
    from viewtrail.llm._common import TRAIN_CHARS, labelled

    docs = spark.range(2000).selectExpr("id % 2 AS doc_id", "concat('t', id % 900) AS text").unionByName(spark.createDataFrame([(3, None), (3, "x" * (TRAIN_CHARS + 1)), (3, "kept"), (None, "none")], "doc_id long, text string"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    everything = labelled(docs, labels, "toxic", 1000, 999, 10_000).collect()
    assert len(everything) == 901 and {r["text"] for r in everything if r["doc_id"] == 3} == {"kept"}
    assert 30 < labelled(docs, labels, "toxic", 1000, 999, 100).count() < 200
    assert labelled(docs.filter("false"), labels, "toxic", 4, 2, 10).collect() == []
