from __future__ import annotations

import numpy as np
import pytest

from viewtrail.operators import clusters as k
from viewtrail.operators import taxonomy as q

LABELS = [("music", "jazz", 100, (1, 0.05, 0)), ("entertainment", "jazz", 20, (1, 0, 0.05)), ("sports", "chess", 50, (0, 1, 0.05)), ("sports", "schach", 30, (0.05, 1, 0)), ("entertainment", "ajedrez", 10, (0, 1, 0)), ("science", "arduino", 40, (0, 0.05, 1))]
V, W = np.array([x[3] for x in LABELS], float), np.array([x[2] for x in LABELS], float)


def labels(videos=9, channels=None):
    return k.Labels([x[0] for x in LABELS], [x[1] for x in LABELS], W.astype(int), np.full(len(LABELS), videos), V, channels)


def topics(ls, c):
    return {ls.topics[r] for r in c.rows}


def slow(vectors, weights, threshold):
    """Centroid linkage step by step: the merged centroid is the unit mean of both by their weights."""
    groups = [([i], np.array(v, float), max(w, 1)) for i, (v, w) in enumerate(zip(vectors, weights, strict=True))]
    cos = lambda x, y: float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))
    while len(groups) > 1:
        d, i, j = min((1 - cos(groups[i][1], groups[j][1]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if d > threshold:
            break
        (gi, ci, wi), (gj, cj, wj) = groups[i], groups.pop(j)
        mean = wi * ci + wj * cj
        groups[i] = (gi + gj, mean / np.linalg.norm(mean), wi + wj)
    out = np.zeros(len(vectors), int)
    for n, (g, _, _) in enumerate(groups):
        out[g] = n
    return out


def same(a, b):
    return len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))


def test_three_families():
    got = k.agglomerate(V, W, 0.3)
    assert same(got, np.array([0, 0, 1, 1, 1, 2]))
    assert [c.views for c in k.subjects(labels(), 0.3)] == [120, 90, 40]
    assert [c.name for c in k.subjects(labels(), 0.3)] == ["jazz", "chess", "arduino"]


def test_threshold_edge():
    two = np.array([[1.0, 0], [1, 1]])
    edge = 1 - 1 / np.sqrt(2)
    assert len(set(k.agglomerate(two, np.ones(2), edge + 0.01))) == 1 and len(set(k.agglomerate(two, np.ones(2), edge - 0.01))) == 2


def test_agglomerate_against_the_definition(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(k, "BLOCK", 64)
    for n in (0, 1, 2, 12, 30, 60):
        for _ in range(6):
            v, w = rng.normal(size=(n, 5)), rng.integers(1, 9, n).astype(float)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            for threshold in (0.2, 0.6, 0.9):
                assert same(k.agglomerate(v, w, threshold), slow(v, w, threshold))


def test_ties_and_vectors_without_length():
    v = np.array([[1.0, 0], [1, 0], [0, 1], [0, 1], [0, 0]])
    assert same(k.agglomerate(v, np.ones(5), 0.5), np.array([0, 0, 1, 1, 2]))


def test_folding():
    ls = k.Labels([x[0] for x in LABELS], [x[1] for x in LABELS], W.astype(int), np.array([9, 9, 9, 9, 9, 1]), V)
    found = k.subjects(ls, 0.3)
    assert len(k.fold_small(ls, found, 5)) == 2 and len(k.fold_small(ls, found, 5, keep=["arduino"])) == 3
    assert len(k.fold_small(labels(1), k.subjects(labels(1), 0.3), 50)) == 3  # none is big


def test_split_and_merge_of_equal_names():
    ls = labels()
    whole = k.cluster(ls, range(6), "all", "top")
    pieces = k.split(ls, whole, 0.3)
    assert [p.views for p in pieces] == [120, 90, 40] and all(p.name == "" and p.parent == "top" for p in pieces)
    assert k.split(ls, pieces[0], 0.3) == [pieces[0]]
    named = [k.replace(p, name="one") for p in pieces]
    back = k.merge_same_names(ls, named)
    assert len(back) == 1 and back[0].views == 250 and len(k.merge_same_names(ls, pieces)) == 3


def test_top_groups_fold_small_ones():
    ls = labels(9)
    found = k.subjects(ls, 0.3)
    assert k.top_groups(found, 0.3, 1) == [[0], [1], [2]]
    assert sorted(map(len, k.top_groups(found, 0.3, 18))) == [1, 2] and k.top_groups(found, 0.3, 18, ["arduino"]) == [[0], [1], [2]]
    assert k.top_groups(found, 0.3, 1000) == [[0], [1], [2]]


def test_control_wishes():
    ls = labels()
    found = k.subjects(ls, 0.3)
    made = k.pinned(ls, found, "science/arduino", "boards")
    assert [c.name for c in made] == ["jazz", "chess", "boards"]
    moved = k.pinned(ls, found, "sports/schach", "jazz")
    assert "sports/schach" in topics(ls, moved[0]) and topics(ls, moved[1]) == {"sports/chess", "entertainment/ajedrez"}
    assert k.pinned(ls, found, "sports/chess", "chess") == found and k.pinned(ls, found, "no/where", "x") == found
    joined = k.merged_by_name(ls, found, ["arduino", "jazz", "nothing"])
    assert [c.name for c in joined] == ["chess", "arduino"] and joined[1].views == 160
    assert k.merged_by_name(ls, found, ["nothing", "jazz"]) == found


def test_refine_splits_once_and_merges_close_ones():
    ls = labels()
    wide = [k.cluster(ls, range(6), "all")]
    out, torn = k.refine(ls, wide, k.Control(), set(), 0.4, 0.1, 1)
    assert torn == ["all"] and [c.views for c in out] == [120, 90, 40]
    assert k.refine(ls, wide, k.Control(), {"all"}, 0.4, 0.1, 1) == (wide, [])
    assert len(k.refine(ls, wide, k.Control(split=["all"]), {"all"}, 0.4, 0.9, 1)[0]) == 3
    apart = [k.cluster(ls, [r], f"n{r}") for r in range(6)]
    assert [c.views for c in k.refine(ls, apart, k.Control(), set(), 0.4, 0.9, 1)[0]] == [120, 90, 40]


def test_rounds_end_when_metrics_stay():
    ls = labels(channels=[["a"], ["a", "b"], ["c"], ["c"], ["d"], ["a"]])
    found, measured = k.rounds(ls, fine=0.4, coarse=0.5, least=1, least_top=1)
    assert len(measured) == 2 and measured[0] == measured[1]
    assert measured[0].subjects == 3 and measured[0].channel_most == 2 and measured[0].tail == 0
    assert abs(measured[0].coherence - sum(c.views * c.radius for c in found) / 250) < 1e-12
    assert len(k.rounds(ls, lambda: k.Control(stop=True), 0.4, 0.5, 1, 1)[1]) == 1
    # the namer gives all pieces one name: they merge again, and no name is split twice
    _, again = k.rounds(ls, fine=0.4, coarse=0.5, least=1, least_top=1, most_radius=0.0, namer=lambda *_: "same")
    assert len(again) <= 10 and again[-1].subjects == 1
    assert k.rounds(k.Labels([], [], np.zeros(0, int), np.zeros(0, int), np.zeros((0, 3)))) == ([], [])


def test_parents_are_named_by_every_cluster():
    ls = labels()
    found = k.with_parents(ls, k.subjects(ls, 0.3), 1.5, 1)
    assert {c.parent for c in found} == {"jazz"}


def table(spark):
    return spark.createDataFrame([(a, s, v, 9, [float(x) for x in vec]) for a, s, v, vec in LABELS], "area string, sub string, views long, videos long, vec array<double>")


def test_clusters_and_projection(spark):
    found = q.clusters(table(spark), 0.3, 0.31, 1, 1)
    got = {r["old_topic"]: r["new_topic"] for r in q.projection(found).collect()}
    assert got["entertainment/jazz"] == "jazz" and got["sports/schach"] == "chess" and len(got) == 6
    assert q.clusters(table(spark).filter("false")).collect() == []


def test_too_many_labels_are_refused(spark, monkeypatch):
    with pytest.raises(ValueError):
        q.few(spark.range(3), 2)
    assert q.few(spark.range(3), 3).count() == 3


def test_vectors_of_unequal_lengths_stay(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], "id long, v array<double>")
    assert {r["id"]: r["v"] for r in q.centred(df, "v").collect()} == {1: [1.0, 2.0], 2: [3.0]}
    assert q.centred(df.filter("false"), "v").collect() == []


def test_nearest_centroid_without_comparing_all():
    """Equal to all products; of 2,000 centroids in clusters under a fifth are compared."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(60, 32))
    centres = middles[rng.integers(0, 60, 2000)] + 0.08 * rng.normal(size=(2000, 32))
    centres[1990:] = centres[10:20]  # ties, of which the last wins
    held = q.Centres.of(list(centres), 32)
    for rows in (centres[rng.integers(0, 2000, 700)] + 0.05 * rng.normal(size=(700, 32)), rng.normal(size=(300, 32))):
        units = rows / np.linalg.norm(rows, axis=1)[:, None]
        cosines = np.round(units @ (centres / np.linalg.norm(centres, axis=1)[:, None]).T, 9)
        want = 1999 - cosines[:, ::-1].argmax(axis=1)
        got, compared = held.nearest(units)
        assert (got == want).all()
        if len(rows) == 700:
            assert compared < 700 * 2000 / 5


def test_nearest_centroid_of_odd_vectors(spark):
    v = "array<double>"
    centres = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0])], f"label string, centroid {v}")
    rows = spark.createDataFrame([(1, [3.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [-1.0, -1.0])], f"i int, vec {v}")
    got = {r["i"]: r["nearest"] for r in q.nearest(rows, "vec", centres, "label").collect()}
    assert got == {1: "a", 2: "b", 3: "e", 4: "e", 5: "e", 6: "e"}
    none = q.nearest(rows, "vec", centres.filter("false"), "label").collect()
    assert len(none) == 6 and {r["nearest"] for r in none} == {None}


def test_more_labels_than_twenty_thousand(monkeypatch):
    import pandas as pd

    n = 20_001
    pdf = pd.DataFrame({"area": "a", "sub": [f"s{i}" for i in range(n)], "views": 1, "videos": 9, "vec": [[1.0, i % 3] for i in range(n)]})
    assert len(q._labels(pdf).areas) == n
    monkeypatch.setattr(q, "MOST_VALUES", 2 * n - 1)
    with pytest.raises(ValueError):
        q._labels(pdf)


def test_closest_pairs_after_many_merges():
    rng = np.random.default_rng(5)
    v = k.unit(np.concatenate([rng.normal(size=(90, 6)), np.repeat(rng.normal(size=(10, 6)), 3, axis=0)]))
    for threshold in (0.1, 0.5, 0.95):
        assert same(k.agglomerate(v, np.ones(len(v)), threshold), slow(v, np.ones(len(v)), threshold))


def test_merges_ahead_change_no_answer(monkeypatch):
    """Most merges come from products of many at once; what they say is what each alone says."""
    rng = np.random.default_rng(7)
    v, w = k.unit(rng.normal(size=(110, 8))), rng.integers(1, 60, 110)
    met, found = k.Closest._met, []
    monkeypatch.setattr(k.Closest, "_met", lambda self, r, gone: found.append(met(self, r, gone)) or found[-1])
    want = {t: slow(v, w, t) for t in (0.3, 0.7)}
    for ahead in (1, 5, 48):
        monkeypatch.setattr(k, "AHEAD", ahead)
        for t in (0.3, 0.7):
            assert same(k.agglomerate(v, w, t), want[t])
    found.clear()
    k.agglomerate(v, w, 0.3)
    assert sum(x is not None for x in found) > len(found) / 2


def test_folding_stacks_the_centres_once(monkeypatch):
    """Each small one in turn to the nearest big one as it is by then, ties to the first; no stack of all for each."""
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.normal(size=(40, 6)), np.repeat(rng.normal(size=(5, 6)), 2, axis=0), rng.normal(size=(70, 6))])
    n = len(v)
    ls = k.Labels(["a"] * n, [f"s{i}" for i in range(n)], rng.integers(1, 60, n), np.array([9] * 50 + [1] * 70), v)
    found = [k.cluster(ls, [r], f"s{r}") for r in range(n)]
    want = list(found[:50])
    for c in found[50:]:
        best = max(range(50), key=lambda i: (round(float(want[i].centre @ c.centre), 12), -i))
        want[best] = k.merged(ls, want[best], c)
    stacks, stack = [], np.stack
    monkeypatch.setattr(np, "stack", lambda *a, **kw: stacks.append(len(a[0])) or stack(*a, **kw))
    for block in (4_000_000, 200):
        monkeypatch.setattr(k, "BLOCK", block)
        stacks.clear()
        got = k.fold_small(ls, found, 3)
        assert [(c.rows, c.name) for c in got] == [(c.rows, c.name) for c in k.in_order(ls, want)]
        assert sum(stacks) <= n
        stacks.clear()
        groups = k.top_groups(found, -1.0, 3)
        assert sorted(r for g in groups for r in g) == list(range(n)) and len(groups) == 50
        assert sum(stacks) <= 3 * n
