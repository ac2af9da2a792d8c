from __future__ import annotations

import random

from viewtrail.llm import decontaminate as m

WORDS = "alpha beta gamma delta river stone cloud meadow lantern copper violet harbor winter silver maple thunder orchid canyon marble falcon".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def distance(piece, data):
    """Least edits of the piece to any part of the data, by the full table."""
    row = [0] * (len(data) + 1)
    for i in range(1, len(piece) + 1):
        new = [i]
        for j in range(1, len(data) + 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (piece[i - 1] != data[j - 1])))
        row = new
    return min(row)


def edited(rng, t, edits):
    t = list(t)
    for _ in range(edits):
        p = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[p] = "q"
        elif kind == 1:
            t.insert(p, "q")
        else:
            del t[p]
    return "".join(t)


def test_equals_brute_force():
    rng = random.Random(6)
    items = [(i, text(rng, n)) for i, n in enumerate((3, 5, 8, 12, 20, 30, 40))]
    docs = []
    for k in range(60):
        i, t = items[k % len(items)]
        a = rng.randrange(len(t) // 2) if k % 3 == 0 else 0
        passage = edited(rng, t[a:], rng.randrange(0, max(1, len(t) // 9)))
        docs.append(f"{text(rng, 10)} {passage} {text(rng, 10)}")
    docs += [text(rng, 60) for _ in range(10)] + ["", None, items[4][1].upper().replace(" ", "\n--  ")]
    got = m.Searcher(items).texts(docs)
    for d, found in zip(docs, got):
        data, want = m.normalised(d), {}
        for owner, piece in m.pieces(items):
            e = distance(piece, data)
            if e <= m.budget(len(piece)):
                want[owner] = min(e, want.get(owner, 99))
        assert set(found) == set(want)
        for k, e in found.items():
            assert (e == 0) == (want[k] == 0)
    assert got[-1] == {4: 0} and sum(map(bool, got)) > 20


def test_defined_cases_and_blocks(spark):
    rng = random.Random(7)
    items = [(i, text(rng, 15)) for i in range(12)]
    rows = [(k, f"{text(rng, 5)} {items[k % 12][1]} {text(rng, 5)}", "e") for k in range(24)] + [(None, items[0][1], "e"), (50, None, "e"), (51, "", "e"), (3, text(rng, 40), "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits string")
    bench = spark.createDataFrame([*items, (12, None), (13, ""), (14, "ab"), (None, items[1][1])], "item_id long, text string")
    for block in (m.BLOCK_BYTES, 300):
        got = m.leaks(docs, bench, block_bytes=block).collect()
        found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(sorted(x["item_id"] if x["item_id"] is not None else -1 for x in r["leaked"]))) for r in got)
        want = sorted([(k, (k % 12,) if k % 12 != 1 else (-1, 1)) for k in range(24)] + [(-1, (0,)), (50, ()), (51, ()), (3, ())])
        assert found == want
    assert m.clean(docs, bench).count() == 3 and m.clean(docs, bench).columns == docs.columns
    assert m.clean(docs.filter("false"), bench).collect() == [] and m.clean(docs, bench.filter("false")).count() == len(rows)


def test_own_columns_of_the_results_name(spark):
    rng = random.Random(12)
    item = text(rng, 30)
    docs = spark.createDataFrame([(1, f"{text(rng, 20)} {item}", "own"), (2, text(rng, 20), "own")], "doc_id long, text string, leaked string")
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None)], "item_id long, text string")
    found = {r["doc_id"]: [x["item_id"] for x in r["leaked"]] for r in m.leaks(docs, bench).collect()}
    assert found == {1: [7, None], 2: []}
    kept = m.clean(docs, bench)
    assert kept.columns == docs.columns and [tuple(r)[::2] for r in kept.collect()] == [(2, "own")]
