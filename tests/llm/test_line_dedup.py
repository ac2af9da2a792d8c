from __future__ import annotations

import random

from viewtrail.llm import line_dedup as m


def shingles(line, size=8):
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def brute(rows):
    """Kept line of every line that isn't blank, by all pairs of distinct lines."""
    at = {}
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                at.setdefault(line.strip(" "), set()).add((d is None, d or 0, n))
    names = list(at)
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(x) for x in names]
    for i in range(len(names)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, x in enumerate(names):
        groups.setdefault(find(i), set()).update(at[x])
    return {p: min(g) for g in groups.values() for p in g}


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [line(rng.randint(3, 40)) for _ in range(40)]
    rows = []
    for d in range(30):
        lines = []
        for _ in range(12):
            t = rng.choice(base)
            if rng.random() < 0.4:
                p = rng.randrange(len(t))
                t = t[:p] + "Z" + t[p + rng.randrange(2) :]
            lines.append(rng.choice([t, line(12), "", "  ", "short", f" {t} "]))
        rows.append((d, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, rows[0][1]), (None, rows[1][1]), (3, rows[3][1])]


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, line string, root int")
    got = {}
    for r in m.decisions(docs).collect():
        got[(r["doc_id"] is None, r["doc_id"] or 0, r["line_no"])] = (r["keeper_doc"] is None, r["keeper_doc"] or 0, r["keeper_line"])
        assert r["kept"] == ((r["doc_id"], r["line_no"]) == (r["keeper_doc"], r["keeper_line"]))
    want = brute(rows)
    assert set(got) == set(want)
    assert sum(got[p] != want[p] for p in want) <= 0.01 * len(want)


def test_texts_lose_their_dropped_lines(spark):
    docs = spark.createDataFrame([(1, "one fine line of text\n\nanother quite different one", "en", "s", 0), (2, "fresh words stand here\none fine line of text", "en", "s", 0), (3, None, "en", "s", 7), (4, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in m.deduplicated(docs).collect()}
    assert got[1][0] == "one fine line of text\n\nanother quite different one" and got[2] == ("fresh words stand here", 22)
    assert got[3] == (None, 7) and got[4][0] == ""
    assert m.deduplicated(docs.filter("false")).collect() == [] and m.deduplicated(docs).columns == docs.columns


def test_a_crowd_of_near_copies_is_one_component(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards box " * 4
    docs = spark.createDataFrame([(d, f"{base}{d:05d}") for d in range(400)], "doc_id long, text string")
    got = m.decisions(docs).collect()
    assert sum(r["kept"] for r in got) == 1


def kept_of(rows):
    return {p for p, keeper in brute(rows).items() if p == keeper}


def kept_by(spark, rows):
    got = m.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {(False, r["doc_id"], r["line_no"]) for r in got if r["kept"]}


def test_a_template_of_many_classes_links_every_class(spark, monkeypatch):
    """Pairs of one template with own tails: links inside a class, none across."""
    monkeypatch.setattr(m, "BLOCK", 64, raising=False)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base, rows = word(240), []
    for c in range(200):
        tail = word(72)
        rows += [(2 * c, base + tail), (2 * c + 1, base + tail[:-1] + "#")]
    rng.shuffle(rows)
    assert len(kept_of(rows)) == 200
    assert kept_by(spark, rows) == kept_of(rows)


def test_a_crowd_of_random_edits_is_linked_like_all_pairs(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300))
    rows = []
    for d in range(250):
        t = list(base)
        for _ in range(rng.choice((2, 3, 4))):
            t[rng.randrange(len(t))] = "#"
        rows.append((d, "".join(t)))
    want = kept_of(rows)
    assert 1 < len(want) < 250
    assert len(kept_by(spark, rows) ^ want) <= 3


def test_rows_of_null_and_repeated_ids_lose_only_their_own_lines(spark):
    copied, own = "a line that document one holds as well", "only this document has these words"
    rows = [(1, copied), (None, f"{copied}\nthe first text without an id"), (None, f"{own}\nanother text that has no id"), (2, f"{copied}\nold words of the second"), (2, f"quite fresh words of the second\n{copied}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]) for r in m.deduplicated(docs).collect()}
    assert got == {(1, copied), (None, "the first text without an id"), (None, f"{own}\nanother text that has no id"), (2, "old words of the second"), (2, "quite fresh words of the second")}


def test_signatures_set_few_pairs_of_short_lines_aside(spark):
    """16 of 20 shingles in common, at the bound: fewer than 1.2 % are missed."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = []
    for p in range(4000):
        base = word(23)
        rows += [(2 * p, base + "AB"), (2 * p + 1, base + "CD")]
    missed = len(kept_by(spark, rows)) - 4000
    assert 0 <= missed < 48
    print("missed", missed)


def test_a_text_of_many_equal_lines_takes_linear_time(spark):
    """Its rebuilding, too, which once looked every line up in a list of all dropped ones."""
    import time

    lines = ["the very same line again"] * 300_000
    lines[200_000] = "another line that stays where it is"
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "first of its kind\n" * 3 + "\n" + "the very same line again")], "doc_id long, text string")
    began = time.monotonic()
    got = {r["doc_id"]: r["text"] for r in m.deduplicated(docs).collect()}
    assert got == {1: "the very same line again\nanother line that stays where it is", 2: "first of its kind\n"}
    assert time.monotonic() - began < 120


def test_exact_sets_of_long_lines_take_linear_time(spark):
    """Each shingle's place once copied the whole line."""
    import time

    rng = random.Random(9)
    line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=400_000)).strip()
    docs = spark.createDataFrame([(1, line), (2, f"{line[:-1]}#"), (3, "a short one")], "doc_id long, text string")
    began = time.monotonic()
    assert {r["doc_id"]: r["keeper_doc"] for r in m.decisions(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert time.monotonic() - began < 30


def test_bands_of_two_are_compared_once(spark, monkeypatch):
    """Pairs under the bound, each in bands of its own: nothing is left for the blocks."""
    rng = random.Random(10)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = []
    for p in range(60):
        base = word(60)
        rows += [(2 * p, base + word(10)), (2 * p + 1, base + word(10))]
    calls, met = [], m._met
    monkeypatch.setattr(m, "_met", lambda placed, *rest: calls.append(placed.count()) or met(placed, *rest))
    assert len(kept_by(spark, rows)) == 120
    assert not sum(calls)


def test_small_bands_and_later_links_give_all_pairs_components(spark, monkeypatch):
    """Chains whose links stand in bands of any size, with and without stars."""
    rng = random.Random(11)
    rows = []
    for _ in range(25):
        t = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(260)]
        for _ in range(rng.randint(2, 12)):
            for _ in range(2):
                t[rng.randrange(len(t))] = rng.choice("0123456789")
            rows.append((len(rows), "".join(t)))
    want = kept_of(rows)
    for few in (2, 4, 100):
        monkeypatch.setattr(m, "FEW", few, raising=False)
        assert len(kept_by(spark, rows) ^ want) <= 2


def test_sketches_of_mixed_bands_are_joined_once_for_all_parts(spark, monkeypatch):
    """Each part once shuffled all sketches again."""
    monkeypatch.setattr(m, "PART_LINES", 20)
    rng, names, stored = random.Random(14), [], m.stored
    monkeypatch.setattr(m, "stored", lambda df, name: names.append(name) or stored(df, name))
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base = word(240)
    rows = [(d, base + word(72)) for d in range(40)]
    assert kept_by(spark, rows) == kept_of(rows)
    assert names.count("line-mixed") == 1 and names.count("line-links") > 3
