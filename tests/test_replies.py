from __future__ import annotations

import random

import pytest

from viewtrail.functions import replies as r
from viewtrail.sources import config

AREAS = r.Areas(("dev", "gaming", "unclear", "education"))


def test_verdicts_by_number():
    got = r.verdicts("Here:\n```\n2) gaming/rust consume 0.7\n1. dev/talks learn 0.9\n3: unclear mixed 0.5\n```", 3, AREAS)
    assert got == [("dev/talks", "learn", 0.9), ("gaming/rust", "consume", 0.7), ("unclear", "mixed", 0.5)]


@pytest.mark.parametrize("reply", ["1 dev learn 0.9", "1 dev learn 0.9\n1 dev learn 0.9\n2 dev learn 1", "1 dev learn 0.9\n2 nowhere learn 0.9", "1 dev learn 0.9\n2 dev/talks binge 0.9", "1 dev learn 0.9\n2 dev learn 1.5", "1 dev learn 0.9\n2 dev learn 0.9\n3 dev learn 0.9"])
def test_refusals(reply):
    with pytest.raises(r.Refused):
        r.verdicts(reply, 2, AREAS)


@pytest.mark.parametrize(("line", "want"), [("1 gaming factorio consume 0.9", ("gaming/factorio", "consume", 0.9)), ("1 dev/talks 0.9", ("dev/talks", "", 0.9)), ("1 gaming/factorio-consume 0.9", ("gaming/factorio", "consume", 0.9)), ("1 education dev 0.9", ("education/dev", "", 0.9)), ("1 unclear 0.1", ("unclear", "", 0.1))])
def test_repairs(line, want):
    assert r.verdicts(line, 1, AREAS) == [want]


def test_other_kinds():
    assert r.modes("1 learn\n2 unclear", 2) == ["learn", ""]
    assert r.names("1. Rock Music\n1. jazz\n2. Chess!", 2) == ["jazz", "Chess!"]
    assert r.subjects("1 Other 0.2\n2 rust 0.9", 2) == [("", 0.2), ("rust", 0.9)]
    assert r.picks("7 1\n9 2", 2) == {1: 1, 2: 2} and r.picks("2. 0\n1. 1", 2) == {1: 1, 2: 0} and r.picks("1 1", 2) == {1: 1}
    assert r.verdict_json('so: {"topic": "DEV/x", "mode": "learn", "confidence": 0.5}.', AREAS) == ("dev/x", "learn", 0.5)
    assert r.verdict_json("none", AREAS) is None


def test_parse_replies(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "1 dev learn 0.9\n2 gaming mixed 0.1"), (2, ["c"], "sorry"), (3, [], None)], "batch_id long, ids array<string>, reply string")
    got = {x["id"]: (x["topic"], x["error"] is None) for x in r.parse_replies(df, AREAS).collect()}
    assert got == {"a": ("dev", True), "b": ("gaming", True), "c": (None, False)}


@pytest.mark.parametrize("data", [{"topics": [{"id": ""}]}, {"topics": [{"id": "a/b"}, {"id": "unclear"}]}, {"topics": [{"id": "a"}]}, {"rules": [{"topic": "unclear"}]}, {"rules": [{"id": "x", "topic": "nowhere", "tag_any": ["a"]}]}, {"rules": [{"id": "x", "topic": "unclear"}]}, {"rules": [{"id": "x", "topic": "unclear", "mode": "binge", "tag_any": ["a"]}]}, {"rules": [{"id": "x", "topic": "unclear", "tag_any": ["a"]}] * 2}])
def test_config_rejections(data):
    with pytest.raises(config.BadConfig):
        config.parse(data)


def test_projection_round_trip(tmp_path):
    path = tmp_path / "map.yaml"
    config.write_projection([("a/x", "top/one", 3), ("b", "other", 9)], str(path), ["made by hand"])
    assert config.load_projection(str(path)) == [("a/x", "top/one"), ("b", "other")]
    assert path.read_text().index("b: other") < path.read_text().index("a/x: top/one")
    odd = [("a: b/#x", "no", 1), ("yes", "top: 1/- two", 2), ("é/ß", 'q"uote', 3)]
    config.write_projection(odd, str(path))
    assert config.load_projection(str(path)) == sorted((a, b) for a, b, _ in odd)
    assert config.load_control(str(tmp_path / "none"))["stop"] is False


def test_expressions_read_lines_as_python_does(spark):
    rng = random.Random(6)
    words = ["learn", "consume", "mixed", "unclear", "binge", "Rock", "Other", "Deep-Dives!", "!!", "-", "n-a", "none", "0.5", "1", "1.5", "-1", ".2", "1e0", "x" * 40 + "-y", "é"]
    replies = []
    for k in range(400):
        count = rng.randrange(0, 4)
        order = rng.sample(range(1, count + 1), count)
        lines = [f"{n}{rng.choice(['', '.', ')', ':'])}{rng.choice([' ', '  ', chr(9)])}" + " ".join(rng.choice(words) for _ in range(rng.choice([1, 2]))) for n in order]
        for _ in range(rng.choice([0, 0, 1])):
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["Here:", "", "9 learn", "9 nothing at all", "1 learn", "0 learn", "007 learn", "99999999999999999999 learn", "1 rust 0.5", "a1 learn"]))
        replies.append((k, [f"{k}-{i}" for i in range(count)], chr(10).join(lines) if k else None))
    df = spark.createDataFrame(replies, "batch_id long, ids array<string>, reply string")
    plain = {"modes": lambda x, n: [(m,) for m in r.modes(x, n)], "subjects": r.subjects, "names": lambda x, n: [(m,) for m in r.names(x, n)]}
    whole = 0
    for kind, read in plain.items():
        want = {}
        for _, ids, reply in replies:
            try:
                want |= {i: (*v, None) for i, v in zip(ids, read(reply or "", len(ids)), strict=True)}
                whole += len(ids)
            except r.Refused as why:
                want |= {i: (*[None] * (2 if kind == "subjects" else 1), str(why)) for i in ids}
        got = r.parse_kind(df, kind)
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
        assert {x["id"]: tuple(x)[2:] for x in got.collect()} == want
    assert whole > 100


def test_lines_that_repeat_are_read_once(monkeypatch):
    calls, mended = [], r.repaired
    monkeypatch.setattr(r, "repaired", lambda f, areas: calls.append(f) or mended(f, areas))
    areas = r.Areas(("dev", "gaming", "unclear"))
    reply = "\n".join(f"{n}. dev/talks 0.7" for n in range(1, 101))
    assert r.verdicts(reply, 100, areas) == [("dev/talks", "", 0.7)] * 100
    assert len(calls) == 1
    other = r.Areas(("gaming", "unclear"))
    with pytest.raises(r.Refused):
        r.verdicts(reply, 100, other)  # what was kept belongs to the areas
    long = f"1 dev/{'x' * 500} learn 0.5"
    assert r.verdicts(long, 1, areas) == [(f"dev/{'x' * 24}", "learn", 0.5)]
