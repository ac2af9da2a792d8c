from __future__ import annotations

import json
import os

import pytest

from viewtrail.functions import text as t
from viewtrail.sources import connectors, export

ENTRIES = [
    {"header": "YouTube", "title": "Watched One", "titleUrl": "https://www.youtube.com/watch?v=k3Xw_9-QpLz", "subtitles": [{"name": "C", "url": "https://www.youtube.com/channel/UC1"}], "time": "2026-07-01T10:00:00Z"},
    {"title": "Zwei angesehen", "titleUrl": "https://youtu.be/Zt71mNo-4yA", "time": "2026-07-02"},
    {"title": "Watched an ad", "titleUrl": "https://www.youtube.com/watch?v=x", "details": [{"name": "From Google Ads"}], "time": "2026-07-01T10:00:00Z"},
    {"title": "Watched gone", "time": "2026-07-03T10:00:00.5Z"},
    {"title": "Watched song", "titleUrl": "https://music.youtube.com/watch?v=m", "products": ["YouTube Music"], "time": "2026-07-03T10:00:00+02:00"},
]


def test_export(spark, tmp_path):
    path = tmp_path / "watch-history.json"
    path.write_text(json.dumps(ENTRIES))
    raw = export.read_export(spark, str(path))
    s = export.parse_statistics(raw).first().asDict()
    assert s == {"total": 5, "ads": 1, "views": 4, "no_url": 1, "music": 1, "bad_time": 1}
    views = {r["title"]: r for r in export.views_of(raw).collect()}
    assert views["One"]["video_id"] == "k3Xw_9-QpLz" and views["Zwei"]["video_id"] == "Zt71mNo-4yA" and views["gone"]["video_id"] == ""
    page = tmp_path / "watch-history.html"
    page.write_text("<html></html>")
    with pytest.raises(ValueError, match="HTML"):
        export.read_export(spark, str(page))


def test_discovery_prefers_the_newest_and_its_group(tmp_path):
    for k, group in enumerate(("old", "new")):
        for name in ("watch-history.json", "subscriptions.csv"):
            p = tmp_path / group / "x" / name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text("[]")
            os.utime(p, (1000 + k, 1000 + k if name[0] == "w" else 5000 - k))
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "watch-history.json").write_text("[]")
    history, subs = export.pick_export(str(tmp_path))
    assert history.parts[-3] == subs.parts[-3] == "new"


def test_subscriptions(spark, tmp_path):
    path = tmp_path / "subs.csv"
    path.write_text("Kanal-ID,Kanal-URL,Kanaltitel\nUC1,http://a,One\n,http://b,None\nUC2,http://c\n")
    got = {r["channel_id"]: r["title"] for r in export.read_subscriptions(spark, str(path)).collect()}
    assert got == {"UC1": "One", "UC2": None}


def test_keyed_tables_and_guard(spark, tmp_path):
    (tmp_path / "a1.json").write_text(json.dumps({"id": "a1", "duration": 61.9}))
    assert [r["id"] for r in export.keyed_ids(spark, str(tmp_path)).collect()] == ["a1"]
    assert export.read_keyed(spark, str(tmp_path)).first()["duration"] == 61.9
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 2)], "k string, v int")
    assert sorted(map(tuple, export.upsert(old, new, "k", "v").collect())) == [("a", 1), ("b", 3), ("c", 2)]
    with pytest.raises(Exception, match="unsafe key: ../x"):
        export.upsert(old, spark.createDataFrame([("../x", 2)], "k string, v int"), "k").collect()
    export.write_jsonl(old, str(tmp_path / "out"))
    assert export.read_jsonl(spark, str(tmp_path / "out"), old.schema).count() == 2
    export.append_log(str(tmp_path / "log"), event="x", n=1)
    assert json.loads((tmp_path / "log").read_text()) == {"event": "x", "n": 1}


def test_keyed_files_are_whole_and_scanned_once(spark, tmp_path):
    folder, schema = tmp_path.as_uri(), "id STRING, n INT"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert sorted(r["key"] for r in export.write_keyed(rows, folder, "id").collect()) == ["a", "b"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.json", "b.json"]
    with pytest.raises(Exception, match="unsafe key"):
        export.write_keyed(spark.createDataFrame([("a/b", 1)], "id string, n int"), folder, "id").collect()
    (tmp_path / "c.json").write_text('{"id": "c", "n": ')
    none = spark.createDataFrame([], "path string")
    first, seen = export.read_unseen(spark, folder, schema, none)
    assert sorted((r["id"], r["n"]) for r in first.collect()) == [("a", 1), ("b", 2)]
    seen = spark.createDataFrame(seen.collect(), "path string")
    (tmp_path / "c.json").write_text('{"id": "c", "n": 3}')
    again, _ = export.read_unseen(spark, folder, schema, seen)
    assert [(r["id"], r["n"]) for r in again.collect()] == [("c", 3)]


def test_listing_of_a_folder(spark, tmp_path):
    for name in ("one/watch-history.json", "one/abos.csv", "two/x/watch-history.json", "cache/watch-history.json", "a/b/c/d/abos.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("[]")
    os.utime(tmp_path / "one/watch-history.json", (2000, 2000))
    os.utime(tmp_path / "two/x/watch-history.json", (3000, 3000))
    r = export.chosen(export.listed(spark, str(tmp_path))).first()
    assert (r["history"], r["subscriptions"], r["exports"]) == ("two/x/watch-history.json", None, 2)
    os.utime(tmp_path / "one/watch-history.json", (4000, 4000))
    r = export.chosen(export.listed(spark, str(tmp_path))).first()
    assert (r["history"], r["subscriptions"]) == ("one/watch-history.json", "one/abos.csv")


def test_backoff_rises_and_falls():
    waits, fails = [], [True, True, False, False, False]

    def call():
        if fails.pop(0):
            raise OSError
        return len(fails)

    ask = connectors.Backoff(sleep=waits.append)
    assert ask(call) == 2 and waits == [1, 2] and ask.level == 1
    assert ask(call) == 1 and waits == [1, 2, 1] and ask.level == 0
    assert ask(call) == 0 and waits == [1, 2, 1]
    assert connectors.missing_models(lambda: ["a"], ["a", "b"]) == ["b"]


def test_waves_wait_resume_and_give_up(spark, tmp_path):
    from viewtrail.streaming import incremental as inc

    schema, seen = spark.createDataFrame([], "k string, v int").schema, []
    facts = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")

    def recompute(known, number, last):
        seen.append((number, last, sorted((r["k"], r["v"], r["state"]) for r in inc.waiting_facts(facts, known, "k", last).collect())))

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "src" / name))

    def run(least):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src" / "*"))
        inc.run_waves(source, inc.Waves(str(tmp_path / "dim"), "k", schema, recompute, least=least, every_s=1e9), str(tmp_path / "check"))

    put("one", [("a", 1)])
    run(least=1)
    assert [s[:2] for s in seen] == [(1, False), (2, False), (3, True)]
    assert seen[0][2] == [("a", None, "waiting"), ("b", None, "waiting"), ("c", None, "waiting")]
    assert seen[1][2][0] == ("a", 1, "known") and seen[2][2][1] == ("b", None, "alone")
    seen.clear()
    put("two", [("a", 5), ("b", 2)])
    run(least=100)  # too few rows for a wave of their own: the first and the last wave run alone
    assert [s[:2] for s in seen] == [(1, False), (2, True)]
    assert seen[0][2][0] == ("a", 1, "known")  # what the earlier run left
    assert seen[1][2] == [("a", 5, "known"), ("b", 2, "known"), ("c", None, "alone")]


def test_connectors(spark):
    ids = spark.createDataFrame([(f"v{i}",) for i in range(7)], "video_id string")
    got = connectors.fetch_metadata(ids, lambda names: [{"id": n, "duration": 9.9} for n in names], chunk=3).collect()
    assert len(got) == 7 and {r["duration_s"] for r in got} == {9}
    with pytest.raises(ValueError):
        connectors.checked_vectors([{"index": 0, "embedding": []}] * 2, 2)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    waits = []
    assert connectors.with_backoff(flaky, sleep=waits.append) == "ok" and waits == [1, 2]


def test_fingerprint_and_hue(spark):
    assert t.fingerprint({"b": "2", "a": "1"}) == t.fingerprint({"a": "1", "b": "2"}) != t.fingerprint({"a": "1", "b": "3"})
    df = spark.createDataFrame([("music",), ("",)], "x string")
    assert [r[0] for r in df.select(t.hue("x")).collect()] == [276, 2166136261 % 360]


def test_bytes_are_cut_and_made_valid(spark):
    from viewtrail.functions import text as t

    rows = spark.createDataFrame([("abc",), ("abcd",), ("aéé",), ("äö",), (None,), ("",)], "x string")
    assert [r[0] for r in rows.select(t.truncate("x", 4)).collect()] == ["abc", "abcd", "aé�…", "äö", None, ""]


def test_subscriptions_of_any_width(spark, tmp_path):
    path = tmp_path / "abos.csv"
    path.write_text('a,b,"c, d",e,f,g,Kanal-ID,Titel\n1,2,3,4,5,6,UC1,One,more\n1,2,3\n1,2,3,4,5,6,Kanal-ID,Two\n')
    got = {r["channel_id"]: r["title"] for r in export.read_subscriptions(spark, str(path)).collect()}
    assert got == {"UC1": "One", "Kanal-ID": "Two"}  # a row of the header's word is a row
    path.write_text("")
    assert export.read_subscriptions(spark, str(path)).collect() == []
