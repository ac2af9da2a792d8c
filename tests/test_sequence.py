"""Hand-counted fixtures of the sequence operators."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from viewtrail.operators import sequence as q

SCHEMA = "event_id long, viewer_id long, watched_at timestamp, channel_id long, channel string, area string, sub string, topic string, duration_s long"
BASE = datetime(2026, 7, 1, 12)


def rows(spark, views):
    """views: (minutes or None, area, seconds)."""
    data = [(i, 1, None if m is None else BASE + timedelta(minutes=m), i % 3, f"c{i % 3}", a, None, a, s) for i, (m, a, s) in enumerate(views)]
    return spark.createDataFrame(data, SCHEMA)


PATH = [(0, "music", 300), (5, "music", 300), (60, "sports", 300), (66, "sports", 300), (72, "sports", 300), (78, "sports", 300), (84, "music", 300), (2880, "film", 2700), (2885, "music", 200), (2890, "film", 2700), (None, "music", 100)]


def test_hand_countable_path(spark):
    t = q.timeline(rows(spark, PATH))
    found, sessions = q.chains(t), q.sessions(t)
    assert t.count() == 10 and t.filter("overlap").count() == 1 and sessions.count() == 3
    assert [(r["len"], r["area"]) for r in found.collect()] == [(4, "sports")]
    h = q.headline(t).first()
    assert (h["longest_views"], h["deepest_chain"], str(h["busiest_day"]), h["busiest_views"], h["duration_s"]) == (5, 4, "2026-07-01", 7, 7700)
    assert (h["deepest_session"], h["deepest_started"], h["chain_views"]) == (2, BASE + timedelta(minutes=60), 4)


@pytest.mark.parametrize(("minutes", "sessions"), [(29, 1), (30, 1), (31, 2)])
def test_session_boundary(spark, minutes, sessions):
    s = q.sessionize(rows(spark, [(0, "a", 60), (minutes, "a", 60)]))
    assert s.agg(F.max("session_no")).first()[0] == sessions


@pytest.mark.parametrize(("gap", "length", "edge"), [(5, 300, "through"), (4, 300, "most"), (2.5, 300, "most"), (2, 300, "skipped"), (5, 0, None)])
def test_edges(spark, gap, length, edge):
    e = q.mark_edges(q.sessionize(rows(spark, [(0, "a", length), (gap, "a", 60)]))).orderBy("watched_at").collect()
    assert e[0]["edge"] == edge and e[1]["edge"] is None


@pytest.mark.parametrize(("length", "area", "minutes", "overlap"), [(1200, "b", 5, True), (1199, "b", 5, False), (1200, "a", 5, False), (1200, "b", 20, False)])
def test_overlap_needs_length_area_and_time(spark, length, area, minutes, overlap):
    t = q.timeline(rows(spark, [(0, "a", length), (minutes, area, 60)])).orderBy("watched_at").collect()
    assert t[1]["overlap"] is overlap


def test_overlap_rows_do_not_become_the_state(spark):
    t = q.timeline(rows(spark, [(0, "a", 2400), (5, "b", 2400), (10, "c", 60), (41, "b", 60)])).orderBy("watched_at")
    assert [r["overlap"] for r in t.collect()] == [False, True, True, False]


@pytest.mark.parametrize(("views", "lengths"), [([(i * 5, "a", 60) for i in range(4)], [4]), ([(i * 5, "a", 60) for i in range(3)], []), ([(i * 16, "a", 60) for i in range(4)], []), ([(0, "a", 60), (5, "a", 60), (6, "b", 60), (10, "a", 60), (15, "a", 60)], [])])
def test_chains(spark, views, lengths):
    assert [r["len"] for r in q.chains(q.timeline(rows(spark, views))).collect()] == lengths


def test_transitions_stay_in_sessions(spark):
    got = {(r["from_area"], r["to_area"]): r["n"] for r in q.transitions(q.timeline(rows(spark, PATH))).collect()}
    assert got == {("music", "music"): 1, ("sports", "sports"): 3, ("sports", "music"): 1, ("film", "film"): 1}


def test_peak_names_the_first_axis(spark):
    days = spark.createDataFrame([(1, f"d{i}", 5, 5 if i == 3 else 0, 0, 1) for i in range(4)], "viewer_id long, day string, views long, chain_max long, night_views long, areas long")
    got = {r["day"]: (r["peak"], r["peak_axis"]) for r in q.peaks(days).collect()}
    assert got["d3"] == (750, "chain") and got["d0"] == (0, None)


def test_day_of_the_session_start_owns_all_its_views(spark):
    d = q.days(q.timeline(rows(spark, [(11 * 60 + 50, "a", 60), (12 * 60 + 5, "a", 60)]))).collect()
    assert [(r["day"], r["views"], r["night_views"], r["epoch_day"]) for r in d] == [("2026-07-01", 2, 2, 20635)]


def test_order_of_rows_does_not_matter(spark):
    a = q.timeline(rows(spark, PATH)).select("event_id", "session_no", "edge", "overlap").collect()
    b = q.timeline(rows(spark, PATH).repartition(3, "event_id")).select("event_id", "session_no", "edge", "overlap").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_rankings_take_the_newest_of_equals(spark):
    found = q.chains(q.timeline(rows(spark, [(day * 1440 + i * 5, "ab"[day % 2], 60) for day in range(3) for i in range(4)])))
    order = [r["session_no"] for r in q.ranked(found, "depth", q.CHAIN_KEYS, "started").collect()]
    assert order == [3, 2, 1] and [r["session_no"] for r in q.ranked(found, "date", q.CHAIN_KEYS, "started", 1, "a").collect()] == [3]
    with pytest.raises(KeyError):
        q.ranked(found, "nothing", q.CHAIN_KEYS, "started")


def test_rows_of_one_viewer_scanned_apart_or_together(spark):
    s = q.mark_edges(q.sessionize(rows(spark, PATH)))
    columns = ["event_id", *(c for c, _, _ in q.SCANNED)]
    a, b = (sorted(map(str, q.scan_sessions(s, together=t).select(*columns).collect())) for t in (True, False))
    assert a == b and len(a) == 10


@pytest.mark.parametrize("block_s", [60, 420, 3600, 10**9])
def test_blocks_that_cut_sessions(spark, block_s):
    """Cuts between any two rows of a session, and of an overlap, an island or a channel, change nothing."""
    import random

    rng = random.Random(block_s)
    steps, at = [], 0
    for _ in range(300):
        at += rng.choice([0, 1, 4, 14, 15, 16, 29, 30, 31, 700])
        steps.append((at, rng.choice("aab"), rng.choice([0, 60, 1199, 1200, 7200])))
    views = rows(spark, [*steps, (None, "a", 60)])
    views = views.unionByName(views.withColumn("viewer_id", F.lit(None).cast("long")).withColumn("event_id", F.col("event_id") + 1000))
    columns = ["event_id", "session_no", "gap_s", "edge", "new_channel", *(c for c, _, _ in q.SCANNED)]
    got = sorted(map(str, q.timeline(views, block_s=block_s).select(*columns).collect()))
    assert got == sorted(map(str, by_hand(steps, columns)))


def by_hand(steps, columns):
    """The same rows by a loop over one viewer's views."""
    from pyspark.sql import Row

    out, seen = [], set()
    session = chain = place = total = 0
    for i, (m, area, length) in enumerate(steps):
        new = i == 0 or m - steps[i - 1][0] > 30
        if new:
            session, chain, place, total, start, before, state = session + 1, 0, 0, 0, m, None, None
        else:
            before = state[1]
        beside = not new and state[2] >= 1200 and m * 60 < state[0] * 60 + state[2] and area != state[1]
        if not beside:
            if new or area != state[1] or m - state[0] > 15:
                chain += 1
            state = (m, area, length)
        place, total = place + 1, total + length
        after = steps[i + 1][0] - m if i + 1 < len(steps) and steps[i + 1][0] - m <= 30 else None
        gap = None if after is None else after * 60
        edge = None if gap is None or length <= 0 else "through" if gap >= length else "skipped" if 2 * gap < length else "most"
        for add, channel in ((0, i % 3), (1000, i % 3)):
            fresh = (add, channel) not in seen
            seen.add((add, channel))
            values = {"event_id": i + add, "session_no": session, "gap_s": gap, "edge": edge, "new_channel": fresh, "overlap": beside, "place": place, "session_start": BASE + timedelta(minutes=start), "area_before": before, "chain_no": chain, "seconds": total}
            out.append(Row(**{c: values[c] for c in columns}))
    return out


def test_one_viewer_fills_many_tasks(spark):
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        views = rows(spark, [(i * 700, "a", 60) for i in range(200)])
        for found in (q.sessionize(views), q.timeline(views)):
            each = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
            assert len(each) == 4 and max(r["count"] for r in each) < 100
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
