"""Stateful timelines, late rows and waiting facts over several triggers."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from viewtrail.operators import sequence as q
from viewtrail.streaming import incremental as inc
from viewtrail.streaming import timelines as tl

BASE = datetime(2026, 7, 1, 12)
ROWS = "viewer_id long, watched_at timestamp, event_id long, area string, duration_s long"


def source(spark, folder, parts, schema):
    """A stream of one file a trigger, in this order."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def swept(spark, stream, folder, schema):
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return run, spark.read.schema(schema).parquet(f"{folder}/out")


def test_timelines_equal_the_batch_and_leave_no_state(spark, tmp_path):
    rng = random.Random(8)
    views, at = [], {1: 0, 2: 0}
    for i in range(160):
        viewer = rng.choice([1, 1, 2])
        at[viewer] += rng.choice([0, 2, 5, 14, 15, 16, 30, 31, 90])
        views.append((viewer, BASE + timedelta(minutes=at[viewer]), i, rng.choice("aab"), rng.choice([None, 60, 1199, 1200, 5400])))
    views.append((3, BASE + timedelta(minutes=50), 900, None, 60))  # one view, no area
    arrived = sorted(views, key=lambda v: (v[1] + timedelta(minutes=rng.randrange(50)), v[2]))
    parts = [arrived[k : k + 54] for k in range(0, len(arrived), 54)] + [[(None, BASE + timedelta(days=99), None, None, None)]]
    with tl.rocks(spark):
        run, out = swept(spark, tl.timelines(source(spark, f"{tmp_path}/in", parts, ROWS)), tmp_path, tl.OUT)
    batch = spark.createDataFrame(views, ROWS).withColumn("channel_id", F.lit(None).cast("long"))
    t = q.timeline(batch)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    us = F.unix_micros
    assert rows(out.filter("kind = 'view'").select("viewer_id", "event_id", "overlap", "session_us")) == rows(t.select("viewer_id", "event_id", "overlap", us("session_start")))
    assert rows(out.filter("kind = 'chain'").select("viewer_id", "area", "len", "at_us", "span_s", "duration_s")) == rows(q.chains(t).select("viewer_id", "area", "len", us("started"), "span_s", "duration_s"))
    s = q.sessions(t)
    assert rows(out.filter("kind = 'session'").select("viewer_id", "session_us", "len", "span_s", "duration_s")) == rows(s.select("viewer_id", us("started"), "views", F.floor((us("ended") - us("started")) / 1_000_000), F.coalesce("duration_s", F.lit(0))))
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == 0 and len(run.recentProgress) >= 4


def test_open_sessions_are_held_and_late_rows_kept(spark, tmp_path):
    at = lambda m: BASE + timedelta(minutes=m)
    parts = [[(1, at(0), 1, "a", 60), (1, at(10), 2, "a", 60)], [(1, at(400), 3, "a", 60)], [(1, at(500), 4, "a", 60)], [(1, at(5), 5, "a", 60), (1, at(505), 6, "a", 60)]]
    stream = source(spark, f"{tmp_path}/in", parts, ROWS)
    s = inc.session_windows(stream)
    _, out = swept(spark, s, f"{tmp_path}/sessions", s.schema)
    assert [(r["started"], r["ended"], r["views"]) for r in out.orderBy("started").collect()] == [(at(0), at(10), 2), (at(400), at(400), 1)]  # that of 500 is open
    side = inc.LateRows(f"{tmp_path}/late")
    stream.writeStream.foreachBatch(side).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [r["event_id"] for r in spark.read.schema(ROWS).parquet(f"{tmp_path}/late/late/batch=*").collect()] == [5]


def test_facts_wait_and_are_given_up(spark, tmp_path):
    at = lambda m: BASE + timedelta(minutes=m)
    facts = [[(1, "x", at(0)), (2, "y", at(5))], [(3, "x", at(90)), (4, "z", at(100))], [(None, "none", at(9000))]]
    known = [[("y", at(60), 7)], [("x", at(110), 8), ("z", at(500), 9)], [("none", at(9000), None)]]
    f = source(spark, f"{tmp_path}/f", facts, "event_id long, key string, heard_at timestamp")
    d = source(spark, f"{tmp_path}/d", known, "key string, known_at timestamp, value long")
    held = inc.held_facts(f, d, "key", "value", "2 HOURS", "1 HOUR")
    _, out = swept(spark, held, tmp_path, held.schema)
    got = {r["event_id"]: (r["state"], r["value"]) for r in out.collect()}
    assert {k: got[k] for k in (1, 2, 3, 4)} == {1: ("known", 8), 2: ("known", 7), 3: ("known", 8), 4: ("alone", None)}  # z came too late


def test_a_session_that_a_row_reaches_after_it_has_closed_is_one(spark, tmp_path):
    at = lambda m: BASE + timedelta(minutes=m)
    row = lambda viewer, m, n: (viewer, at(m), n, "a", 60)
    # 0 closes behind the watermark of 91; 20 comes later, and its own time isn't behind it.
    parts = [[row(1, 0, 1)], [row(2, 91, 2)], [row(2, 92, 3)], [row(1, 20, 4), row(1, 60, 5)], [(None, at(9000), None, None, None)]]
    s = inc.session_windows(source(spark, f"{tmp_path}/in", parts, ROWS))
    _, pieces = swept(spark, s, tmp_path, s.schema)
    assert [r["views"] for r in pieces.filter("viewer_id = 1").orderBy("started").collect()] == [1, 1, 1]
    got = inc.rejoined(pieces).orderBy("started").collect()
    assert [(r["viewer_id"], r["started"], r["ended"], r["views"], r["duration_s"]) for r in got] == [(1, at(0), at(20), 2, 120), (1, at(60), at(60), 1, 60), (2, at(91), at(92), 2, 120)]


def test_closed_sessions_equal_sql_where_late_rows_reach_closed_ones(spark, tmp_path):
    import duckdb

    from viewtrail.plans import catalog

    start, n = datetime(2026, 7, 1), 3000
    end = start + timedelta(seconds=(n - 1) * 97)
    rows = [(i, start + timedelta(seconds=i * 97), i % 700 * 50, "view", 10.0, '{"k": 50}') for i in range(n)]
    # Row 3180 is a multiple of 53 and so comes late: when the session that it belongs to has closed.
    rows += [(k, end - timedelta(minutes=m), 50_000, "view", 10.0, '{"k": 50}') for k, m in ((3181, 97), (3180, 85))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["t8_closed_sessions"]).fetchall())
    (whole,) = [f for f in (tmp_path / "events.parquet").parent.iterdir() if f.name == "events.parquet"]
    got = catalog.queries()["t8_closed_sessions"](spark, str(whole.parent))
    assert sorted(map(tuple, got.collect())) == want


class _Held(list):
    """A state of its handle, kept in memory."""

    def appendList(self, rows):
        self.extend(rows)

    def exists(self):
        return bool(self)

    def get(self):
        return list(self) if not self or isinstance(self[0], tuple) else self[0]

    put = update = lambda self, rows: self.__setitem__(slice(None), rows)


def test_waiting_rows_are_packed():
    """A row isn't an element of state of its own, whatever comes in and whatever waits on."""
    import types

    import pandas as pd

    n, states = 25_000, {}
    make = lambda name, schema: states.setdefault(name, _Held())
    handle = types.SimpleNamespace(getListState=make, getValueState=make, registerTimer=lambda us: None)
    line = tl.Timelines()
    line.init(handle)
    rows = pd.DataFrame({"t": [(n - i) * 1_000_000 for i in range(n)], "event_id": range(n), "area": [None if i % 7 == 0 else "a" for i in range(n)], "duration_s": [None if i % 5 == 0 else 60.0 for i in range(n)]})
    list(line.handleInputRows((1,), iter([rows[:20_000], rows[20_000:]]), None))
    assert len(states["waiting"]) == 3
    mark = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 5_000_000)
    states["open"].update = lambda row: states["open"].__setitem__(slice(None), [list(row)])
    (out,) = line.handleExpiredTimer((1,), mark, None)
    seen = out[out["kind"] == "view"]
    assert seen["event_id"].tolist() == list(range(n - 1, n - 5001, -1)) and seen["area"].isna().sum() == sum(i % 7 == 0 for i in range(20_000, n))
    assert len(states["waiting"]) == 2
