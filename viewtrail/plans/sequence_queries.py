"""Sequence queries: sessions, edges, overlaps, chains, days, transitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import sequence as q
from ..operators.payload import dictionary, payload, view_rows
from ..sources.events import views
from ..sources.scratch import scratch
from .catalog import register
from .oracle import CHAINS, DAYS, SESSIONS, TIMELINE, VIEWS, sql

US = F.unix_micros


def line(spark, d, channels: bool = False) -> DataFrame:
    """The timeline of the columns that its operators read; ``channels``: with the first views of channels."""
    return q.timeline(views(spark, d).select("event_id", "viewer_id", "watched_at", "channel_id", "area", "duration_s"), channels=channels)


@register("f2_dated_views", sql(VIEWS, "SELECT count(*) FILTER (WHERE us IS NOT NULL) AS views, count(*) FILTER (WHERE us IS NULL) AS dropped FROM views"))
def f2_dated_views(spark, d) -> DataFrame:
    return views(spark, d).agg(F.count("watched_at").alias("views"), F.count_if(F.col("watched_at").isNull()).alias("dropped"))


@register("w1_sessionize", sql(SESSIONS, "SELECT event_id, viewer_id, CAST(session_no AS BIGINT) AS session_no FROM sn"))
def w1_sessionize(spark, d) -> DataFrame:
    return q.sessionize(views(spark, d)).select("event_id", "viewer_id", "session_no")


@register("w2_sessions", sql(SESSIONS, """, s AS (SELECT viewer_id, session_no, min(us) AS start_us, max(us) AS end_us, count(*) AS views, sum(duration_s) AS duration_s FROM sn GROUP BY viewer_id, session_no)
SELECT viewer_id, CAST(session_no AS BIGINT) AS session_no, start_us, end_us, views, CAST(duration_s AS BIGINT) AS duration_s,
  coalesce((start_us - lag(end_us) OVER (PARTITION BY viewer_id ORDER BY session_no)) // 1000000, 0) AS gap_before_s,
  CAST(row_number() OVER (PARTITION BY viewer_id ORDER BY session_no DESC) - 1 AS INTEGER) AS ordinal FROM s"""))
def w2_sessions(spark, d) -> DataFrame:
    """Also W7: ordinals, newest first."""
    s = q.sessions(q.sessionize(views(spark, d)))
    return s.select("viewer_id", "session_no", US("started").alias("start_us"), US("ended").alias("end_us"), "views", "duration_s", "gap_before_s", "ordinal")


@register("w3_edges", sql(SESSIONS, "SELECT event_id, gap_s, edge FROM edges"))
def w3_edges(spark, d) -> DataFrame:
    return q.mark_edges(q.sessionize(views(spark, d))).select("event_id", "gap_s", "edge")


@register("w4_overlap", sql(TIMELINE, "SELECT event_id, overlap FROM t"))
def w4_overlap(spark, d) -> DataFrame:
    return line(spark, d).select("event_id", "overlap")


@register("f3_main_lane", sql(TIMELINE, "SELECT viewer_id, area, count(*) AS views FROM main GROUP BY viewer_id, area"))
def f3_main_lane(spark, d) -> DataFrame:
    """Also A23: main-lane views per area."""
    return q.main_lane(line(spark, d)).groupBy("viewer_id", "area").agg(F.count("*").alias("views"))


@register("f4_night_views", sql(VIEWS, "SELECT viewer_id, count(*) FILTER (WHERE hour(watched_at) >= 23 OR hour(watched_at) < 5) AS night, count(*) AS views FROM views GROUP BY viewer_id"))
def f4_night_views(spark, d) -> DataFrame:
    return views(spark, d).groupBy("viewer_id").agg(F.count_if(q.is_night("watched_at")).alias("night"), F.count("*").alias("views"))


@register("w5_chains", sql(CHAINS, "SELECT viewer_id, CAST(session_no AS BIGINT) AS session_no, len, area, start_us, span_s, CAST(duration_s AS BIGINT) AS duration_s, CAST(ordinal AS INTEGER) AS ordinal FROM chains"))
def w5_chains(spark, d) -> DataFrame:
    """Also W6 and W7: span, duration over the whole range, and ordinal."""
    c = q.chains(line(spark, d))
    return c.select("viewer_id", "session_no", "len", "area", US("started").alias("start_us"), "span_s", "duration_s", "ordinal")


@register("j12_chain_doors", sql(CHAINS, "SELECT viewer_id, CAST(session_no AS BIGINT) AS session_no, start_us, nullif(door, '') AS door FROM chains"))
def j12_chain_doors(spark, d) -> DataFrame:
    c = q.chains(line(spark, d))
    return c.select("viewer_id", "session_no", US("started").alias("start_us"), "door")


@register("a28_chain_facts", sql(CHAINS, "SELECT viewer_id, CAST(session_no AS BIGINT) AS session_no, start_us, channels, held, edged, exit_edge FROM chains"))
def a28_chain_facts(spark, d) -> DataFrame:
    c = q.chains(line(spark, d))
    return c.select("viewer_id", "session_no", US("started").alias("start_us"), "channels", "held", "edged", "exit_edge")


@register("a30_chain_depths", sql(CHAINS, "SELECT len, count(*) AS chains FROM chains GROUP BY len"))
def a30_chain_depths(spark, d) -> DataFrame:
    return q.chains(line(spark, d)).groupBy("len").agg(F.count("*").alias("chains"))


#: Values of the keys, as in the operators, for whole and for shared numbers alike.
CHAIN_SQL = {"depth": "len", "span": "span_s", "hours": "duration_s", "channels": "channels", "held": "CASE WHEN edged > 0 THEN held / edged ELSE -1 END", "date": "0"}


@register("o7_chain_ranking", sql(CHAINS, "SELECT * FROM (" + " UNION ALL ".join(f"(SELECT '{k}' AS key, viewer_id, start_us, len, area, round(CAST({v} AS DOUBLE), 6) AS value, CAST(row_number() OVER (ORDER BY CAST({v} AS DOUBLE) DESC, start_us DESC, viewer_id) AS INTEGER) AS rank FROM chains QUALIFY rank <= 60)" for k, v in CHAIN_SQL.items()) + " UNION ALL (SELECT 'click', viewer_id, start_us, len, area, CAST(len AS DOUBLE), CAST(row_number() OVER (ORDER BY len DESC, start_us DESC, viewer_id) AS INTEGER) AS rank FROM chains WHERE area = 'click' QUALIFY rank <= 60))"))
def o7_chain_ranking(spark, d) -> DataFrame:
    """The first 60 by each key, and of one area by depth; also O11, the choice of chains to name."""
    folder = scratch(spark, "chains")
    q.chains(line(spark, d)).write.parquet(folder)
    c, out = spark.read.parquet(folder), []
    for name, key, area in [*((k, k, None) for k in q.CHAIN_KEYS), ("click", "depth", "click")]:
        top = q.ranked(c, key, q.CHAIN_KEYS, "started", 60, area)
        w = Window.orderBy(F.col("by").desc(), F.col("started").desc(), "viewer_id")  # of 60 rows
        out.append(top.select(F.lit(name).alias("key"), "viewer_id", US("started").alias("start_us"), "len", "area", F.round("by", 6).alias("value"), F.row_number().over(w).alias("rank")))
    return reduce(DataFrame.unionByName, out)


DAY_COLUMNS = ["viewer_id", "day", "epoch_day", "views", "duration_s", "sessions", "session_from", "session_to", "area", "areas", "chain_views", "chain_max", "night_views", "through", "edged", "new_channels"]
DAY_SQL = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in ("duration_s", "session_from", "session_to") else f"CAST({c} AS INTEGER) AS {c}" if c == "epoch_day" else c for c in DAY_COLUMNS)


@register("a17_days", sql(DAYS, f"SELECT {DAY_SQL} FROM days"))
def a17_days(spark, d) -> DataFrame:
    """Also A18, W9 and J9: deepest chain, new channels, sessions by day."""
    return q.days(line(spark, d, channels=True)).select(*DAY_COLUMNS).orderBy("viewer_id", "day")


PEAKED = """, r AS (SELECT *,
  (rank() OVER (PARTITION BY viewer_id ORDER BY views) - 1) * 1000 // count(*) OVER v AS pv, (rank() OVER (PARTITION BY viewer_id ORDER BY chain_max) - 1) * 1000 // count(*) OVER v AS pc,
  (rank() OVER (PARTITION BY viewer_id ORDER BY CASE WHEN views = 0 THEN 0 ELSE CAST(night_views AS DOUBLE) / views END) - 1) * 1000 // count(*) OVER v AS pn,
  (rank() OVER (PARTITION BY viewer_id ORDER BY areas) - 1) * 1000 // count(*) OVER v AS pa FROM days WINDOW v AS (PARTITION BY viewer_id)),
peaked AS (SELECT *, CAST(greatest(pv, pc, pn, pa) AS INTEGER) AS peak, CASE WHEN greatest(pv, pc, pn, pa) = 0 THEN NULL WHEN pv = greatest(pv, pc, pn, pa) THEN 'views' WHEN pc = greatest(pv, pc, pn, pa) THEN 'chain' WHEN pn = greatest(pv, pc, pn, pa) THEN 'night' ELSE 'areas' END AS peak_axis FROM r)"""


@register("w8_peaks", sql(DAYS, PEAKED + " SELECT viewer_id, day, peak, peak_axis FROM peaked"))
def w8_peaks(spark, d) -> DataFrame:
    return q.peaks(q.days(line(spark, d, channels=True))).select("viewer_id", "day", "peak", "peak_axis")


@register("a19_transitions", sql(TIMELINE, "SELECT viewer_id, area_before AS from_area, area AS to_area, count(*) AS n, count(DISTINCT day) AS days FROM main WHERE m_place > 1 GROUP BY viewer_id, area_before, area"))
def a19_transitions(spark, d) -> DataFrame:
    """Also A20: on how many days each happened."""
    return q.transitions(line(spark, d))


@register("o6_top_transitions", sql(TIMELINE, "SELECT area_before AS from_area, area AS to_area, count(*) AS n FROM main WHERE m_place > 1 GROUP BY area_before, area ORDER BY n DESC, from_area, to_area LIMIT 60"))
def o6_top_transitions(spark, d) -> DataFrame:
    n = q.transitions(line(spark, d)).groupBy("from_area", "to_area").agg(F.sum("n").alias("n"))
    return n.orderBy(F.col("n").desc(), "from_area", "to_area").limit(60)


@register("a22_headline", sql(DAYS, """, s AS (SELECT viewer_id, session_no, count(*) AS n FROM t GROUP BY ALL),
ls AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY viewer_id ORDER BY n DESC, session_no DESC) = 1),
bd AS (SELECT viewer_id, day, views FROM days QUALIFY row_number() OVER (PARTITION BY viewer_id ORDER BY views DESC, day DESC) = 1),
dp AS (SELECT viewer_id, max(len) AS m, sum(len) AS c FROM chains GROUP BY viewer_id),
de AS (SELECT viewer_id, session_no, start_us FROM chains QUALIFY row_number() OVER (PARTITION BY viewer_id ORDER BY len DESC, start_us DESC, session_no DESC) = 1),
tt AS (SELECT viewer_id, count(*) AS views, count(DISTINCT session_no) AS sessions, count(*) FILTER (WHERE overlap) AS overlap_views, sum(duration_s) AS duration_s FROM t GROUP BY viewer_id)
SELECT tt.viewer_id, tt.views, sessions, overlap_views, CAST(duration_s AS BIGINT) AS duration_s, CAST(ls.session_no AS BIGINT) AS longest_session, ls.n AS longest_views, coalesce(dp.m, 0) AS deepest_chain, CAST(de.session_no AS BIGINT) AS deepest_session, de.start_us AS deepest_start_us, CAST(coalesce(dp.c, 0) AS BIGINT) AS chain_views, bd.day AS busiest_day, bd.views AS busiest_views
FROM tt JOIN ls USING (viewer_id) LEFT JOIN dp USING (viewer_id) LEFT JOIN de ON de.viewer_id = tt.viewer_id JOIN bd ON bd.viewer_id = tt.viewer_id"""))
def a22_headline(spark, d) -> DataFrame:
    return q.headline(line(spark, d)).withColumn("deepest_start_us", US("deepest_started")).drop("deepest_started")


@register("a24_retention", sql(TIMELINE, """, a AS (SELECT viewer_id, area, count(*) AS main, count(*) FILTER (WHERE edge = 'through') AS through, count(*) FILTER (WHERE edge = 'most') AS most, count(*) FILTER (WHERE edge = 'skipped') AS skipped FROM main GROUP BY viewer_id, area)
SELECT *, CAST(main * 1000000 // sum(main) OVER (PARTITION BY viewer_id) AS BIGINT) AS share, CASE WHEN through + most + skipped = 0 THEN 0 ELSE through * 1000000 // (through + most + skipped) END AS held FROM a"""))
def a24_retention(spark, d) -> DataFrame:
    return q.retention(line(spark, d))


@register("a25_positions", sql(TIMELINE, "SELECT viewer_id, CASE WHEN m_place <= 3 THEN CAST(m_place AS VARCHAR) WHEN m_place <= 6 THEN '4-6' WHEN m_place <= 10 THEN '7-10' ELSE '11+' END AS bucket, area, count(*) AS views FROM main GROUP BY ALL"))
def a25_positions(spark, d) -> DataFrame:
    """Also W10: a view's place among its session's main-lane rows."""
    return q.positions(line(spark, d))


@register("a31_first_and_late", sql(TIMELINE, "SELECT area, count(*) FILTER (WHERE m_place = 1) AS first, count(*) FILTER (WHERE m_place >= 7) AS late FROM main GROUP BY area"))
def a31_first_and_late(spark, d) -> DataFrame:
    p = q.positions(line(spark, d))
    pick = lambda *b: F.coalesce(F.sum(F.when(F.col("bucket").isin(*b), F.col("views"))), F.lit(0))
    return p.groupBy("area").agg(pick("1").alias("first"), pick("7-10", "11+").alias("late"))


@register("a26_month_mix", sql(VIEWS, ", f AS (SELECT *, row_number() OVER (PARTITION BY viewer_id, channel_id ORDER BY us, event_id) AS n FROM views) SELECT viewer_id, strftime(watched_at, '%Y-%m') AS month, area, count(*) AS views, count(*) FILTER (WHERE n = 1) AS new_channels FROM f GROUP BY ALL"))
def a26_month_mix(spark, d) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("viewer_id", "channel_id").orderBy("watched_at", "event_id")) == 1
    v = views(spark, d).withColumn("first", first)
    return v.groupBy("viewer_id", F.date_format("watched_at", "yyyy-MM").alias("month"), "area").agg(F.count("*").alias("views"), F.count_if("first").alias("new_channels"))


@register("a27_first_contacts", sql(VIEWS, ", f AS (SELECT *, min(us) OVER (PARTITION BY viewer_id, channel_id) AS f FROM views) SELECT viewer_id, channel_id, min(f) AS first_us, max(us) AS last_us, count(*) AS views, count(*) FILTER (WHERE us - f <= 2592000000000) AS n30 FROM f GROUP BY viewer_id, channel_id"))
def a27_first_contacts(spark, d) -> DataFrame:
    c = q.first_contacts(views(spark, d))
    return c.select("viewer_id", "channel_id", US("first_at").alias("first_us"), US("last_at").alias("last_us"), "views", "n30")


@register("o9_top_contacts", sql(VIEWS, ", f AS (SELECT *, min(us) OVER (PARTITION BY viewer_id, channel_id) AS f FROM views), c AS (SELECT viewer_id, channel_id, min(f) AS first_us, count(*) AS views, count(*) FILTER (WHERE us - f <= 2592000000000) AS n30 FROM f GROUP BY ALL) SELECT * FROM c WHERE n30 > 1 ORDER BY n30 DESC, views DESC, first_us DESC, channel_id LIMIT 30"))
def o9_top_contacts(spark, d) -> DataFrame:
    """Also F10: only channels seen more than once in the window."""
    c = q.first_contacts(views(spark, d)).select("viewer_id", "channel_id", US("first_at").alias("first_us"), "views", "n30")
    return c.filter(F.col("n30") > 1).orderBy(F.col("n30").desc(), F.col("views").desc(), F.col("first_us").desc(), "channel_id").limit(30)


@register("a29_session_areas", sql(TIMELINE, "SELECT viewer_id, CAST(session_no AS BIGINT) AS session_no, area, count(*) AS views, CAST(row_number() OVER (PARTITION BY viewer_id, session_no ORDER BY count(*) DESC, area) AS INTEGER) AS rank FROM main GROUP BY viewer_id, session_no, area"))
def a29_session_areas(spark, d) -> DataFrame:
    return q.session_areas(line(spark, d))


@register("w11_neighbourhood", sql(DAYS, "SELECT viewer_id, day, count(*) OVER n AS near_days, CAST(sum(views) OVER n AS BIGINT) AS near_views, lag(day) OVER w AS day_before, lead(day) OVER w AS day_after FROM days WINDOW w AS (PARTITION BY viewer_id ORDER BY day), n AS (PARTITION BY viewer_id ORDER BY day ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"))
def w11_neighbourhood(spark, d) -> DataFrame:
    """Also W12: the days before and after."""
    return q.neighbourhood(q.days(line(spark, d, channels=True)))


@register("w12_session_neighbours", sql(SESSIONS, """, s AS (SELECT viewer_id, session_no, min(us) AS a FROM sn GROUP BY viewer_id, session_no)
SELECT viewer_id, CAST(session_no AS BIGINT) AS session_no, strftime(make_timestamp(a), '%Y-%m-%d') AS day, lag(a) OVER w AS older_us, lead(a) OVER w AS newer_us FROM s WINDOW w AS (PARTITION BY viewer_id ORDER BY session_no)"""))
def w12_session_neighbours(spark, d) -> DataFrame:
    s = q.session_neighbours(q.sessions(q.sessionize(views(spark, d))))
    return s.select("viewer_id", "session_no", "day", US("older").alias("older_us"), US("newer").alias("newer_us"))


@register("w12_chain_neighbours", sql(CHAINS, "SELECT viewer_id, CAST(session_no AS BIGINT) AS session_no, CAST(ordinal AS INTEGER) AS ordinal, count(*) OVER s AS of, lag(start_us) OVER w AS earlier_us, lead(start_us) OVER w AS later_us FROM chains WINDOW s AS (PARTITION BY viewer_id, session_no), w AS (PARTITION BY viewer_id, session_no ORDER BY ordinal)"))
def w12_chain_neighbours(spark, d) -> DataFrame:
    c = q.chain_neighbours(q.chains(line(spark, d)))
    return c.select("viewer_id", "session_no", "ordinal", "of", US("earlier").alias("earlier_us"), US("later").alias("later_us"))


@register("w13_month_first_days", sql(DAYS, "SELECT viewer_id, substr(day, 1, 7) AS month, min(day) AS first_day FROM days GROUP BY ALL"))
def w13_month_first_days(spark, d) -> DataFrame:
    return q.days(line(spark, d, channels=True)).groupBy("viewer_id", F.substring("day", 1, 7).alias("month")).agg(F.min("day").alias("first_day"))


@register("w14_month_axis", sql(VIEWS, """, m AS (SELECT date_trunc('month', watched_at) AS m, count(*) AS n FROM views GROUP BY 1),
axis AS (SELECT unnest(generate_series((SELECT min(m) FROM m), (SELECT max(m) FROM m), INTERVAL 1 MONTH)) AS m)
SELECT strftime(axis.m, '%Y-%m') AS month, coalesce(n, 0) AS views FROM axis LEFT JOIN m USING (m)"""))
def w14_month_axis(spark, d) -> DataFrame:
    m = views(spark, d).groupBy(F.trunc("watched_at", "month").alias("m")).agg(F.count("*").alias("n"))
    axis = m.agg(F.min("m").alias("a"), F.max("m").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("m"))
    return axis.join(m, "m", "left").select(F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("views"))


@register("w15_day_axis", sql(VIEWS, """, m AS (SELECT CAST(watched_at AS DATE) AS m, count(*) AS n FROM views GROUP BY 1),
axis AS (SELECT CAST(unnest(generate_series((SELECT min(m) FROM m), (SELECT max(m) FROM m), INTERVAL 1 DAY)) AS DATE) AS m)
SELECT strftime(axis.m, '%Y-%m-%d') AS day, coalesce(n, 0) AS views FROM axis LEFT JOIN m USING (m)"""))
def w15_day_axis(spark, d) -> DataFrame:
    m = views(spark, d).groupBy(F.to_date("watched_at").alias("m")).agg(F.count("*").alias("n"))
    axis = m.agg(F.min("m").alias("a"), F.max("m").alias("b")).select(F.explode(F.sequence("a", "b")).alias("m"))
    return axis.join(m, "m", "left").select(F.date_format("m", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("views"))


@register("w16_lenses", sql(DAYS, "SELECT viewer_id, day, " + ", ".join(f"CAST(CASE WHEN max({c}) OVER v = 0 THEN 0 ELSE {c} * 1000 // max({c}) OVER v END AS BIGINT) AS {c}_lens" for c in ("views", "duration_s", "chain_max", "night_views", "areas", "new_channels")) + " FROM days WINDOW v AS (PARTITION BY viewer_id)"))
def w16_lenses(spark, d) -> DataFrame:
    return q.lenses(q.days(line(spark, d, channels=True)))


DAY_VALUE_SQL = {
    "peak": "peak", "views": "views", "chain": "chain_max", "night": "CASE WHEN views > 0 THEN night_views / views ELSE 0 END", "hours": "duration_s", "areas": "areas",
    "held": "CASE WHEN edged > 0 THEN through / edged ELSE -1 END", "new": "new_channels", "date": "epoch_day",
}


@register("o8_day_ranking", sql(DAYS, PEAKED + " " + " UNION ALL ".join(f"(SELECT '{k}' AS key, viewer_id, day, round(CAST({v} AS DOUBLE), 6) AS value, CAST(row_number() OVER (ORDER BY CAST({v} AS DOUBLE) DESC, day DESC, viewer_id) AS INTEGER) AS rank FROM peaked QUALIFY rank <= 60)" for k, v in DAY_VALUE_SQL.items())))
def o8_day_ranking(spark, d) -> DataFrame:
    """The first 60 days by each of nine keys."""
    folder = scratch(spark, "days")
    q.peaks(q.days(line(spark, d, channels=True))).write.parquet(folder)
    x, out = spark.read.parquet(folder), []
    for key in q.DAY_KEYS:
        w = Window.orderBy(F.col("by").desc(), F.col("day").desc(), "viewer_id")  # of 60 rows
        out.append(q.ranked(x, key, q.DAY_KEYS, "day", 60).select(F.lit(key).alias("key"), "viewer_id", "day", F.round("by", 6).alias("value"), F.row_number().over(w).alias("rank")))
    return reduce(DataFrame.unionByName, out)


@register("k5_payload_rows", sql(DAYS, PEAKED + """,
an AS (SELECT area, dense_rank() OVER (ORDER BY area) - 1 AS no FROM (SELECT DISTINCT area FROM views)),
s AS (SELECT viewer_id, session_no, min(us) AS a, max(us) AS b, count(*) AS n FROM t GROUP BY ALL),
so AS (SELECT *, row_number() OVER w - 1 AS ord, row_number() OVER w - 1 + coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, lead(b) OVER w AS pe, min(a) OVER (PARTITION BY viewer_id) AS t0 FROM s WINDOW w AS (PARTITION BY viewer_id ORDER BY session_no DESC)),
tr AS (SELECT viewer_id, area_before AS fa, area AS ta, count(*) AS n FROM main WHERE m_place > 1 GROUP BY ALL)
SELECT viewer_id, 'session' AS kind, ord AS place, concat('[', pos, ',', a // 1000000 - t0 // 1000000, ',', (b - a) // 1000000, ',', n, ',', coalesce((a - pe) // 1000000, 0), ']') AS payload FROM so
UNION ALL SELECT c.viewer_id, 'chain', row_number() OVER (PARTITION BY c.viewer_id ORDER BY c.session_no DESC, chain_no) - 1, concat('[', ord, ',', pos + first_place, ',', pos + last_place, ',', len, ',', no, ',', span_s, ',', duration_s, ']') FROM chains c JOIN so ON so.viewer_id = c.viewer_id AND so.session_no = c.session_no JOIN an ON an.area = c.area
UNION ALL SELECT viewer_id, 'day', row_number() OVER (PARTITION BY viewer_id ORDER BY day) - 1, concat('[', concat_ws(',', epoch_day, views, coalesce(no, -1), session_from, session_to, duration_s, chain_views, chain_max, night_views, areas, through, edged, new_channels, peak, coalesce(list_position(['views', 'chain', 'night', 'areas'], peak_axis) - 1, -1)), ']') FROM peaked LEFT JOIN an ON an.area = peaked.area
UNION ALL SELECT viewer_id, 'transition', row_number() OVER (PARTITION BY viewer_id ORDER BY n DESC, f.no, g.no) - 1, concat('[', f.no, ',', g.no, ',', n, ']') FROM tr JOIN an f ON f.area = fa JOIN an g ON g.area = ta"""))
def k5_payload_rows(spark, d) -> DataFrame:
    """Sessions, chains, days and transitions of each viewer's page; the timeline is written once."""
    folder, v = scratch(spark, "timeline"), views(spark, d)
    q.timeline(v).write.parquet(folder)
    areas = v.select("area").distinct().withColumn("area_no", F.dense_rank().over(Window.orderBy("area")) - 1)  # a row an area
    return payload(spark.read.parquet(folder), areas)


#: Names of a page that stand in dictionaries.
NAMES = ("video_id", "channel", "topic")
FIRSTS = ", ".join(f"d{c} AS (SELECT viewer_id, {c}, row_number() OVER (PARTITION BY viewer_id ORDER BY min(struct_pack(a := us, b := event_id)), {c}) - 1 AS no FROM t GROUP BY viewer_id, {c})" for c in NAMES)


@register("k5_dictionaries", sql(VIEWS, ", t AS (SELECT * FROM views WHERE us IS NOT NULL), " + FIRSTS + " " + " UNION ALL ".join(f"SELECT viewer_id, '{c}' AS kind, no, {c} AS value FROM d{c}" for c in NAMES)))
def k5_dictionaries(spark, d) -> DataFrame:
    """A viewer's videos, channels and topics by first appearance, numbered block by block of time."""
    v = views(spark, d)
    return reduce(DataFrame.unionByName, (dictionary(v, c).select("viewer_id", F.lit(c).alias("kind"), "no", "value") for c in NAMES))


@register("k5_view_rows", sql(TIMELINE, ", " + FIRSTS + """,
s AS (SELECT viewer_id, session_no, min(us) AS a, count(*) AS n FROM t GROUP BY ALL),
so AS (SELECT *, row_number() OVER w - 1 + coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, min(a) OVER (PARTITION BY viewer_id) AS t0 FROM s WINDOW w AS (PARTITION BY viewer_id ORDER BY session_no DESC))
SELECT t.viewer_id, CAST(pos + place AS BIGINT) AS place, concat('[', concat_ws(',', us // 1000000 - t0 // 1000000, v.no, c.no, p.no, duration_s, coalesce(list_position(['through', 'most', 'skipped'], edge) - 1, -1), CAST(overlap AS INTEGER)), ']') AS payload
FROM t JOIN so ON so.viewer_id = t.viewer_id AND so.session_no = t.session_no JOIN dvideo_id v ON v.viewer_id = t.viewer_id AND v.video_id = t.video_id JOIN dchannel c ON c.viewer_id = t.viewer_id AND c.channel = t.channel JOIN dtopic p ON p.viewer_id = t.viewer_id AND p.topic = t.topic"""))
def k5_view_rows(spark, d) -> DataFrame:
    """Each view's positional row, with numbers of the dictionaries for its names."""
    folder = scratch(spark, "timeline")
    q.timeline(views(spark, d), channels=False).write.parquet(folder)
    return view_rows(spark.read.parquet(folder), NAMES)
