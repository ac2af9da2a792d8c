"""Common table expressions for the oracles, in DuckDB's SQL."""

from __future__ import annotations

VIEWS = """
e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
mv AS (SELECT user_id, k, arg_min(value, ts) AS v FROM e GROUP BY user_id, k),
meta AS (
  SELECT user_id, k, CASE WHEN k < 12 THEN 0 ELSE CAST(floor(v * 30) AS BIGINT) END AS duration_s, k < 12 AS unavailable,
    CASE WHEN k <= 3 THEN 'private' WHEN k <= 5 THEN 'removed' WHEN k = 6 THEN 'terminated' WHEN k <= 8 THEN 'unavailable' WHEN k = 9 THEN 'age' WHEN k = 10 THEN 'members' END AS gone_reason
  FROM mv),
views AS (
  SELECT event_id, user_id // 50 AS viewer_id, ts AS watched_at, epoch_us(ts) AS us, user_id AS channel_id, 'channel-' || user_id AS channel,
    'v' || user_id || '_' || k AS video_id, event_type AS area, CASE WHEN k % 10 <> 0 THEN 's' || (k // 10) END AS sub,
    event_type || CASE WHEN k % 10 <> 0 THEN '/s' || (k // 10) ELSE '' END AS topic,
    CASE k % 4 WHEN 0 THEN 'consume' WHEN 1 THEN 'learn' WHEN 2 THEN 'mixed' END AS mode,
    CASE WHEN k % 5 = 0 THEN 'rule:r1' WHEN k % 5 <= 2 THEN 'llm:m1' WHEN k % 5 = 3 THEN 'category' ELSE 'unclassified' END AS source,
    k / 100.0 AS confidence, duration_s, unavailable, gone_reason, k
  FROM e JOIN meta USING (user_id, k)),
subs AS (SELECT c_custkey AS channel_id, c_name AS title FROM customer WHERE c_custkey % 7 = 0)
"""

SESSIONS = VIEWS + """,
g AS (SELECT *, lag(us) OVER (PARTITION BY viewer_id ORDER BY us, event_id) AS before FROM views WHERE us IS NOT NULL),
sn AS (SELECT *, sum(CASE WHEN before IS NULL OR us - before > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY viewer_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g),
ed AS (
  SELECT *, (lead(us) OVER w - us) // 1000000 AS gap_s, row_number() OVER w AS place, min(us) OVER (PARTITION BY viewer_id, session_no) AS start_us
  FROM sn WINDOW w AS (PARTITION BY viewer_id, session_no ORDER BY us, event_id)),
edges AS (SELECT *, CASE WHEN gap_s IS NULL OR duration_s <= 0 THEN NULL WHEN gap_s >= duration_s THEN 'through' WHEN 2 * gap_s < duration_s THEN 'skipped' ELSE 'most' END AS edge,
  strftime(make_timestamp(start_us), '%Y-%m-%d') AS day FROM ed)
"""

TIMELINE = SESSIONS + """,
fold AS (
  SELECT viewer_id, session_no, place, false AS overlap, us + duration_s * 1000000 AS run_end, area AS run_area, duration_s AS run_dur FROM edges WHERE place = 1
  UNION ALL
  SELECT x.viewer_id, x.session_no, x.place, f.run_dur >= 1200 AND x.us < f.run_end AND x.area <> f.run_area,
    CASE WHEN f.run_dur >= 1200 AND x.us < f.run_end AND x.area <> f.run_area THEN f.run_end ELSE x.us + x.duration_s * 1000000 END,
    CASE WHEN f.run_dur >= 1200 AND x.us < f.run_end AND x.area <> f.run_area THEN f.run_area ELSE x.area END,
    CASE WHEN f.run_dur >= 1200 AND x.us < f.run_end AND x.area <> f.run_area THEN f.run_dur ELSE x.duration_s END
  FROM fold f JOIN edges x ON x.viewer_id = f.viewer_id AND x.session_no = f.session_no AND x.place = f.place + 1),
t AS (SELECT x.*, f.overlap FROM edges x JOIN fold f USING (viewer_id, session_no, place)),
main AS (
  SELECT *, lag(us) OVER w AS m_before, lag(area) OVER w AS area_before, row_number() OVER w AS m_place FROM t WHERE NOT overlap
  WINDOW w AS (PARTITION BY viewer_id, session_no ORDER BY us, event_id)),
isl AS (SELECT *, sum(CASE WHEN m_before IS NULL OR area_before <> area OR us - m_before > 900000000 THEN 1 ELSE 0 END) OVER (PARTITION BY viewer_id, session_no ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS chain_no FROM main),
chain_rows AS (SELECT *, count(*) OVER (PARTITION BY viewer_id, session_no, chain_no) AS chain_len FROM isl)
"""

CHAINS = TIMELINE + """,
ch AS (
  SELECT viewer_id, session_no, chain_no, count(*) AS len, min(area) AS area, min(place) AS first_place, max(place) AS last_place, min(us) AS start_us, max(us) AS end_us,
    arg_min(coalesce(area_before, ''), place) AS door, count(DISTINCT channel_id) AS channels, count(*) FILTER (WHERE edge = 'through') AS held, count(edge) AS edged, min(day) AS day
  FROM chain_rows WHERE chain_len >= 4 GROUP BY viewer_id, session_no, chain_no),
ce AS (SELECT viewer_id, session_no, chain_no, arg_max(edge, place) AS exit_edge FROM chain_rows WHERE chain_len >= 4 AND edge IS NOT NULL GROUP BY viewer_id, session_no, chain_no),
cd AS (SELECT ch.viewer_id, ch.session_no, ch.chain_no, sum(t.duration_s) AS duration_s FROM ch JOIN t ON t.viewer_id = ch.viewer_id AND t.session_no = ch.session_no AND t.place BETWEEN first_place AND last_place GROUP BY ALL),
chains AS (
  SELECT ch.*, ce.exit_edge, cd.duration_s, (end_us - start_us) // 1000000 AS span_s, row_number() OVER (PARTITION BY ch.viewer_id, ch.session_no ORDER BY ch.chain_no) AS ordinal
  FROM ch JOIN cd USING (viewer_id, session_no, chain_no) LEFT JOIN ce USING (viewer_id, session_no, chain_no))
"""

DAYS = CHAINS + """,
fc AS (SELECT event_id, row_number() OVER (PARTITION BY viewer_id, channel_id ORDER BY us, event_id) = 1 AS new_channel FROM t),
ic AS (SELECT event_id FROM chain_rows WHERE chain_len >= 4),
dv AS (SELECT t.*, fc.new_channel, ic.event_id IS NOT NULL AS in_chain, hour(watched_at) AS hh FROM t JOIN fc USING (event_id) LEFT JOIN ic USING (event_id)),
da AS (SELECT viewer_id, day, area, row_number() OVER (PARTITION BY viewer_id, day ORDER BY count(*) DESC, area) AS n FROM dv WHERE NOT overlap GROUP BY viewer_id, day, area),
d0 AS (
  SELECT viewer_id, day, count(*) AS views, sum(duration_s) AS duration_s, count(DISTINCT session_no) AS sessions, min(session_no) AS session_from, max(session_no) AS session_to,
    count(DISTINCT area) FILTER (WHERE NOT overlap) AS areas, count(*) FILTER (WHERE NOT overlap AND in_chain) AS chain_views,
    count(*) FILTER (WHERE NOT overlap AND (hh >= 23 OR hh < 5)) AS night_views, count(*) FILTER (WHERE NOT overlap AND edge = 'through') AS through,
    count(*) FILTER (WHERE NOT overlap AND edge IS NOT NULL) AS edged, count(*) FILTER (WHERE new_channel) AS new_channels
  FROM dv GROUP BY viewer_id, day),
dc AS (SELECT viewer_id, day, max(len) AS chain_max FROM chains GROUP BY viewer_id, day),
days AS (
  SELECT d0.*, da.area, coalesce(dc.chain_max, 0) AS chain_max, date_diff('day', DATE '1970-01-01', CAST(d0.day AS DATE)) AS epoch_day
  FROM d0 LEFT JOIN da ON da.viewer_id = d0.viewer_id AND da.day = d0.day AND da.n = 1 LEFT JOIN dc ON dc.viewer_id = d0.viewer_id AND dc.day = d0.day)
"""


def sql(ctes: str, body: str) -> str:
    recursive = "RECURSIVE " if "fold AS" in ctes else ""
    return f"WITH {recursive}{ctes}{body if body.startswith(',') else chr(10) + body}"
