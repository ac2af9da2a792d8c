"""Report queries: headline, topics, months, channels, subscriptions, tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import report as q
from ..operators.sequence import timeline
from ..operators.summary import report_lines
from ..sources.events import subscriptions, views
from .catalog import register
from .oracle import VIEWS, sql

US = F.unix_micros


@register("a2_history", sql(VIEWS, "SELECT count(*) AS views, count(DISTINCT video_id) AS videos, min(us) AS first_us, max(us) AS last_us FROM views"))
def a2_history(spark, d) -> DataFrame:
    return views(spark, d).agg(F.count("*").alias("views"), F.count_distinct("video_id").alias("videos"), US(F.min("watched_at")).alias("first_us"), US(F.max("watched_at")).alias("last_us"))


@register("a3_report_headline", sql(VIEWS, "SELECT count(*) AS views, count(DISTINCT nullif(video_id, '')) AS videos, CAST(sum(duration_s) AS BIGINT) AS duration_s, count(*) FILTER (WHERE coalesce(video_id, '') = '') AS no_id, count(*) FILTER (WHERE unavailable) AS unavailable, min(us) AS from_us, max(us) AS to_us FROM views"))
def a3_report_headline(spark, d) -> DataFrame:
    return q.headline(views(spark, d)).withColumn("from_us", US("from_at")).withColumn("to_us", US("to_at")).drop("from_at", "to_at")


@register("a4_gone_reasons", sql(VIEWS, "SELECT coalesce(nullif(gone_reason, ''), 'unknown') AS reason, count(*) AS views FROM views WHERE unavailable GROUP BY 1"))
def a4_gone_reasons(spark, d) -> DataFrame:
    return q.gone_reasons(views(spark, d))


@register("a5_sources", sql(VIEWS, "SELECT CASE WHEN source LIKE 'rule:%' THEN 'rule' WHEN source LIKE 'llm:%' THEN 'llm' WHEN source = 'category' THEN 'category' ELSE 'unclassified' END AS bucket, count(*) AS views FROM views GROUP BY 1"))
def a5_sources(spark, d) -> DataFrame:
    return views(spark, d).groupBy(q.source_bucket("source").alias("bucket")).agg(F.count("*").alias("views"))


@register("a6_topics", sql(VIEWS, """, x AS (SELECT area, sub, duration_s, coalesce(mode, 'unclear') AS mode FROM views),
m AS (SELECT area, sub, mode, count(*) AS n FROM x GROUP BY ALL),
ma AS (SELECT area, mode FROM (SELECT area, mode, sum(n) AS n FROM m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY area ORDER BY n DESC, mode) = 1),
ms AS (SELECT area, sub, mode FROM m WHERE sub IS NOT NULL QUALIFY row_number() OVER (PARTITION BY area, sub ORDER BY n DESC, mode) = 1)
SELECT x.area, NULL AS sub, count(*) AS views, CAST(sum(duration_s) AS BIGINT) AS duration_s, min(ma.mode) AS mode FROM x JOIN ma USING (area) GROUP BY x.area
UNION ALL SELECT x.area, x.sub, count(*), CAST(sum(duration_s) AS BIGINT), min(ms.mode) FROM x JOIN ms ON ms.area = x.area AND ms.sub = x.sub GROUP BY x.area, x.sub"""))
def a6_topics(spark, d) -> DataFrame:
    """Also A7: the commonest mode, the least name on ties."""
    return q.topic_rollup(views(spark, d))


@register("a8_months", sql(VIEWS, "SELECT strftime(watched_at, '%Y-%m') AS month, " + ", ".join(f"count(*) FILTER (WHERE coalesce(mode, 'unclear') = '{m}') AS {m}_views, CAST(coalesce(sum(CASE WHEN k % 9 <> 4 THEN duration_s END) FILTER (WHERE coalesce(mode, 'unclear') = '{m}'), 0) AS BIGINT) AS {m}_seconds" for m in q.MODES) + " FROM views GROUP BY 1"))
def a8_months(spark, d) -> DataFrame:
    """Lengths of some views are unknown here: they count as views of no length."""
    unknown = F.round(F.col("confidence") * 100).cast("int") % 9 == 4
    return q.months(views(spark, d).withColumn("duration_s", F.when(~unknown, F.col("duration_s"))))


@register("a9_channels", sql(VIEWS, """, tt AS (SELECT channel, channel_id, topic FROM views GROUP BY channel, channel_id, topic QUALIFY row_number() OVER (PARTITION BY channel, channel_id ORDER BY count(*) DESC, topic) = 1)
SELECT v.channel, v.channel_id, count(*) AS views, CAST(sum(duration_s) AS BIGINT) AS duration_s, min(tt.topic) AS top_topic, v.channel_id IN (SELECT channel_id FROM subs) AS subscribed FROM views v JOIN tt USING (channel, channel_id) GROUP BY v.channel, v.channel_id"""))
def a9_channels(spark, d) -> DataFrame:
    """Also J3: the subscription flag."""
    return q.channels(views(spark, d), subscriptions(spark, d))


@register("o3_top_channels", sql(VIEWS, "SELECT channel, channel_id, count(*) AS views FROM views GROUP BY channel, channel_id ORDER BY views DESC, channel, channel_id LIMIT 25"))
def o3_top_channels(spark, d) -> DataFrame:
    """Also O1 and O2: count first, then name, then id."""
    n = views(spark, d).groupBy("channel", "channel_id").agg(F.count("*").alias("views"))
    return q.top_k(n, [], [F.col("views").desc(), "channel", "channel_id"], 25)


@register("a10_subscriptions", sql(VIEWS, """, w AS (SELECT channel_id, count(*) AS views, CAST(sum(duration_s) AS BIGINT) AS duration_s, max(us) AS last_us FROM views GROUP BY channel_id),
tt AS (SELECT channel_id, topic FROM views GROUP BY channel_id, topic QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY count(*) DESC, topic) = 1)
SELECT s.channel_id, title, coalesce(views, 0) AS views, coalesce(duration_s, 0) AS duration_s, last_us, topic AS top_topic, views IS NULL AS dead FROM subs s LEFT JOIN w USING (channel_id) LEFT JOIN tt USING (channel_id)"""))
def a10_subscriptions(spark, d) -> DataFrame:
    """Also J4: left join to the watched channels."""
    rows = q.subscription_rows(views(spark, d), subscriptions(spark, d))
    return rows.withColumn("last_us", US("last_at")).drop("last_at")


@register("j4_dead_subscriptions", sql(VIEWS, "SELECT channel_id, title FROM subs WHERE channel_id NOT IN (SELECT channel_id FROM views)"))
def j4_dead_subscriptions(spark, d) -> DataFrame:
    return subscriptions(spark, d).join(views(spark, d).select("channel_id"), "channel_id", "left_anti")


@register("a11_unclear_channels", sql(VIEWS, "SELECT channel, count(*) AS views FROM views WHERE source = 'unclassified' GROUP BY channel ORDER BY views DESC, channel LIMIT 15"))
def a11_unclear_channels(spark, d) -> DataFrame:
    n = views(spark, d).filter("source = 'unclassified'").groupBy("channel").agg(F.count("*").alias("views"))
    return q.top_k(n, [], [F.col("views").desc(), "channel"], 15)


@register("a21_topic_tree", sql(VIEWS, ", n AS (SELECT viewer_id, area, coalesce(sub, '(no subject)') AS sub, coalesce(channel, '(no channel)') AS channel, duration_s FROM views) SELECT viewer_id, area, sub, channel, count(*) AS views, CAST(sum(duration_s) AS BIGINT) AS duration_s FROM n GROUP BY GROUPING SETS ((viewer_id, area), (viewer_id, area, sub), (viewer_id, area, sub, channel))"))
def a21_topic_tree(spark, d) -> DataFrame:
    return q.topic_tree(views(spark, d))


@register("w17_shares", sql(VIEWS, ", n AS (SELECT area, coalesce(sub, '(no subject)') AS sub, count(*) AS views FROM views GROUP BY ALL) SELECT area, sub, views, CAST(views * 1000000 // sum(views) OVER (PARTITION BY area) AS BIGINT) AS of_parent, CAST(views * 1000000 // sum(views) OVER () AS BIGINT) AS of_all FROM n"))
def w17_shares(spark, d) -> DataFrame:
    n = views(spark, d).groupBy("area", F.coalesce("sub", F.lit(q.NO_SUBJECT)).alias("sub")).agg(F.count("*").alias("views"))
    all_views = n.agg(F.sum("views").alias("_all"))  # one row
    share = lambda of: F.floor(F.col("views") * 1_000_000 / of).cast("long")
    return n.crossJoin(F.broadcast(all_views)).select("area", "sub", "views", share(F.sum("views").over(Window.partitionBy("area"))).alias("of_parent"), share(F.col("_all")).alias("of_all"))


@register("f6_topic_list", sql(VIEWS, "SELECT event_id, area, coalesce(sub, '(no subject)') AS sub FROM views WHERE (area = 'click' AND sub IS NULL) OR (area = 'view' AND sub = 's3')"))
def f6_topic_list(spark, d) -> DataFrame:
    sub = F.coalesce("sub", F.lit(q.NO_SUBJECT))
    v = views(spark, d)
    return v.filter(((F.col("area") == "click") & (sub == q.NO_SUBJECT)) | ((F.col("area") == "view") & (sub == "s3"))).select("event_id", "area", sub.alias("sub"))


@register("o13_sparkline_areas", sql(VIEWS, ", a AS (SELECT area FROM views GROUP BY area ORDER BY count(*) DESC, area LIMIT 12) SELECT strftime(watched_at, '%Y-%m-%d') AS day, area, count(*) AS views FROM views JOIN a USING (area) GROUP BY ALL"))
def o13_sparkline_areas(spark, d) -> DataFrame:
    v = views(spark, d)
    top = q.top_k(v.groupBy("area").agg(F.count("*").alias("n")), [], [F.col("n").desc(), "area"], 12)
    return v.join(F.broadcast(top.select("area")), "area").groupBy(F.date_format("watched_at", "yyyy-MM-dd").alias("day"), "area").agg(F.count("*").alias("views"))


@register("o15_topics_with_rest", sql(VIEWS, """, n AS (SELECT area, sub, count(*) AS views FROM views WHERE sub IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY views DESC, sub) AS k FROM n)
SELECT area, CASE WHEN k <= 6 THEN sub ELSE '+more' END AS sub, CAST(sum(views) AS BIGINT) AS views, count(*) AS subjects FROM r GROUP BY 1, 2"""))
def o15_topics_with_rest(spark, d) -> DataFrame:
    """Also K7: the six most-watched subjects of an area and what is left."""
    n = views(spark, d).filter("sub IS NOT NULL").groupBy("area", "sub").agg(F.count("*").alias("views"))
    k = F.row_number().over(Window.partitionBy("area").orderBy(F.col("views").desc(), "sub"))
    return n.withColumn("k", k).groupBy("area", F.when(F.col("k") <= 6, F.col("sub")).otherwise("+more").alias("sub")).agg(F.sum("views").alias("views"), F.count("*").alias("subjects"))


@register("k8_import_guard", sql(VIEWS, ", o AS (SELECT count(*) AS n, min(us) AS m FROM views), w AS (SELECT count(*) AS n, min(us) AS m FROM views WHERE event_id % 10 <> 0) SELECT w.n < o.n AS fewer, w.m > o.m AS later FROM o, w"))
def k8_import_guard(spark, d) -> DataFrame:
    """Also J11: an import that would lose history is told apart by two aggregates."""
    from ..sources.export import lost_history

    v = views(spark, d)
    return lost_history(v, v.filter("event_id % 10 <> 0"))


@register("k5_payload", sql(VIEWS, ", a AS (SELECT area, dense_rank() OVER (ORDER BY area) - 1 AS area_no FROM (SELECT DISTINCT area FROM views)) SELECT event_id, concat('[', us // 1000000, ',', area_no, ',', duration_s, ']') AS payload FROM views JOIN a USING (area)"))
def k5_payload(spark, d) -> DataFrame:
    """Positional rows with a dictionary-encoded area."""
    v = timeline(views(spark, d))
    names = v.select("area").distinct()
    numbered = names.withColumn("area_no", F.dense_rank().over(Window.orderBy("area")) - 1)  # a row an area
    row = F.array(F.unix_seconds("watched_at"), F.col("area_no").cast("long"), F.col("duration_s"))
    return v.join(F.broadcast(numbered), "area").select("event_id", F.to_json(row).alias("payload"))


@register("k7_report_lines", sql(VIEWS, """, x AS (SELECT *, coalesce(mode, 'unclear') AS md FROM views), h AS (SELECT count(*) AS n, count(DISTINCT video_id) AS v, sum(duration_s) AS s, count(*) FILTER (WHERE unavailable) AS g, min(watched_at) AS a, max(watched_at) AS b FROM x),
gr AS (SELECT coalesce(gone_reason, 'unknown') AS reason, count(*) AS n FROM x WHERE unavailable GROUP BY 1), go AS (SELECT *, list_position(['private', 'removed', 'terminated', 'unavailable', 'age', 'members', 'unknown'], reason) AS o FROM gr),
am AS (SELECT area, md FROM x GROUP BY area, md QUALIFY row_number() OVER (PARTITION BY area ORDER BY count(*) DESC, md) = 1),
ar AS (SELECT area, count(*) AS n, sum(duration_s) AS s, row_number() OVER (ORDER BY count(*) DESC, area) AS place, max(count(*)) OVER () AS most FROM x GROUP BY area),
sb AS (SELECT area, sub, count(*) AS n, row_number() OVER (PARTITION BY area ORDER BY count(*) DESC, sub) AS k FROM x WHERE sub IS NOT NULL GROUP BY area, sub),
sl AS (SELECT area, string_agg(sub || ' ' || n, ', ' ORDER BY k) FILTER (WHERE k <= 6) AS words, count(*) FILTER (WHERE k > 6) AS rest FROM sb GROUP BY area),
sv AS (SELECT channel_id, count(*) AS n, sum(duration_s) AS s FROM x GROUP BY channel_id), so AS (SELECT count(*) AS n, count(*) FILTER (WHERE sv.n IS NULL) AS dead, coalesce(sum(sv.n), 0) AS own, coalesce(sum(sv.s), 0) AS own_s FROM subs LEFT JOIN sv USING (channel_id))
SELECT 'headline' AS section, CAST(1 AS BIGINT) AS place, n || ' views of ' || v || ' videos, at most ' || printf('%.1f', s / 3600.0) || ' h, from ' || strftime(a, '%Y-%m-%d') || ' to ' || strftime(b, '%Y-%m-%d') AS text FROM h
UNION ALL SELECT 'sources', 1, 'judged by rules ' || count(*) FILTER (WHERE source LIKE 'rule:%') || ', by a model ' || count(*) FILTER (WHERE source LIKE 'llm:%') || ', by category alone ' || count(*) FILTER (WHERE source = 'category') || ', open ' || count(*) FILTER (WHERE source = 'unclassified') FROM x
UNION ALL SELECT 'gone', 1, 'gone: ' || g || ' views, ' || CAST(round(g * 100.0 / n) AS BIGINT) || ' %: ' || (SELECT string_agg(reason || ' ' || n, ', ' ORDER BY o) FROM go) FROM h WHERE g > 0
UNION ALL SELECT 'gone', 2, 'locked, not deleted: ' || sum(n) FROM go WHERE reason IN ('age', 'members') HAVING sum(n) > 0
UNION ALL SELECT 'topics', place * 2 - 1, ar.area || ' (' || md || '): ' || n || ' views, at most ' || printf('%.1f', s / 3600.0) || ' h ' || repeat('#', CAST(1 + n * 24 // most AS INTEGER)) FROM ar JOIN am ON am.area = ar.area WHERE place <= 12
UNION ALL SELECT 'topics', 25, 'and ' || (count(*) - 12) || ' more' FROM ar HAVING count(*) > 12
UNION ALL SELECT 'topics', place * 2, '  ' || words || CASE WHEN rest > 0 THEN ', +' || rest || ' more' ELSE '' END FROM sl JOIN ar ON ar.area = sl.area WHERE place <= 12
UNION ALL SELECT 'modes', 1, 'modes: ' || (SELECT string_agg(md || ' ' || CAST(round(c * 100.0 / (SELECT n FROM h)) AS BIGINT) || ' %', ', ' ORDER BY list_position(['consume', 'learn', 'mixed', 'unclear'], md)) FROM (SELECT md, count(*) AS c FROM x GROUP BY md))
UNION ALL SELECT 'subscriptions', 1, so.n || ' subscriptions, ' || dead || ' never watched; ' || CAST(round(own * 100.0 / h.n) AS BIGINT) || ' % of views, ' || CAST(round(own_s * 100.0 / h.s) AS BIGINT) || ' % of hours' FROM so, h WHERE so.n > 0"""))
def k7_report_lines(spark, d) -> DataFrame:
    return report_lines(views(spark, d), subscriptions(spark, d))
