"""Queries of the scalar functions, over the text columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.events import table, views
from .catalog import register
from .oracle import VIEWS, sql

AREAS = ["PROMO", "STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "unclear"]
ALIASES = {"brushed-brass": "brass", "polished-tin": "tin"}

EMPTY = ", ".join(f"'{x}'" for x in t.EMPTY_SUBS)
TITLE = "CASE p_partkey % 4 WHEN 0 THEN concat('Watched ', p_name) WHEN 1 THEN concat('Angesehen: ', p_name) WHEN 2 THEN concat(p_name, ' angesehen') ELSE p_name END"
URL = "CASE p_partkey % 8 WHEN 0 THEN concat('https://www.youtube.com/watch?v=k', p_partkey) WHEN 1 THEN concat('https://youtu.be/k', p_partkey, '/') WHEN 2 THEN concat('https://m.youtube.com/shorts/k', p_partkey) WHEN 3 THEN concat('https://www.youtube.com/live/k', p_partkey, '/x') WHEN 4 THEN concat('https://youtube.com/embed/k', p_partkey) WHEN 5 THEN concat('https://notyoutube.com/watch?v=k', p_partkey) WHEN 6 THEN concat('https://example.com/watch?v=k', p_partkey) ELSE 'https://www.youtube.com/channel/UC1/videos' END"
CHANNEL = "CASE p_partkey % 3 WHEN 0 THEN concat('https://www.youtube.com/channel/UC', p_partkey, '/x') WHEN 1 THEN concat('http://www.youtube.com/channel/UC', p_partkey) ELSE concat('https://www.youtube.com/channel/UC', p_partkey) END"
TOPIC = "CASE p_partkey % 5 WHEN 0 THEN concat(p_type, '/', p_name) WHEN 1 THEN 'promo/General' WHEN 2 THEN concat('Standard/', p_type) WHEN 3 THEN 'nowhere/x' ELSE concat('small/Brushed ', 'Brass') END"
SLUG = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
SLUG24 = f"regexp_replace(substr({SLUG}, 1, 24), '-+$', '')"


def parts(spark, d) -> DataFrame:
    return table(spark, d, "part")


@register("p1_clean_title", f"SELECT p_partkey, CASE WHEN x LIKE 'Watched %' THEN substr(x, 9) WHEN x LIKE 'Angesehen: %' THEN substr(x, 12) WHEN x LIKE '% angesehen' THEN substr(x, 1, length(x) - 10) ELSE x END AS title FROM (SELECT p_partkey, {TITLE} AS x FROM part)")
def p1_clean_title(spark, d) -> DataFrame:
    return parts(spark, d).select("p_partkey", t.clean_title(F.expr(TITLE)).alias("title"))


@register("p2_video_id", f"""SELECT p_partkey, CASE WHEN host = 'youtu.be' THEN trim(path, '/') WHEN host LIKE '%youtube.com' THEN
  CASE WHEN v <> '' THEN v ELSE regexp_extract(path, '^/(?:shorts|live|embed)/([^/]*)', 1) END ELSE '' END AS video_id
FROM (SELECT p_partkey, regexp_replace(lower(regexp_extract(u, '^https?://([^/?#]*)', 1)), '^www\\.', '') AS host, regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '[?&]v=([^&#]*)', 1) AS v FROM (SELECT p_partkey, {URL} AS u FROM part))""")
def p2_video_id(spark, d) -> DataFrame:
    return parts(spark, d).select("p_partkey", t.video_id(F.expr(URL)).alias("video_id"))


@register("p3_channel_id", f"SELECT p_partkey, regexp_extract({CHANNEL}, '^https://www\\.youtube\\.com/channel/([^/]*)', 1) AS channel_id FROM part")
def p3_channel_id(spark, d) -> DataFrame:
    return parts(spark, d).select("p_partkey", t.channel_id_from_url(F.expr(CHANNEL)).alias("channel_id"))


@register("p4_channel_key", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END, ''), nullif(lower(trim(concat(' ', p_name, ' '))), '')) AS key FROM part")
def p4_channel_key(spark, d) -> DataFrame:
    return parts(spark, d).select("p_partkey", t.channel_key(F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END"), F.expr("concat(' ', p_name, ' ')")).alias("key"))


TIME = "CASE event_id % 4 WHEN 0 THEN '2026-07-02T10:00:00Z' WHEN 1 THEN '2026-07-02' WHEN 2 THEN '2026-07-02T10:00:00.25+02:00' ELSE 'yesterday' END"


@register("p7_rfc3339", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1782986400000000 WHEN 2 THEN 1782979200250000 END AS us FROM events")
def p7_rfc3339(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.unix_micros(t.rfc3339(F.expr(TIME))).alias("us"))


@register("p8_slug", f"SELECT p_partkey, {SLUG.format('p_type')} AS area_slug, {SLUG24.format('p_name')} AS sub_slug FROM part")
def p8_slug(spark, d) -> DataFrame:
    return parts(spark, d).select("p_partkey", t.slug("p_type").alias("area_slug"), t.slug("p_name", 24).alias("sub_slug"))


NORMAL = f"""SELECT p_partkey, x, CASE WHEN area IS NULL THEN NULL WHEN sub = '' OR sub IN ({EMPTY}) OR sub = lower(area) OR area = 'unclear' THEN area ELSE concat(area, '/', sub) END AS topic
FROM (SELECT p_partkey, x, CASE lower(trim(split_part(x, '/', 1))) {" ".join(f"WHEN '{a.lower()}' THEN '{a}'" for a in AREAS)} END AS area, CASE {SLUG24.format("CASE WHEN instr(x, '/') > 0 THEN substr(x, instr(x, '/') + 1) ELSE '' END")} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())} ELSE {SLUG24.format("CASE WHEN instr(x, '/') > 0 THEN substr(x, instr(x, '/') + 1) ELSE '' END")} END AS sub FROM (SELECT p_partkey, {TOPIC} AS x FROM part))"""


@register("p9_normalize_topic", f"SELECT p_partkey, topic FROM ({NORMAL})")
def p9_normalize_topic(spark, d) -> DataFrame:
    return parts(spark, d).select("p_partkey", t.normalize_topic(F.expr(TOPIC), AREAS, ALIASES).alias("topic"))


@register("p10_split_topic", f"SELECT p_partkey, split_part(x, '/', 1) AS area, CASE WHEN instr(x, '/') > 0 THEN substr(x, instr(x, '/') + 1) ELSE '' END AS sub FROM (SELECT p_partkey, {TOPIC} AS x FROM part)")
def p10_split_topic(spark, d) -> DataFrame:
    x = F.expr(TOPIC)
    return parts(spark, d).select("p_partkey", t.area_of(x).alias("area"), t.sub_of(x).alias("sub"))


@register("p11_replace_area", f"SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN x WHEN sub = '' OR sub IN ({EMPTY}) OR sub = 'large' THEN 'LARGE' ELSE concat('LARGE/', sub) END AS topic FROM (SELECT p_partkey, x, CASE {SLUG24.format('s')} WHEN 'brushed-brass' THEN 'brass' WHEN 'polished-tin' THEN 'tin' ELSE {SLUG24.format('s')} END AS sub FROM (SELECT p_partkey, x, CASE WHEN instr(x, '/') > 0 THEN substr(x, instr(x, '/') + 1) ELSE '' END AS s FROM (SELECT p_partkey, {TOPIC} AS x FROM part)))")
def p11_replace_area(spark, d) -> DataFrame:
    area = F.when(F.col("p_partkey") % 7 == 0, "nowhere").otherwise("large")
    return parts(spark, d).select("p_partkey", t.replace_area(F.expr(TOPIC), area, AREAS, ALIASES).alias("topic"))


@register("p12_category_area", "SELECT p_partkey, CASE lower(p_brand) WHEN 'brand#11' THEN 'brand-11' WHEN 'brand#12' THEN 'brand-12' END AS area, p_brand AS category FROM part")
def p12_category_area(spark, d) -> DataFrame:
    """Also P13: the first category that isn't blank."""
    first = t.first_category(F.array(F.lit(" "), F.col("p_brand")))
    return parts(spark, d).select("p_partkey", t.area_for_category(first, ["brand-11", "brand-12"]).alias("area"), first.alias("category"))


@register("p14_fingerprint", "SELECT r_regionkey, substr(sha256(concat('a', chr(0), r_name, chr(30), 'b', chr(0), 'second')), 1, 8) AS fingerprint FROM region")
def p14_fingerprint(spark, d) -> DataFrame:
    pairs = F.array(F.struct(F.lit("b").alias("id"), F.lit("second").alias("description")), F.struct(F.lit("a").alias("id"), F.col("r_name").alias("description")))
    return table(spark, d, "region").select("r_regionkey", t.fingerprint_of(pairs).alias("fingerprint"))


@register("p15_hue", "SELECT n_name, CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(n_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: ((xor(h, b)) * 16777619) & 4294967295) % 360 AS INTEGER) AS hue FROM nation")
def p15_hue(spark, d) -> DataFrame:
    return table(spark, d, "nation").select("n_name", t.hue("n_name").alias("hue"))


@register("p16_norm_tags", "SELECT p_partkey, list_aggregate(list_filter([lower(trim(p_type)), '', lower(p_brand)], lambda x: x <> ''), 'string_agg', '|') AS tags FROM part")
def p16_norm_tags(spark, d) -> DataFrame:
    tags = t.norm_tags(F.array(F.concat(F.lit(" "), "p_type"), F.lit("  "), F.col("p_brand"), F.upper("p_type")))
    return parts(spark, d).select("p_partkey", F.array_join(tags, "|").alias("tags"))


@register("p17_wall_clock", "SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) AS INTEGER) AS hour, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch_day FROM events")
def p17_wall_clock(spark, d) -> DataFrame:
    """Also P18: the epoch day of the local date."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.date_format(ts, "yyyy-MM").alias("month"), F.date_format(ts, "yyyy-MM-dd").alias("day"), F.hour(ts).alias("hour"), F.unix_date(F.to_date(ts)).alias("epoch_day"))


@register("p20_percent", sql(VIEWS, "SELECT viewer_id, round(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (WHERE unavailable) * 100.0 / count(*) END, 6) AS pct FROM views GROUP BY viewer_id"))
def p20_percent(spark, d) -> DataFrame:
    return views(spark, d).groupBy("viewer_id").agg(F.count_if("unavailable").alias("a"), F.count("*").alias("b")).select("viewer_id", F.round(t.percent("a", "b"), 6).alias("pct"))


@register("p21_duration_prune", "SELECT event_id, CAST(trunc(value) AS INTEGER) AS duration_s FROM events")
def p21_duration_prune(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("value").cast("int").alias("duration_s"))


@register("p22_usable_text", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN true ELSE NOT (url LIKE 'http%') END AS usable FROM pages")
def p22_usable_text(spark, d) -> DataFrame:
    channel = F.when(F.col("page_id") % 3 == 0, "c").otherwise("")
    return table(spark, d, "pages").select("page_id", t.has_usable_text("url", channel).alias("usable"))


STALE = "k % 3 = 0"


@register("p23_stale", sql(VIEWS, "SELECT event_id, (k % 3 <> 0) OR (k % 2 = 1 AND k % 5 <> 4 AND NOT unavailable) AS stale FROM views"))
def p23_stale(spark, d) -> DataFrame:
    v = views(spark, d).withColumn("k", F.round(F.col("confidence") * 100).cast("int"))
    return v.select("event_id", t.stale(F.when(F.col("k") % 3 == 0, "f1").otherwise(""), F.when(F.col("k") % 2 == 0, "full").otherwise("title"), F.col("k") % 5 != 4, "unavailable", "f1").alias("stale"))


@register("p24_gone_reason", sql(VIEWS, "SELECT event_id, coalesce(gone_reason, '') IN ('age', 'members', 'private') AS locked_or_private, coalesce(gone_reason, '') = '' AS is_unknown FROM views WHERE unavailable"))
def p24_gone_reason(spark, d) -> DataFrame:
    v = views(spark, d).filter("unavailable")
    return v.select("event_id", t.matches_gone_reason(F.lit("locked, private"), "gone_reason").alias("locked_or_private"), t.matches_gone_reason(F.lit("unknown"), "gone_reason").alias("is_unknown"))


MESSAGE = "concat('ERROR: [site] v', event_id, ': ', CASE event_id % 5 WHEN 0 THEN 'Private video. Sign in' WHEN 1 THEN 'Video unavailable' WHEN 2 THEN 'Sign in to confirm your age' WHEN 3 THEN 'timed out' ELSE 'members-only content' END)"


@register("p25_error_triage", "SELECT event_id, concat('v', event_id) AS video_id, CASE event_id % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'age' WHEN 4 THEN 'members' END AS reason FROM events")
def p25_error_triage(spark, d) -> DataFrame:
    m = F.expr(MESSAGE)
    return table(spark, d, "events").select("event_id", F.regexp_extract(m, r"^ERROR: \[[^\]]*\] ([A-Za-z0-9_-]+): (.*)$", 1).alias("video_id"), t.error_reason(F.regexp_extract(m, r"^ERROR: \[[^\]]*\] ([A-Za-z0-9_-]+): (.*)$", 2)).alias("reason"))


@register("p26_parse_mode", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'learn' ELSE '' END AS mode FROM events")
def p26_parse_mode(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", t.parse_mode(F.when(F.col("event_id") % 3 == 0, " Learn ").otherwise(F.col("event_type"))).alias("mode"))


@register("p33_clean_label", "SELECT p_partkey, lower(p_name) AS label FROM part")
def p33_clean_label(spark, d) -> DataFrame:
    return parts(spark, d).select("p_partkey", t.clean_label(F.concat(F.lit('"'), F.regexp_replace("p_name", " ", "  "), F.lit('."\nsecond line'))).alias("label"))


@register("p34_clip", "SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE concat(substr(text, 1, 59), '…') END AS head FROM documents")
def p34_clip(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.clip("text", 60).alias("head"))


@register("p37_cache_key", "SELECT p_partkey, substr(sha256(concat(p_name, chr(0), p_type)), 1, 24) AS key FROM part")
def p37_cache_key(spark, d) -> DataFrame:
    """Also P38: the digest of a provenance."""
    return parts(spark, d).select("p_partkey", t.cache_key("p_name", "p_type").alias("key"))


@register("k2_safe_keys", "SELECT p_partkey, regexp_full_match(p_brand, '[A-Za-z0-9_-]{1,20}') AS safe FROM part")
def k2_safe_keys(spark, d) -> DataFrame:
    return parts(spark, d).select("p_partkey", t.safe_key("p_brand").alias("safe"))


CSV_ROWS = sql(VIEWS, "SELECT CASE WHEN k % 23 = 5 THEN '' ELSE video_id END AS \"videoID\", area || ' ' || event_id AS title, channel, CASE WHEN k % 23 = 7 THEN '' ELSE CAST(channel_id AS VARCHAR) END AS \"channelID\", strftime(watched_at, '%Y-%m-%dT%H:%M:%SZ') AS \"watchedAt\", topic, area, coalesce(mode, '') AS mode, source, CASE WHEN k = 0 THEN '' ELSE printf('%.2f', CAST(confidence AS DOUBLE)) END AS confidence, duration_s AS \"durationS\", k % 23 <> 7 AND channel_id IN (SELECT channel_id FROM subs) AS subscribed, unavailable FROM views")


@register("k3_csv_rows", CSV_ROWS)
def k3_csv_rows(spark, d) -> DataFrame:
    from ..operators.report import csv_rows
    from ..sources.events import subscriptions

    k = F.round(F.col("confidence") * 100).cast("int")
    rows = views(spark, d).withColumns({"title": F.concat_ws(" ", "area", "event_id"), "video_id": F.when(k % 23 != 5, F.col("video_id")), "channel_id": F.when(k % 23 != 7, F.col("channel_id"))})
    return csv_rows(rows, subscriptions(spark, d))


@register("k3_csv_file", CSV_ROWS)
def k3_csv_file(spark, d) -> DataFrame:
    """The rows after a trip through files that begin with a line of provenance and a header."""
    from ..sources import files
    from ..sources.scratch import scratch

    folder, rows = scratch(spark, "csv"), k3_csv_rows(spark, d)
    files.write_csv(rows, folder, "sha256:0123456789ab topics.yaml 2026-07-01T12:00:00Z")
    back = files.read_csv(spark, folder, rows.schema)
    return back.select(*(F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in rows.schema))


@register("p34_truncate", "SELECT p_partkey, CASE WHEN length(p_name) <= 12 THEN p_name ELSE substr(p_name, 1, 12) || '…' END AS cut FROM part")
def p34_truncate(spark, d) -> DataFrame:
    return parts(spark, d).select("p_partkey", t.truncate("p_name", 12).alias("cut"))
