"""Classification and inspection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify as q
from ..operators import inspect as ins
from ..operators import summary
from ..sources.events import table, views
from .catalog import register
from .oracle import VIEWS, sql

AREAS = ["click", "view", "purchase", "signup", "error", "unclear"]

VIDEOS = VIEWS + """,
vid AS (SELECT video_id, min(channel_id) AS channel_id, min(k) AS k, count(*) AS views, arg_min(area, us) AS cat, bool_or(unavailable) AS unavailable FROM views GROUP BY video_id),
videos AS (SELECT *, k % 13 <> 0 AS fetched, CASE WHEN k % 6 = 5 THEN NULL ELSE cat END AS category, ['t' || (k // 10), 'c' || channel_id, 'm' || (k % 4)] AS tags, CASE WHEN k % 6 = 5 THEN 0 WHEN k % 17 = 1 THEN 2 ELSE 1 END AS n_categories FROM vid)
"""


def videos(spark, d) -> DataFrame:
    """A metadata dimension over the event adapter's videos."""
    v = views(spark, d).withColumn("k", F.round(F.col("confidence") * 100).cast("int"))
    each = v.groupBy("video_id").agg(F.min("channel_id").alias("channel_id"), F.min("k").alias("k"), F.count("*").alias("views"), F.min_by("area", "watched_at").alias("cat"), F.bool_or("unavailable").alias("unavailable"))
    none = F.array().cast("array<string>")
    k = F.col("k")
    cats = F.when(k % 6 == 5, none).when(k % 17 == 1, F.array("cat", F.lit("more"))).otherwise(F.array("cat"))
    tags = F.array(F.concat(F.lit(" T"), F.expr("k div 10")), F.concat(F.lit("c"), "channel_id"), F.concat(F.lit("m"), k % 4), F.concat(F.lit("C"), "channel_id"))
    return each.select("video_id", "channel_id", "k", "views", "unavailable", (k % 13 != 0).alias("fetched"), cats.alias("categories"), ins.norm_tags(tags).alias("tags"))


@register("a12_coverage", sql(VIDEOS, "SELECT CAST(sum(views) AS BIGINT) AS views, count(*) AS videos, count(*) FILTER (WHERE fetched AND NOT unavailable) AS enriched, count(*) FILTER (WHERE fetched AND unavailable) AS tombstoned, count(*) FILTER (WHERE NOT fetched) AS unfetched, count(*) FILTER (WHERE fetched AND NOT unavailable AND category IS NOT NULL) AS with_category, count(*) FILTER (WHERE fetched AND NOT unavailable AND n_categories > 1) AS multi_category, count(*) FILTER (WHERE fetched AND NOT unavailable) AS with_tags, 3 AS median_tags FROM videos"))
def a12_coverage(spark, d) -> DataFrame:
    return ins.coverage(videos(spark, d))


@register("a12_categories", sql(VIDEOS, "SELECT coalesce(category, '') AS category, CAST(sum(views) AS BIGINT) AS views, count(*) AS videos FROM videos WHERE fetched AND NOT unavailable GROUP BY 1"))
def a12_categories(spark, d) -> DataFrame:
    return ins.categories(videos(spark, d))


@register("a13_upper_median", "SELECT list_sort(list(n))[count(*) // 2 + 1] AS median FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def a13_upper_median(spark, d) -> DataFrame:
    return ins.upper_median(table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")), "n")


@register("a14_tag_counts", sql(VIDEOS, ", x AS (SELECT video_id, channel_id, unnest(tags) AS tag FROM videos WHERE fetched AND NOT unavailable) SELECT tag, count(DISTINCT video_id) AS videos, count(DISTINCT channel_id) AS channels FROM x GROUP BY tag"))
def a14_tag_counts(spark, d) -> DataFrame:
    return ins.tag_counts(videos(spark, d))


@register("a15_tag_spread", sql(VIDEOS, ", x AS (SELECT channel_id, unnest(tags) AS tag FROM videos WHERE fetched AND NOT unavailable), n AS (SELECT tag, count(DISTINCT channel_id) AS c FROM x GROUP BY tag) SELECT count(*) AS tags, count(*) FILTER (WHERE c >= 3) AS subjects, count(*) FILTER (WHERE c = 1) AS brands FROM n"))
def a15_tag_spread(spark, d) -> DataFrame:
    return ins.tag_spread(videos(spark, d))


@register("o4_category_tags", sql(VIDEOS, """, x AS (SELECT coalesce(category, '') AS category, video_id, channel_id, unnest(tags) AS tag FROM videos WHERE fetched AND NOT unavailable), g AS (SELECT tag, count(DISTINCT channel_id) AS channels FROM x GROUP BY tag),
n AS (SELECT category, tag, count(DISTINCT video_id) AS videos FROM x GROUP BY category, tag),
r AS (SELECT n.category, n.tag, n.videos, g.channels, row_number() OVER (PARTITION BY category ORDER BY videos DESC, n.tag) AS rank, CASE WHEN g.channels >= 3 THEN row_number() OVER (PARTITION BY category, g.channels >= 3 ORDER BY videos DESC, n.tag) END AS subject_rank FROM n JOIN g ON g.tag = n.tag)
SELECT category, tag, videos, channels, CAST(rank AS INTEGER) AS rank, CAST(subject_rank AS INTEGER) AS subject_rank FROM r WHERE rank <= 15 OR subject_rank <= 15"""))
def o4_category_tags(spark, d) -> DataFrame:
    return ins.category_tags(videos(spark, d))


@register("a16_donors", sql(VIDEOS, """, p AS (SELECT channel_id, category, count(*) AS n FROM videos WHERE fetched AND NOT unavailable AND category IS NOT NULL GROUP BY ALL), c AS (SELECT channel_id, max(n) AS top, sum(n) AS total FROM p GROUP BY channel_id),
x AS (SELECT v.views, CASE WHEN top = total THEN '100 %' WHEN top * 100 >= total * 90 THEN '>= 90 %' WHEN top * 100 >= total * 70 THEN '>= 70 %' ELSE '< 70 %' END AS bucket, total >= 3 AS ok FROM videos v JOIN c USING (channel_id) WHERE NOT (fetched AND NOT unavailable AND category IS NOT NULL))
SELECT bucket, count(*) AS videos, CAST(sum(views) AS BIGINT) AS views, count(*) FILTER (WHERE ok) AS videos_over, CAST(coalesce(sum(views) FILTER (WHERE ok), 0) AS BIGINT) AS views_over FROM x GROUP BY bucket"""))
def a16_donors(spark, d) -> DataFrame:
    """Also J6: a left join to the channel's majority."""
    return ins.donors(videos(spark, d))


@register("j6_donor_funnel", sql(VIDEOS, ", c AS (SELECT DISTINCT channel_id AS cid FROM videos WHERE fetched AND NOT unavailable AND category IS NOT NULL) SELECT count(*) AS no_category, count(channel_id) AS with_channel, count(cid) AS donor_found, CAST(coalesce(sum(views), 0) AS BIGINT) AS no_category_views, CAST(coalesce(sum(views) FILTER (WHERE channel_id IS NOT NULL), 0) AS BIGINT) AS with_channel_views, CAST(coalesce(sum(views) FILTER (WHERE cid IS NOT NULL), 0) AS BIGINT) AS donor_views FROM videos LEFT JOIN c ON cid = channel_id WHERE NOT (fetched AND NOT unavailable AND category IS NOT NULL)"))
def j6_donor_funnel(spark, d) -> DataFrame:
    return ins.donor_funnel(videos(spark, d))


RULES = [
    q.Rule("metal", "metals/steel", "learn", title_any=("steel",)),
    q.Rule("brands", "brands", "mixed", channel_any=("brand#12", "BRAND#21")),
    q.Rule("anodized", "finish/anodized", "consume", tag_any=("anodized",)),
    q.Rule("text", "finish/other", "", text_any=("burnish", "polish")),
    q.Rule("size", "sizes", "", category_any=("SIZE 7", "size 9")),
]
RULE_SQL = "CASE WHEN contains(lower(p_name), 'steel') THEN 'metal' WHEN lower(p_brand) IN ('brand#12', 'brand#21') THEN 'brands' WHEN list_contains(string_split(lower(p_type), ' '), 'anodized') THEN 'anodized' WHEN contains(lower(p_name), 'burnish') OR contains(lower(p_type), 'burnish') OR contains(lower(p_name), 'polish') OR contains(lower(p_type), 'polish') THEN 'text' WHEN p_size IN (7, 9) THEN 'size' END"


@register("c1_rules", f"SELECT p_partkey, r AS rule, CASE r WHEN 'metal' THEN 'metals/steel' WHEN 'brands' THEN 'brands' WHEN 'anodized' THEN 'finish/anodized' WHEN 'text' THEN 'finish/other' WHEN 'size' THEN 'sizes' END AS topic FROM (SELECT p_partkey, {RULE_SQL} AS r FROM part)")
def c1_rules(spark, d) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("channel"), F.split("p_type", " ").alias("tags"), F.array(F.concat(F.lit("Size "), "p_size")).alias("categories"))
    return p.withColumn("m", q.match(RULES)).select("p_partkey", "m.rule", "m.topic")


def titled(spark, d) -> DataFrame:
    return views(spark, d).withColumn("title", F.concat_ws(" ", "area", "event_id"))


def metadata(spark, d) -> DataFrame:
    v = videos(spark, d).filter("fetched")
    return v.select("video_id", F.when(F.col("k") % 2 == 0, F.concat(F.lit("title of "), "video_id")).otherwise("").alias("title"), F.lit("").alias("channel"), "tags", "categories", "unavailable", F.lit(60).alias("duration_s"), "k")


@register("c2_video_inputs", sql(VIDEOS, ", f AS (SELECT video_id, arg_min(area || ' ' || event_id, event_id) AS t, arg_min(channel, event_id) AS c FROM views GROUP BY video_id) SELECT v.video_id, v.views, CASE WHEN fetched AND NOT unavailable AND k % 2 = 0 THEN 'title of ' || v.video_id ELSE f.t END AS title, f.c AS channel, fetched AS has_meta, fetched AND unavailable AS unavailable FROM videos v JOIN f USING (video_id)"))
def c2_video_inputs(spark, d) -> DataFrame:
    return q.video_inputs(titled(spark, d), metadata(spark, d)).drop("tags", "categories")


def cache(spark, d) -> DataFrame:
    """Cached verdicts of two videos in three."""
    k = F.col("k")
    v = videos(spark, d).filter("k % 3 <> 0").join(views(spark, d).groupBy("video_id").agg(F.max("area").alias("area")), "video_id")
    topic = F.when(k % 7 == 0, "nowhere/x").when(k % 7 == 1, "unclear").when(k % 7 == 2, F.col("area")).otherwise(F.concat_ws("/", "area", F.concat(F.lit("S "), k % 4)))
    return v.select("video_id", topic.alias("topic"), F.when(k % 4 != 0, "learn").otherwise("").alias("mode"), (k / 100.0).alias("confidence"), F.when(k % 2 == 0, "m1").otherwise("m2").alias("model"), F.when(k % 5 == 0, "title").otherwise("full").alias("basis"), F.when(k % 8 == 0, "old").otherwise("f1").alias("taxonomy"), F.when(k % 11 == 0, F.array(F.lit("sub"))).otherwise(F.array().cast("array<string>")).alias("retried"), "k")


CACHE = VIDEOS + """,
ma AS (SELECT video_id, max(area) AS area FROM views GROUP BY video_id),
cache AS (SELECT v.video_id, v.k, CASE WHEN k % 7 = 0 THEN 'nowhere/x' WHEN k % 7 = 1 THEN 'unclear' WHEN k % 7 = 2 THEN area ELSE area || '/S ' || (k % 4) END AS topic,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN 'unclear' WHEN k % 7 = 2 THEN area ELSE area || '/s-' || (k % 4) END AS norm, area AS carea,
  CASE WHEN k % 4 <> 0 THEN 'learn' ELSE '' END AS mode, CASE WHEN k % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, k / 100.0 AS confidence, k % 5 = 0 AS by_title, k % 8 = 0 AS old_tax, k % 11 = 0 AS sub_done
  FROM videos v JOIN ma USING (video_id) WHERE k % 3 <> 0)
"""


def items(spark, d) -> DataFrame:
    v = videos(spark, d)
    area = F.when(F.size("categories") > 0, F.when(F.col("k") % 9 == 4, "error").otherwise(F.get("categories", F.lit(0))))
    return v.select("video_id", F.when(F.col("fetched") & ~F.col("unavailable"), area).alias("category_area"), F.col("fetched").alias("has_meta"), (F.col("fetched") & F.col("unavailable")).alias("unavailable"))


#: By the rules' order: the category's area over the cached one, else the cached topic if its area is known.
RESOLVED = CACHE + """,
i AS (SELECT video_id, k, CASE WHEN fetched AND NOT unavailable AND k % 6 <> 5 THEN CASE WHEN k % 9 = 4 THEN 'error' ELSE cat END END AS area, fetched, fetched AND unavailable AS gone FROM videos),
res AS (
  SELECT i.*, c.video_id IS NOT NULL AS hit, c.model, c.mode, c.confidence, c.old_tax, c.by_title,
    CASE WHEN c.video_id IS NULL THEN NULL WHEN i.area IS NULL THEN c.norm WHEN split_part(c.topic, '/', 1) = i.area THEN c.norm ELSE i.area END AS found
  FROM i LEFT JOIN cache c USING (video_id)),
resolved AS (
  SELECT video_id, coalesce(found, area, 'unclear') AS topic, CASE WHEN found IS NULL THEN '' ELSE mode END AS mode, CASE WHEN found IS NULL THEN 0.0 ELSE confidence END AS confidence,
    CASE WHEN found IS NOT NULL THEN 'llm:' || model WHEN area IS NOT NULL THEN 'category' ELSE 'unclassified' END AS source, hit AND (old_tax OR (by_title AND fetched AND NOT gone)) AS stale, NOT hit AND NOT fetched AS waiting,
    (hit AND (old_tax OR (by_title AND fetched AND NOT gone))) OR (NOT hit AND fetched) AS ask, hit, fetched, gone, by_title
  FROM res)
"""


@register("c3_resolve_cached", sql(RESOLVED, "SELECT video_id, topic, mode, source, CAST(round(confidence * 100) AS BIGINT) AS percent, coalesce(stale, false) AS stale, waiting, coalesce(ask, false) AS ask FROM resolved"))
def c3_resolve_cached(spark, d) -> DataFrame:
    """Also C4 and C5: the category alone, and videos that wait for metadata."""
    return q.resolve_cached(items(spark, d), cache(spark, d), AREAS, "f1").withColumn("percent", F.round(F.col("confidence") * 100).cast("long")).drop("confidence")


@register("c5_title_only", sql(RESOLVED, "SELECT video_id, coalesce(hit AND by_title AND fetched AND NOT gone, false) OR NOT hit AS ask, false AS waiting FROM resolved"))
def c5_title_only(spark, d) -> DataFrame:
    """The last sweep: nothing waits for metadata; verdicts of other areas are kept."""
    return q.resolve_cached(items(spark, d), cache(spark, d), AREAS, "f1", title_only=True, keep_verdicts=True).select("video_id", "ask", "waiting")


ID_LESS = "CASE WHEN v.k % 23 = 5 THEN '' ELSE v.video_id END"


@register("c6_join_back", sql(CACHE, f"""SELECT v.event_id, CASE WHEN v.k % 23 = 5 THEN CASE WHEN v.area = 'click' THEN 'click/by-title' WHEN v.channel = 'channel-7' THEN 'view' ELSE 'unclear' END ELSE coalesce(c.norm, 'unclear') END AS topic,
  CASE WHEN v.k % 23 = 5 THEN CASE WHEN v.area = 'click' THEN 'rule:clicks' WHEN v.channel = 'channel-7' THEN 'rule:seven' ELSE 'unclassified' END ELSE coalesce(CASE WHEN c.norm IS NOT NULL THEN 'llm:' || c.model END, 'unclassified') END AS source,
  CASE WHEN v.k % 23 <> 5 AND x.fetched THEN 60 END AS meta_duration FROM views v LEFT JOIN (SELECT * FROM cache WHERE norm IS NOT NULL) c USING (video_id) JOIN videos x ON x.video_id = v.video_id"""))
def c6_join_back(spark, d) -> DataFrame:
    """Also J1 and J2: views to metadata and to verdicts; views without an id by rules on title and channel."""
    known = q.resolve_cached(items(spark, d).withColumn("category_area", F.lit(None).cast("string")), cache(spark, d), AREAS, "f1").filter("source LIKE 'llm%'")
    rules = [q.Rule("clicks", "click/by-title", "learn", title_any=("click",)), q.Rule("seven", "view", channel_any=("channel-7",))]
    v = titled(spark, d).withColumn("video_id", F.when(F.round(F.col("confidence") * 100).cast("int") % 23 == 5, "").otherwise(F.col("video_id"))).select("event_id", "video_id", "title", "channel")
    return q.join_back(v, known, metadata(spark, d), rules).select("event_id", "topic", "source", F.col("duration_s").alias("meta_duration"))


@register("c7_merge_sub_round", sql(CACHE, """SELECT video_id, CASE WHEN k % 2 = 0 AND k % 6 <> 0 AND k / 50.0 - 1 >= 0.4 THEN carea || '/new' ELSE topic END AS topic, mode,
  CAST(round(100 * CASE WHEN k % 2 = 0 AND k % 6 <> 0 AND k / 50.0 - 1 >= 0.4 THEN k / 50.0 - 1 ELSE confidence END) AS BIGINT) AS percent, sub_done OR k % 2 = 0 AS tried FROM cache"""))
def c7_merge_sub_round(spark, d) -> DataFrame:
    """Blank and hesitant answers change nothing, yet count as asked."""
    c = cache(spark, d)
    area = views(spark, d).groupBy("video_id").agg(F.max("area").alias("area"))
    answers = c.filter("k % 2 = 0").join(area, "video_id").select("video_id", F.when(F.col("k") % 6 != 0, "new").alias("sub"), (F.col("k") / 50.0 - 1).alias("confidence"), "area")
    return q.merge_verdicts(c, answers, "sub", AREAS).select("video_id", "topic", "mode", F.round(F.col("confidence") * 100).cast("long").alias("percent"), F.array_contains("retried", "sub").alias("tried"))


@register("c7_merge_mode_round", sql(CACHE, "SELECT video_id, topic, CASE WHEN mode = '' AND k % 8 = 0 THEN 'mixed' ELSE mode END AS mode, mode = '' AS tried FROM cache"))
def c7_merge_mode_round(spark, d) -> DataFrame:
    c = cache(spark, d)
    answers = c.filter("mode = ''").select("video_id", F.when(F.col("k") % 8 == 0, "mixed").otherwise("").alias("mode"))
    return q.merge_verdicts(c, answers, "mode", AREAS).select("video_id", "topic", "mode", F.array_contains("retried", "mode").alias("tried"))


@register("c7_merge_full_round", sql(CACHE, """SELECT video_id, CASE WHEN k % 2 <> 0 THEN topic WHEN k % 3 = 1 THEN 'error/fresh' ELSE 'view/fresh' END AS topic, CASE WHEN k % 2 <> 0 THEN mode ELSE 'mixed' END AS mode, CASE WHEN k % 2 <> 0 THEN model ELSE 'm9' END AS model,
  CASE WHEN k % 2 <> 0 THEN sub_done WHEN k % 10 = 0 THEN sub_done ELSE false END AS sub_mark, k % 10 = 0 AS context_mark FROM cache"""))
def c7_merge_full_round(spark, d) -> DataFrame:
    """The category puts its area back; markers stay only where a marked reason asked."""
    c, k = cache(spark, d), F.col("k")
    answers = c.filter("k % 2 = 0").select("video_id", F.lit("view/fresh").alias("topic"), F.lit("mixed").alias("mode"), F.lit(0.9).alias("confidence"), F.lit("m9").alias("model"), F.lit("full").alias("basis"), F.lit("f1").alias("taxonomy"), F.when(k % 3 == 1, "error").alias("area"), F.when(k % 10 == 0, "context").alias("marker"))
    got = q.merge_verdicts(c, answers, "full", AREAS)
    return got.select("video_id", "topic", "mode", "model", F.array_contains("retried", "sub").alias("sub_mark"), F.array_contains("retried", "context").alias("context_mark"))


SEEDS = """, ts AS (SELECT norm FROM cache WHERE norm IS NOT NULL UNION ALL SELECT area || CASE WHEN sub IS NULL THEN '' ELSE '/' || sub END FROM views WHERE k % 5 = 0),
n AS (SELECT split_part(norm, '/', 1) AS area, substr(norm, instr(norm, '/') + 1) AS sub, count(*) AS n FROM ts WHERE instr(norm, '/') > 0 AND norm NOT IN ('view/s-1', 'click/s2') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY n DESC, sub) AS rank FROM n) SELECT area, sub, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12"""


@register("c8_sub_seeds", sql(CACHE, SEEDS))
def c8_sub_seeds(spark, d) -> DataFrame:
    """Over rules and cache alike, without the topics that are asked again."""
    by_rule = views(spark, d).filter(F.round(F.col("confidence") * 100).cast("int") % 5 == 0).select("topic")
    return q.sub_seeds(cache(spark, d).select("topic").unionByName(by_rule), AREAS, ["view/s-1", "click/s2"])


@register("c9_channel_context", sql(CACHE, """, kn AS (SELECT v.channel_id, topic, count(*) AS n FROM cache JOIN videos v USING (video_id) WHERE topic <> 'unclear' GROUP BY ALL),
o AS (SELECT v.video_id, kn.topic, kn.n - CASE WHEN kn.topic = c.topic THEN 1 ELSE 0 END AS n FROM videos v LEFT JOIN cache c USING (video_id) JOIN kn ON kn.channel_id = v.channel_id),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, topic) AS rank FROM o WHERE n > 0) SELECT video_id, string_agg(topic, '|' ORDER BY rank) AS context FROM r WHERE rank <= 3 GROUP BY video_id"""))
def c9_channel_context(spark, d) -> DataFrame:
    v = videos(spark, d).select("video_id", F.col("channel_id").alias("channel"))
    return q.channel_context(v, cache(spark, d).join(v, "video_id").select("video_id", "channel", "topic"))


@register("c10_model_drift", sql(CACHE, "SELECT model, video_id FROM cache WHERE model NOT IN ('', 'm1')"))
def c10_model_drift(spark, d) -> DataFrame:
    return q.model_drift(cache(spark, d), "m1")


PROJECTION = [("click", "web"), ("click/s1", "web/first"), ("view/s2", "watching/second"), ("purchase", "shop/x")]


@register("c11_fold", sql(VIEWS, """, p(old_topic, new_topic) AS (VALUES ('click', 'web'), ('click/s1', 'web/first'), ('view/s2', 'watching/second'), ('purchase', 'shop/x')),
j AS (SELECT v.topic, v.sub, x.new_topic AS ex, split_part(a.new_topic, '/', 1) AS top FROM views v LEFT JOIN p x ON x.old_topic = v.topic LEFT JOIN p a ON a.old_topic = v.area)
SELECT topic, coalesce(ex, CASE WHEN top IS NOT NULL THEN top || CASE WHEN sub IS NOT NULL THEN '/' || sub ELSE '' END END, topic) AS folded, CASE WHEN ex IS NOT NULL THEN 'exact' WHEN top IS NOT NULL THEN 'area' ELSE 'none' END AS how, count(*) AS views FROM j GROUP BY ALL"""))
def c11_fold(spark, d) -> DataFrame:
    """Also S14 and D26: a projection applied on read, and its counts."""
    p = spark.createDataFrame(PROJECTION, "old_topic string, new_topic string")
    return q.fold(views(spark, d).select("topic"), p).groupBy("topic", "folded", "how").agg(F.count("*").alias("views"))


TARGETS = CACHE + """,
ju AS (SELECT video_id, norm AS topic, mode, model, sub_done, k FROM cache),
targets AS (
  SELECT video_id, 'full' AS kind, 'context' AS marker FROM ju WHERE topic = 'unclear' AND k % 2 = 0
  UNION ALL SELECT video_id, 'full', 'topic:view' FROM ju WHERE topic = 'view'
  UNION ALL SELECT video_id, 'sub', 'sub' FROM ju WHERE topic NOT IN ('unclear', 'view') AND instr(topic, '/') = 0 AND NOT sub_done
  UNION ALL SELECT video_id, 'mode', 'mode' FROM ju WHERE topic NOT IN ('unclear', 'view') AND mode = '')
"""


def judged(spark, d) -> DataFrame:
    """Cached verdicts as the rounds see them."""
    c = cache(spark, d)
    known = q.resolve_cached(items(spark, d).withColumn("category_area", F.lit(None).cast("string")), c, AREAS, "f1").filter("source LIKE 'llm%'").select("video_id", "topic", "source")
    return c.select("video_id", "mode", "retried", (F.col("k") % 2 == 0).alias("usable_text")).join(known, "video_id", "left")


SELECTORS = ["no-sub", "no-mode", "unclear", "topic:view"]


@register("f7_retry_targets", sql(TARGETS, "SELECT * FROM targets"))
def f7_retry_targets(spark, d) -> DataFrame:
    return q.retry_targets(judged(spark, d), SELECTORS)


@register("f8_defects", sql(TARGETS, "SELECT count(*) FILTER (WHERE instr(topic, '/') = 0 AND NOT sub_done) AS no_sub, count(*) FILTER (WHERE mode = '') AS no_mode FROM ju WHERE topic <> 'unclear'"))
def f8_defects(spark, d) -> DataFrame:
    return q.defects(judged(spark, d))


@register("f9_budget", sql(TARGETS, "SELECT video_id, kind, marker FROM targets ORDER BY CASE kind WHEN 'sub' THEN 1 WHEN 'mode' THEN 2 ELSE 3 END, video_id LIMIT 40"))
def f9_budget(spark, d) -> DataFrame:
    return q.within_budget(q.retry_targets(judged(spark, d), SELECTORS), 40)


@register("j5_missing_ids", sql(CACHE, "SELECT video_id, count(*) AS views FROM views WHERE video_id NOT IN (SELECT video_id FROM cache) GROUP BY video_id"))
def j5_missing_ids(spark, d) -> DataFrame:
    return q.priorities(views(spark, d), cache(spark, d))


@register("o10_missing_first", sql(CACHE, "SELECT video_id, count(*) AS views FROM views WHERE video_id NOT IN (SELECT video_id FROM cache) GROUP BY video_id ORDER BY views DESC, video_id"))
def o10_missing_first(spark, d) -> DataFrame:
    return q.priorities(views(spark, d), cache(spark, d)).orderBy(F.col("views").desc(), "video_id")


@register("o12_strided_sample", sql(VIDEOS, ", r AS (SELECT video_id, row_number() OVER (ORDER BY video_id) - 1 AS n, count(*) OVER () AS total FROM videos), w AS (SELECT CAST(floor(i * (SELECT count(*) FROM videos) / 50.0) AS BIGINT) AS n FROM range(50) t(i)) SELECT video_id FROM r WHERE n IN (SELECT n FROM w)"))
def o12_strided_sample(spark, d) -> DataFrame:
    return q.strided_sample(videos(spark, d), 50)


@register("a34_agreement", sql(CACHE, "SELECT count(*) AS both, count(*) FILTER (WHERE topic = CASE WHEN k % 3 = 1 THEN topic ELSE carea END) AS topic, count(*) FILTER (WHERE split_part(topic, '/', 1) = CASE WHEN k % 3 = 1 THEN split_part(topic, '/', 1) ELSE carea END) AS area, count(*) FILTER (WHERE mode = '') AS mode FROM cache WHERE k % 2 = 0"))
def a34_agreement(spark, d) -> DataFrame:
    """Also J10: the videos that two judges share."""
    c = cache(spark, d)
    area = views(spark, d).groupBy("video_id").agg(F.max("area").alias("area"))
    other = c.filter("k % 2 = 0").join(area, "video_id").select("video_id", F.when(F.col("k") % 3 == 1, F.col("topic")).otherwise(F.col("area")).alias("topic"), F.lit("").alias("mode"))
    return q.agreement(c, other)


@register("a35_verdict", "SELECT n_nationkey, CASE WHEN (w + l) * 2 < w + l + u THEN 'none' WHEN abs(w - l) < 2 * sqrt(w + l) THEN 'close' WHEN w > l THEN 'a' ELSE 'b' END AS verdict FROM (SELECT n_nationkey, n_nationkey * 3 AS w, 40 - n_nationkey AS l, n_nationkey % 7 * 20 AS u FROM nation)")
def a35_verdict(spark, d) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", q.verdict(n * 3, 40 - n, n % 7 * 20).alias("verdict"))


@register("k7_inspection_lines", sql(VIDEOS, """, r AS (SELECT * FROM videos WHERE fetched AND NOT unavailable), c AS (SELECT coalesce(category, '') AS category, sum(views) AS v, count(*) AS n FROM r GROUP BY 1),
p0 AS (SELECT * FROM videos WHERE NOT (fetched AND NOT unavailable AND category IS NOT NULL)), dn AS (SELECT DISTINCT channel_id AS cid FROM r WHERE category IS NOT NULL),
p AS (SELECT channel_id, category, count(*) AS n FROM r WHERE category IS NOT NULL GROUP BY ALL), cc AS (SELECT channel_id, max(n) AS top, sum(n) AS total FROM p GROUP BY channel_id),
b AS (SELECT views, CASE WHEN top = total THEN '100 %' WHEN top * 100 >= total * 90 THEN '>= 90 %' WHEN top * 100 >= total * 70 THEN '>= 70 %' ELSE '< 70 %' END AS bucket, total >= 3 AS ok FROM p0 JOIN cc USING (channel_id)),
tg AS (SELECT tag, count(DISTINCT channel_id) AS c FROM (SELECT channel_id, unnest(tags) AS tag FROM r) GROUP BY tag)
SELECT 'coverage' AS section, CAST(1 AS BIGINT) AS place, sum(views) || ' views of ' || count(*) || ' videos; metadata: ' || count(*) FILTER (WHERE fetched AND NOT unavailable) || ' fetched, ' || count(*) FILTER (WHERE fetched AND unavailable) || ' gone, ' || count(*) FILTER (WHERE NOT fetched) || ' not fetched' AS text FROM videos
UNION ALL SELECT 'coverage', 2, 'categories: ' || CAST(round(count(category) * 100.0 / count(*)) AS BIGINT) || ' % of fetched videos; tags: 100 %, median 3; several categories: ' || count(*) FILTER (WHERE n_categories > 1) FROM r
UNION ALL SELECT 'categories', row_number() OVER (ORDER BY v DESC, category), CASE WHEN category = '' THEN '(none)' ELSE category END || ': ' || v || ' views, ' || n || ' videos' FROM c
UNION ALL SELECT 'donors', 1, count(*) || ' videos (' || sum(views) || ' views) lack a category; ' || count(channel_id) || ' (' || sum(views) FILTER (WHERE channel_id IS NOT NULL) || ') name a channel; of ' || count(cid) || ' (' || coalesce(sum(views) FILTER (WHERE cid IS NOT NULL), 0) || ') the channel has one elsewhere' FROM p0 LEFT JOIN dn ON cid = channel_id
UNION ALL SELECT 'donors', list_position(['100 %', '>= 90 %', '>= 70 %', '< 70 %'], bucket) + 1, 'majority ' || bucket || ': ' || count(*) || ' videos, ' || sum(views) || ' views; with enough videos: ' || count(*) FILTER (WHERE ok) || ', ' || coalesce(sum(views) FILTER (WHERE ok), 0) FROM b GROUP BY bucket
UNION ALL SELECT 'tags', 1, count(*) || ' tags: ' || count(*) FILTER (WHERE c = 1) || ' on one channel, ' || count(*) FILTER (WHERE c >= 3) || ' on several' FROM tg"""))
def k7_inspection_lines(spark, d) -> DataFrame:
    return summary.inspection_lines(videos(spark, d))


@register("p36_prompts", sql(VIDEOS, """, f AS (SELECT v.video_id, 'title of ' || v.video_id || ' | channel: channel-' || v.channel_id || ' | tags: ' || array_to_string(v.tags, ', ') || ' | area: ' || coalesce(v.category, 'unclear') AS text FROM videos v)
SELECT video_id, text FROM f"""))
def p36_prompts(spark, d) -> DataFrame:
    """Item texts, numbered in batches of 20 and taken apart again."""
    v = videos(spark, d)
    text = summary.item_text(F.concat(F.lit("title of "), "video_id"), F.concat(F.lit("channel-"), "channel_id"), F.col("tags"), F.coalesce(F.get("categories", F.lit(0)), F.lit("unclear")))
    made = summary.batched_prompts(v.select("video_id", text.alias("text")), 20)
    lines = made.select(F.arrays_zip("ids", F.split("user", "\n").alias("lines")).alias("x")).select(F.inline("x"))
    return lines.select(F.col("ids").alias("video_id"), F.regexp_replace("lines", r"^\d+\. ", "").alias("text"))


@register("a37_gone_counters", "SELECT coalesce(CASE event_id % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'age' WHEN 4 THEN 'members' END, 'transient') AS reason, count(*) AS videos FROM events GROUP BY ALL")
def a37_gone_counters(spark, d) -> DataFrame:
    """How many answers of a fetch gave each reason; those without one are asked again."""
    from .text_queries import p25_error_triage

    return p25_error_triage(spark, d).groupBy(F.coalesce("reason", F.lit("transient")).alias("reason")).agg(F.count("*").alias("videos"))


@register("p36_system_prompts", sql(CACHE, SEEDS.replace("SELECT area, sub, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12", """,
known AS (SELECT area, string_agg(sub, ', ' ORDER BY rank) AS known FROM r WHERE rank <= 12 GROUP BY area),
named AS (SELECT * FROM (VALUES @AREAS@) v(place, area)),
lines AS (SELECT string_agg('- ' || named.area || coalesce(' (subjects so far: ' || known || ')', ''), chr(10) ORDER BY place) AS lines FROM named LEFT JOIN known ON known.area = named.area)
SELECT kind, head || chr(10) || lines AS prompt FROM (VALUES @KINDS@) k(kind, head), lines""".replace("@AREAS@", ", ".join(f"({k}, '{a}')" for k, a in enumerate(AREAS))).replace("@KINDS@", ", ".join(f"('{k}', '{summary.system_prompt(k)}')" for k in summary.ASKED)))))
def p36_system_prompts(spark, d) -> DataFrame:
    """The instruction of each kind of question, with the subjects of rules and cache so far."""
    return summary.system_prompts(list(AREAS), c8_sub_seeds(spark, d))
