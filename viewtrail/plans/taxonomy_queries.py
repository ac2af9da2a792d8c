"""Vector, cluster and taxonomy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters as c
from ..operators import taxonomy as k
from ..sources.events import table, views
from .catalog import register
from .oracle import VIEWS, sql

MEAN = """
m AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY i),
ml AS (SELECT list(m ORDER BY i) AS m FROM m),
c0 AS (SELECT vec_id, label, list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) - m[i]) AS v FROM embeddings, ml),
c AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM c0)
"""
CENTRE = MEAN + """,
g0 AS (SELECT label, i, sum(v[i] * greatest(vec_id % 5, 1)) / sum(greatest(vec_id % 5, 1)) AS m FROM c, range(1, 65) t(i) GROUP BY label, i),
g1 AS (SELECT label, list(m ORDER BY i) AS v FROM g0 GROUP BY label),
g AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM g1)
"""
DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i] * {1}[i]))"


def vectors(spark, d) -> DataFrame:
    return k.centred(table(spark, d, "embeddings"), "embedding")


def centres(v: DataFrame) -> DataFrame:
    """One row a label, computed once."""
    return k.few(k.centroids(v, "embedding", ["label"], F.col("vec_id") % 5))


@register("v2_centre", sql(MEAN, "SELECT vec_id, round(v[1], 6) AS first, round(list_sum(v), 6) AS total FROM c"))
def v2_centre(spark, d) -> DataFrame:
    return vectors(spark, d).select("vec_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("v3_centroids", sql(CENTRE, "SELECT label, round(v[1], 6) AS first, round(list_sum(v), 6) AS total FROM g"))
def v3_centroids(spark, d) -> DataFrame:
    return centres(vectors(spark, d)).select("label", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("v1_label_cosines", sql(CENTRE, f"SELECT a.label AS a, b.label AS b, round({DOT.format('a.v', 'b.v')}, 6) AS cosine FROM g a JOIN g b ON a.label < b.label"))
def v1_label_cosines(spark, d) -> DataFrame:
    """Also J8: the triangle of label pairs; labels are few."""
    c = centres(vectors(spark, d))
    a, b = c.alias("a"), c.alias("b")
    return a.join(F.broadcast(b), F.col("a.label") < F.col("b.label")).select(F.col("a.label").alias("a"), F.col("b.label").alias("b"), F.round(k.cosine("a.centroid", "b.centroid"), 6).alias("cosine"))


@register("v5_radius", sql(CENTRE, f"SELECT c.label, round(sum((1 - {DOT.format('c.v', 'g.v')}) * greatest(vec_id % 5, 1)) / sum(greatest(vec_id % 5, 1)), 6) AS radius, count(*) AS members FROM c JOIN g USING (label) GROUP BY c.label"))
def v5_radius(spark, d) -> DataFrame:
    w = F.greatest(F.col("vec_id") % 5, F.lit(1))
    v = vectors(spark, d)
    j = v.join(F.broadcast(centres(v)), "label")
    return j.groupBy("label").agg(F.round(F.sum((1 - k.cosine("embedding", "centroid")) * w) / F.sum(w), 6).alias("radius"), F.count("*").alias("members"))


@register("v7_nearest_centroid", sql(CENTRE, f"SELECT vec_id, arg_max(g.label, round({DOT.format('c.v', 'g.v')}, 9)) AS nearest FROM c, g GROUP BY vec_id"))
def v7_nearest_centroid(spark, d) -> DataFrame:
    v = vectors(spark, d)
    return k.nearest(v, "embedding", centres(v), "label").select("vec_id", "nearest")


def label_table(spark, d) -> DataFrame:
    e = vectors(spark, d)
    return e.select(F.concat(F.lit("a"), "label").alias("area"), F.concat(F.lit("s"), "vec_id").alias("sub"), (F.col("vec_id") % 50 + 1).cast("long").alias("views"), (F.col("vec_id") % 7 + 1).cast("long").alias("videos"), F.col("embedding").alias("vec"))


@register("v4_clusters")
def v4_clusters(spark, d) -> DataFrame:
    """Also V6, V7 and V12: two passes, small clusters folded, names."""
    return k.clusters(label_table(spark, d)).drop("round_no")


#: Linkage of the few label centroids, a merge a step: the closest pair, the lowest places on ties, until the bound.
NORM = "list_transform({0}, lambda x: x / sqrt(list_sum(list_transform({0}, lambda y: y * y))))"
LINKAGE = CENTRE + f""",
lab AS (SELECT label, v, row_number() OVER (ORDER BY n DESC, label) AS i, n FROM g JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)),
st AS (
  SELECT 0 AS step, list({{'i': i, 'm': [label], 'v': v, 'w': CAST(n AS DOUBLE)}} ORDER BY i) AS cs FROM lab
  UNION ALL
  SELECT step + 1, list_transform(list_filter(cs, lambda c: c.i <> best.b), lambda c: CASE WHEN c.i = best.a THEN {{'i': c.i, 'm': list_concat(c.m, other.m), 'v': {NORM.format("list_transform(range(1, 65), lambda q: c.w * c.v[q] + other.w * other.v[q])")}, 'w': c.w + other.w}} ELSE c END)
  FROM (SELECT step, cs, best, list_filter(cs, lambda c: c.i = best.b)[1] AS other FROM (
    SELECT step, cs, list_min(flatten(list_transform(cs, lambda a: list_transform(list_filter(cs, lambda b: b.i > a.i), lambda b: {{'d': 1 - list_dot_product(a.v, b.v), 'a': a.i, 'b': b.i}})))) AS best FROM st WHERE len(cs) > 1))
  WHERE best.d <= 0.95),
fin AS (SELECT unnest(cs) AS c FROM st WHERE step = (SELECT max(step) FROM st)),
mem AS (SELECT c.i AS cluster, unnest(c.m) AS label FROM fin),
named AS (SELECT mem.label, arg_min(x.label, x.i) AS name FROM mem JOIN mem o ON o.cluster = mem.cluster JOIN lab x ON x.label = o.label GROUP BY mem.label)
"""


def centre_table(spark, d) -> DataFrame:
    """The label centroids as labels, weighted by their vectors."""
    v = vectors(spark, d)
    n = v.groupBy("label").agg(F.count("*").alias("n"))
    x = centres(v).join(F.broadcast(k.few(n)), "label")
    return x.select(F.concat(F.lit("a"), "label").alias("area"), F.concat(F.lit("s"), "label").alias("sub"), F.col("n").alias("views"), F.col("n").alias("videos"), F.col("centroid").alias("vec"))


def linked(spark, d) -> DataFrame:
    return k.clusters(centre_table(spark, d), fine=0.95, coarse=-1.0, least=0, least_top=0)


@register("v4_linkage", "WITH RECURSIVE " + LINKAGE.lstrip() + " SELECT 's' || label AS sub, 's' || name AS cluster_name FROM named")
def v4_linkage(spark, d) -> DataFrame:
    """Centroid linkage of the labels' centroids, down to a bound."""
    return linked(spark, d).select("sub", "cluster_name")


@register("v11_projection_of_centroids", "WITH RECURSIVE " + LINKAGE.lstrip() + " SELECT 'a' || label || '/s' || label AS old_topic, 's' || name AS new_topic FROM named")
def v11_projection_of_centroids(spark, d) -> DataFrame:
    """Clusters that are their own top level project to the bare name."""
    return k.projection(linked(spark, d))


@register("v8_split")
def v8_split(spark, d) -> DataFrame:
    """Wide clusters split at a tighter threshold, equal names merged, in the second round."""
    return k.clusters(label_table(spark, d), fine=0.9, rounds=2, most_radius=0.3)


@register("v9_refine")
def v9_refine(spark, d) -> DataFrame:
    """A round under a control's wishes: a pin, a group of merges, a split and a name that is kept."""
    wishes = c.Control(pin={"a8/s11": "pinned", "a1/s2": "s3"}, merge=[["s5", "s7"]], split=["s9"], keep=["pinned"])
    return k.clusters(label_table(spark, d), control=wishes, rounds=2)


@register("v10_rounds")
def v10_rounds(spark, d) -> DataFrame:
    """Rounds until the metrics stay as they are, each name split once at most."""
    return k.clusters(label_table(spark, d), fine=0.8, rounds=10, most_radius=0.35)


@register("v11_projection")
def v11_projection(spark, d) -> DataFrame:
    return k.projection(k.clusters(label_table(spark, d)))


def titled(spark, d) -> DataFrame:
    """Views with titles and tags; some have no id, so that the title stands in."""
    key = F.round(F.col("confidence") * 100).cast("int")
    tags = F.array(F.concat(F.lit("t"), F.expr("CAST(round(confidence * 100) AS INT) div 10")), F.concat(F.lit("m"), key % 4))
    return views(spark, d).withColumns({"title": F.concat(F.lit("about "), "video_id"), "tags": tags, "video_id": F.when(key % 23 != 5, F.col("video_id")).otherwise("")})


@register("a32_labels", sql(VIEWS, "SELECT area, sub, count(*) AS views, count(DISTINCT video_id) AS videos, count(DISTINCT channel) AS channels FROM views GROUP BY area, sub"))
def a32_labels(spark, d) -> DataFrame:
    return k.labels(titled(spark, d))


FACTS = VIEWS + """,
f AS (
  SELECT 'channel' AS kind, area, sub, channel AS name, count(*) AS n FROM views GROUP BY ALL
  UNION ALL SELECT 'title', area, sub, 'about ' || video_id, count(*) FROM views GROUP BY ALL
  UNION ALL SELECT 'tag', area, sub, tag, count(*) FROM (SELECT DISTINCT area, sub, video_id, unnest(['t' || (k // 10), 'm' || (k % 4)]) AS tag FROM views) GROUP BY ALL),
facts AS (SELECT *, row_number() OVER (PARTITION BY kind, area, sub ORDER BY n DESC, name) AS rank FROM f
  QUALIFY rank <= CASE kind WHEN 'channel' THEN 3 WHEN 'tag' THEN 8 ELSE 2 END)
"""


@register("a32_label_facts", sql(FACTS, "SELECT kind, area, sub, name, n, CAST(rank AS INTEGER) AS rank FROM facts"))
def a32_label_facts(spark, d) -> DataFrame:
    """Also O5: three channels and two titles by views, eight tags by videos."""
    return k.label_facts(titled(spark, d))


@register("o5_label_channels", sql(VIEWS, ", n AS (SELECT topic, channel, count(*) AS n FROM views GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, channel) AS rank FROM n) SELECT topic, channel, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"))
def o5_label_channels(spark, d) -> DataFrame:
    """Also A36."""
    return k.top_channels(views(spark, d))


@register("p35_embed_text", sql(FACTS, """, j AS (SELECT area, sub, kind, CASE kind WHEN 'title' THEN string_agg(name, ' | ' ORDER BY rank) ELSE string_agg(name, ', ' ORDER BY rank) END AS names FROM facts GROUP BY area, sub, kind)
SELECT area, sub, concat_ws(chr(10), concat_ws(' ', area, sub), 'channels: ' || max(names) FILTER (WHERE kind = 'channel'), 'tags: ' || max(names) FILTER (WHERE kind = 'tag'), 'titles: ' || max(names) FILTER (WHERE kind = 'title')) AS text FROM j GROUP BY area, sub"""))
def p35_embed_text(spark, d) -> DataFrame:
    return k.embedded(titled(spark, d))


@register("a33_taxonomy_metrics", sql(VIEWS, """, nm AS (SELECT sub, count(DISTINCT area) AS tops FROM views WHERE sub IS NOT NULL GROUP BY sub), sj AS (SELECT area, sub, count(DISTINCT video_id) AS videos FROM views GROUP BY area, sub), pc AS (SELECT channel, count(DISTINCT area || '/' || coalesce(sub, '')) AS n FROM views GROUP BY channel)
SELECT (SELECT count(*) FROM nm) AS names, (SELECT count(*) FROM nm WHERE tops > 1) AS spread, (SELECT count(*) FROM sj) AS subjects, (SELECT count(DISTINCT area) FROM sj) AS tops, (SELECT round(count(*) FILTER (WHERE videos <= 1) / count(*), 6) FROM sj) AS tail_share, (SELECT max(n) FROM pc) AS most_per_channel, (SELECT round(avg(n), 6) FROM pc) AS mean_per_channel,
  (SELECT round(avg(CASE WHEN sub IS NULL THEN 0.5 ELSE 0.25 END), 6) FROM views) AS coherence"""))
def a33_taxonomy_metrics(spark, d) -> DataFrame:
    return k.metrics(views(spark, d), radius=F.when(F.col("sub").isNull(), 0.5).otherwise(0.25))


@register("o14_biggest_changes", sql(VIEWS, ", n AS (SELECT topic, count(*) FILTER (WHERE event_id % 2 = 0) AS before, count(*) FILTER (WHERE event_id % 2 = 1) AS after FROM views GROUP BY topic) SELECT topic, before, after, abs(after - before) AS change FROM n ORDER BY change DESC, topic LIMIT 8"))
def o14_biggest_changes(spark, d) -> DataFrame:
    n = views(spark, d).groupBy("topic").agg(F.count_if(F.col("event_id") % 2 == 0).alias("before"), F.count_if(F.col("event_id") % 2 == 1).alias("after"))
    return n.withColumn("change", F.abs(F.col("after") - F.col("before"))).orderBy(F.col("change").desc(), "topic").limit(8)
