"""Coverage of the metadata, tag counts, and what categories channels could lend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_tags

SUBJECT_CHANNELS, DONOR_VIDEOS = 3, 3
#: Share of a channel's commonest category, in percent, widest first.
BUCKETS = (("100 %", 100), (">= 90 %", 90), (">= 70 %", 70), ("< 70 %", 0))


def category():
    """The first category as it stands; null for none."""
    return F.nullif(F.get("categories", F.lit(0)), F.lit(""))


def coverage(videos: DataFrame) -> DataFrame:
    """One row; videos: video_id, views, fetched, unavailable, categories, tags."""
    rich = F.col("fetched") & ~F.col("unavailable")
    n = F.when(rich & (F.size("tags") > 0), F.size("tags"))
    # A sorted list of counts would be one task's; counts of counts are few.
    out = videos.agg(
        F.sum("views").alias("views"), F.count("*").alias("videos"), F.count_if(rich).alias("enriched"), F.count_if(F.col("fetched") & F.col("unavailable")).alias("tombstoned"), F.count_if(~F.col("fetched")).alias("unfetched"),
        F.count_if(rich & category().isNotNull()).alias("with_category"), F.count_if(rich & (F.size("categories") > 1)).alias("multi_category"), F.count(n).alias("with_tags"),
    )
    return out.crossJoin(upper_median(videos.filter(rich).select(F.size("tags").alias("n")), "n").withColumnRenamed("median", "median_tags"))


def upper_median(df: DataFrame, c: str) -> DataFrame:
    """sorted[n div 2] of whole numbers, by a cumulative histogram."""
    h = df.groupBy(c).agg(F.count("*").alias("_k"))
    w = Window.orderBy(c)  # over distinct values
    cum = h.withColumn("_to", F.sum("_k").over(w)).withColumn("_all", F.sum("_k").over(Window.partitionBy()))
    return cum.filter(F.col("_to") > F.floor(F.col("_all") / 2)).agg(F.coalesce(F.min(c), F.lit(0)).alias("median"))


def categories(videos: DataFrame) -> DataFrame:
    rich = videos.filter(F.col("fetched") & ~F.col("unavailable"))
    return rich.groupBy(F.coalesce(category(), F.lit("")).alias("category")).agg(F.sum("views").alias("views"), F.count("*").alias("videos"))


def tag_counts(videos: DataFrame) -> DataFrame:
    """Distinct videos and channels of each tag, over all categories."""
    rich = videos.filter(F.col("fetched") & ~F.col("unavailable"))
    return rich.select("video_id", "channel_id", F.explode(norm_tags("tags")).alias("tag")).groupBy("tag").agg(F.count_distinct("video_id").alias("videos"), F.count_distinct("channel_id").alias("channels"))


def tag_spread(videos: DataFrame) -> DataFrame:
    c = F.col("channels")
    return tag_counts(videos).agg(F.count("*").alias("tags"), F.count_if(c >= SUBJECT_CHANNELS).alias("subjects"), F.count_if(c == 1).alias("brands"))


def category_tags(videos: DataFrame, k: int = 15) -> DataFrame:
    """The most used tags of each category; subject_rank is null for brands."""
    rich = videos.filter(F.col("fetched") & ~F.col("unavailable"))
    each = rich.select(F.coalesce(category(), F.lit("")).alias("category"), "video_id", F.explode(norm_tags("tags")).alias("tag")).groupBy("category", "tag").agg(F.count_distinct("video_id").alias("videos"))
    j = each.join(tag_counts(videos).select("tag", "channels"), "tag")
    order = [F.col("videos").desc(), "tag"]
    subject = F.col("channels") >= SUBJECT_CHANNELS
    rank = F.row_number().over(Window.partitionBy("category").orderBy(*order))
    own = F.when(subject, F.row_number().over(Window.partitionBy("category", subject).orderBy(*order)))
    return j.withColumn("rank", rank).withColumn("subject_rank", own).filter((F.col("rank") <= k) | (F.col("subject_rank") <= k))


def donors(videos: DataFrame) -> DataFrame:
    """A row a bucket: videos without category by how uniform their channel is."""
    rich = F.col("fetched") & ~F.col("unavailable") & category().isNotNull()
    per = videos.filter(rich & F.col("channel_id").isNotNull()).groupBy("channel_id", category().alias("c")).agg(F.count("*").alias("n"))
    channel = per.groupBy("channel_id").agg(F.max("n").alias("top"), F.sum("n").alias("total"))
    label = F.when(F.col("top") == F.col("total"), BUCKETS[0][0])
    for name, percent in BUCKETS[1:]:
        label = label.when(F.col("top") * 100 >= F.col("total") * percent, name)
    plain = videos.filter(~rich).join(channel, "channel_id")
    over = F.col("total") >= DONOR_VIDEOS
    return plain.groupBy(label.alias("bucket")).agg(F.count("*").alias("videos"), F.sum("views").alias("views"), F.count_if(over).alias("videos_over"), F.sum(F.when(over, F.col("views")).otherwise(0)).alias("views_over"))


def donor_funnel(videos: DataFrame) -> DataFrame:
    rich = F.col("fetched") & ~F.col("unavailable") & category().isNotNull()
    lends = videos.filter(rich & F.col("channel_id").isNotNull()).select("channel_id").distinct().withColumn("_d", F.lit(True))
    plain = videos.filter(~rich).join(lends, "channel_id", "left")
    views = lambda c, name: F.coalesce(F.sum(F.when(c.isNotNull(), F.col("views"))), F.lit(0)).alias(name)
    return plain.agg(
        F.count("*").alias("no_category"), F.count("channel_id").alias("with_channel"), F.count("_d").alias("donor_found"),
        views(F.lit(1), "no_category_views"), views(F.col("channel_id"), "with_channel_views"), views(F.col("_d"), "donor_views"),
    )
