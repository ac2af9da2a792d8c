"""Report aggregates over classified views, and the top-k rules they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import area_of, confidence_text, sub_of

MODES = ["consume", "learn", "mixed", "unclear"]
NO_SUBJECT, NO_CHANNEL = "(no subject)", "(no channel)"


def mode_or_unclear():
    return F.coalesce(F.nullif("mode", F.lit("")), F.lit("unclear"))


def top_k(df: DataFrame, keys: list[str], by: list, k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group in a total order; no keys: of the table."""
    if not keys:
        return df.orderBy(*by).limit(k)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col(rank) <= k)


def source_bucket(source):
    s = F.coalesce(F.col(source), F.lit(""))
    return F.when(s.startswith("rule:"), "rule").when(s.startswith("llm:"), "llm").when(s == "category", "category").otherwise("unclassified")


def headline(views: DataFrame) -> DataFrame:
    return views.agg(
        F.count("*").alias("views"), F.count_distinct(F.nullif("video_id", F.lit(""))).alias("videos"), F.sum("duration_s").alias("duration_s"), F.count_if(F.coalesce("video_id", F.lit("")) == "").alias("no_id"),
        F.count_if("unavailable").alias("unavailable"), F.min("watched_at").alias("from_at"), F.max("watched_at").alias("to_at"),
    )


def gone_reasons(views: DataFrame) -> DataFrame:
    reason = F.coalesce(F.nullif("gone_reason", F.lit("")), F.lit("unknown"))
    return views.filter("unavailable").groupBy(reason.alias("reason")).agg(F.count("*").alias("views"))


def topic_rollup(views: DataFrame) -> DataFrame:
    """Areas, and subjects under them: views, duration, commonest mode.

    Views of a bare area count in the area alone; sub is null on area rows.
    """
    rows = views.select(area_of("topic").alias("area"), F.nullif(sub_of("topic"), F.lit("")).alias("sub"), "duration_s", mode_or_unclear().alias("mode"))
    out = rows.rollup("area", "sub").agg(F.count("*").alias("views"), F.sum("duration_s").alias("duration_s"), F.mode("mode", deterministic=True).alias("mode"), F.grouping_id().alias("level"))
    return out.filter((F.col("level") == 1) | ((F.col("level") == 0) & F.col("sub").isNotNull())).drop("level")


def months(views: DataFrame) -> DataFrame:
    """A row a month: views and seconds of each mode, views of unknown length too; an absent mode has none."""
    rows = views.filter(F.col("watched_at").isNotNull()).select(F.date_format("watched_at", "yyyy-MM").alias("month"), mode_or_unclear().alias("mode"), "duration_s")
    wide = rows.groupBy("month").pivot("mode", MODES).agg(F.count(F.lit(1)).alias("views"), F.sum("duration_s").alias("seconds"))
    return wide.fillna(0, [c for c in wide.columns if c != "month"])


def channels(views: DataFrame, subscriptions: DataFrame) -> DataFrame:
    named = views.filter(F.col("channel") != "")
    each = named.groupBy("channel", "channel_id").agg(F.count("*").alias("views"), F.sum("duration_s").alias("duration_s"), F.mode("topic", deterministic=True).alias("top_topic"))
    known = subscriptions.select("channel_id").distinct().withColumn("_sub", F.lit(True))
    return each.join(known, "channel_id", "left").withColumn("subscribed", F.coalesce("_sub", F.lit(False))).drop("_sub")


def subscription_rows(views: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every subscription with what was watched of it; dead ones have no views."""
    seen = views.groupBy("channel_id").agg(F.count("*").alias("views"), F.sum("duration_s").alias("duration_s"), F.max("watched_at").alias("last_at"), F.mode("topic", deterministic=True).alias("top_topic"))
    out = subscriptions.join(seen, "channel_id", "left")
    return out.withColumn("dead", F.col("views").isNull()).fillna(0, ["views", "duration_s"])


def topic_tree(rows: DataFrame) -> DataFrame:
    """Area, subject and channel with views and seconds at all three levels."""
    named = rows.select("viewer_id", "area", F.coalesce(F.nullif("sub", F.lit("")), F.lit(NO_SUBJECT)).alias("sub"), F.coalesce(F.nullif("channel", F.lit("")), F.lit(NO_CHANNEL)).alias("channel"), "duration_s")
    out = named.groupBy("viewer_id", "area", "sub", "channel").agg(F.count("*").alias("views"), F.sum("duration_s").alias("duration_s"))
    return out.groupingSets([["viewer_id", "area"], ["viewer_id", "area", "sub"], ["viewer_id", "area", "sub", "channel"]], "viewer_id", "area", "sub", "channel").agg(F.sum("views").alias("views"), F.sum("duration_s").alias("duration_s"))


def csv_rows(views: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The 13 columns of the flat export, by their names there; times in UTC."""
    known = subscriptions.filter(F.coalesce(F.col("channel_id").cast("string"), F.lit("")) != "").select("channel_id").distinct().withColumn("_sub", F.lit(True))
    utc = F.to_utc_timestamp("watched_at", F.current_timezone())
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return views.join(known, "channel_id", "left").select(
        text("video_id").alias("videoID"), text("title").alias("title"), text("channel").alias("channel"), text("channel_id").alias("channelID"),
        F.coalesce(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")).alias("watchedAt"), "topic", area_of("topic").alias("area"), text("mode").alias("mode"), "source",
        confidence_text("confidence").alias("confidence"), F.coalesce("duration_s", F.lit(0)).alias("durationS"), F.coalesce("_sub", F.lit(False)).alias("subscribed"), F.coalesce("unavailable", F.lit(False)).alias("unavailable"),
    )
