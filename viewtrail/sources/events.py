"""Binding of the event tables to the classified-view schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Users that share one viewer's timeline.
LANE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metadata_from_events(events: DataFrame) -> DataFrame:
    """One row per video: (user_id, k, duration_s, unavailable, gone_reason).

    A video's length comes from its first event, so every later view of it joins
    to the same length.
    """
    e = events.select("user_id", "ts", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    first = e.groupBy("user_id", "k").agg(F.min_by("value", "ts").alias("value"))
    k = F.col("k")
    reason = F.when(k <= 3, "private").when(k <= 5, "removed").when(k == 6, "terminated").when(k <= 8, "unavailable").when(k == 9, "age").when(k == 10, "members")
    return first.select(
        "user_id", "k",
        F.when(k < 12, 0).otherwise(F.floor(F.col("value") * 30)).cast("long").alias("duration_s"),
        (k < 12).alias("unavailable"), F.when(k < 12, reason).alias("gone_reason"),
    )


def views_from_events(events: DataFrame) -> DataFrame:
    """The classified views (fact rows) of an event table."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.select("event_id", F.col("ts").cast("timestamp").alias("watched_at"), "user_id", "event_type", k.alias("k"))
    joined = e.join(metadata_from_events(events), ["user_id", "k"], "left")
    k, user = F.col("k"), F.col("user_id")
    sub = F.when(k % 10 != 0, F.concat(F.lit("s"), F.expr("k div 10")))
    return joined.select(
        "event_id", F.expr(f"user_id div {LANE}").alias("viewer_id"), "watched_at", user.alias("channel_id"),
        F.concat(F.lit("channel-"), user).alias("channel"), F.concat(F.lit("v"), user, F.lit("_"), k).alias("video_id"),
        F.col("event_type").alias("area"), sub.alias("sub"), F.concat_ws("/", "event_type", sub).alias("topic"),
        F.when(k % 4 == 0, "consume").when(k % 4 == 1, "learn").when(k % 4 == 2, "mixed").alias("mode"),
        F.when(k % 5 == 0, "rule:r1").when(k % 5 <= 2, "llm:m1").when(k % 5 == 3, "category").otherwise("unclassified").alias("source"),
        (k / 100.0).alias("confidence"), "duration_s", "unavailable", "gone_reason",
    )


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views_from_events(table(spark, sf_dir, "events"))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.filter(F.col("c_custkey") % 7 == 0).select(F.col("c_custkey").alias("channel_id"), F.col("c_name").alias("title"))
