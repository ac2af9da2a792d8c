"""Structured Streaming: sessions, late rows, facts that wait for their row, and waves of new metadata."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.sequence import SESSION_GAP_S


def session_windows(events: DataFrame, gap_s: int = SESSION_GAP_S, late: str = "1 hour") -> DataFrame:
    """Sessions of each viewer from a stream; they close behind the watermark.

    In append mode a session comes out when the watermark is a gap behind its
    last row, open ones stay in state, and rows whose own session would be closed
    are dropped (``LateRows`` keeps them); rows that come between are pieces of
    their own, which ``rejoined`` puts together. In complete mode open ones come out,
    too, and nothing is given up.
    """
    window = F.session_window("watched_at", f"{gap_s} seconds")
    each = events.withWatermark("watched_at", late).groupBy("viewer_id", window).agg(F.count("*").alias("views"), F.sum("duration_s").alias("duration_s"), F.max("watched_at").alias("ended"))
    return each.select("viewer_id", F.col("session_window.start").alias("started"), "ended", "views", "duration_s")


def rejoined(pieces: DataFrame, gap_s: int = SESSION_GAP_S) -> DataFrame:
    """Whole sessions from those that ``session_windows`` gave in append mode.

    A row may be less late than its session: it comes after that has closed, but
    its own time isn't a gap behind the watermark, so it is taken and starts a
    piece of its own. Pieces of a viewer that are no gap apart are one session.
    """
    w = Window.partitionBy("viewer_id").orderBy("started")
    new = F.coalesce(F.unix_micros("started") - F.lag(F.unix_micros("ended")).over(w) > gap_s * 1_000_000, F.lit(True))
    numbered = pieces.withColumn("_new", new.cast("long")).withColumn("_session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("viewer_id", "_session").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("views").alias("views"), F.sum("duration_s").alias("duration_s"))
    return whole.drop("_session")


@dataclass
class LateRows:
    """The rows that ``session_windows`` drops, from the same files in the same batches.

    A batch is held against the watermark of the batches before the last one, as
    Spark does: rows whose session would have ended by then are late. Each batch
    leaves a folder of late rows and its latest time, overwritten if the batch is
    repeated.
    """

    folder: str
    gap_s: int = SESSION_GAP_S
    late_s: int = 3600

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, latest = batch.sparkSession, Observation(f"latest-{uuid.uuid4().hex}")
        known = spark.read.schema("batch long, us long").option("basePath", f"{self.folder}/latest").json(f"{self.folder}/latest/batch=*") if number > 1 else None
        mark = known.filter(F.col("batch") <= number - 2).agg(F.max("us")).first()[0] if known is not None else None
        mark = -(2**62) if mark is None else (mark // 1000 - self.late_s * 1000) * 1000
        seen = batch.observe(latest, F.max(F.unix_micros("watched_at")).alias("us"))
        seen.filter(F.unix_micros("watched_at") + self.gap_s * 1_000_000 <= mark).write.mode("overwrite").parquet(f"{self.folder}/late/batch={number}")
        spark.createDataFrame([(latest.get["us"],)], "us long").coalesce(1).write.mode("overwrite").json(f"{self.folder}/latest/batch={number}")


def held_facts(facts: DataFrame, dimension: DataFrame, key: str, value: str, wait: str, keep: str, late: str = "1 hour") -> DataFrame:
    """A stream of facts (``heard_at``) beside their row of a stream of keyed rows (``known_at``).

    A fact waits in state for its key's row, which may come up to ``wait`` after
    it or have come up to ``keep`` before; once the watermarks of both streams
    have passed that time it is given up as alone. Both sides' state goes with
    the watermark.
    """
    f = facts.withWatermark("heard_at", late)
    d = dimension.withWatermark("known_at", late).select(F.col(key).alias("_key"), "known_at", F.col(value).alias(value))
    near = (F.col("known_at") >= F.col("heard_at") - F.expr(f"INTERVAL {keep}")) & (F.col("known_at") <= F.col("heard_at") + F.expr(f"INTERVAL {wait}"))
    joined = f.join(d, (F.col(key) == F.col("_key")) & near, "left")
    return joined.select(*facts.columns, value, F.when(F.col("_key").isNotNull(), "known").otherwise("alone").alias("state"))


@dataclass
class Waves:
    """A merge of micro-batches into a dimension, and waves that compute the whole output anew.

    Each batch is a folder of its own, overwritten if the batch is repeated, so
    that a dimension row counts once; of rows of one key the last batch's stays.
    A wave runs when enough rows have come, or enough time has gone, since the
    one before. ``recompute(dimension, number, last)`` rewrites the output.
    """

    folder: str
    key: str
    schema: StructType
    recompute: Callable[[DataFrame, int, bool], None]
    least: int = 200
    every_s: float = 60.0
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self):
        self.pending, self.number, self.at = 0, 0, self.clock()

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, seen = batch.sparkSession, Observation(f"rows-{uuid.uuid4().hex}")
        batch.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        self.pending += seen.get["n"]
        if self.pending >= self.least or self.clock() - self.at >= self.every_s:
            self.wave(spark)

    def dimension(self, spark: SparkSession) -> DataFrame:
        rows = F.struct(*self.schema.names)
        every = spark.read.schema(StructType([*self.schema.fields]).add("batch", "long"))
        try:
            held = every.option("basePath", self.folder).parquet(f"{self.folder}/batch=*")
        except AnalysisException:  # nothing has come yet
            return spark.createDataFrame([], self.schema)
        return held.groupBy(self.key).agg(F.max_by(rows, "batch").alias("_row")).select("_row.*")

    def wave(self, spark: SparkSession, last: bool = False) -> None:
        self.number += 1
        self.recompute(self.dimension(spark), self.number, last)
        self.pending, self.at = 0, self.clock()


def run_waves(source: DataFrame, merge: Waves, checkpoint: str, seconds: int | None = None) -> None:
    """A wave over what earlier runs left, waves while rows come, and a last one.

    Without seconds what there is is swept up; with them the source is asked so
    often until the query is stopped. What was read is kept in the checkpoint, so
    that an interrupted run goes on where it stood.
    """
    spark = source.sparkSession
    merge.wave(spark)
    writer = source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start().awaitTermination()
    merge.wave(spark, last=True)


def waiting_facts(facts: DataFrame, dimension: DataFrame, key: str, last: bool) -> DataFrame:
    """Facts beside their dimension row and state: known, waiting, or alone after the last wave."""
    joined = facts.join(dimension.withColumn("_hit", F.lit(True)), key, "left")
    return joined.withColumn("state", F.when(F.col("_hit"), "known").otherwise("alone" if last else "waiting")).drop("_hit")
