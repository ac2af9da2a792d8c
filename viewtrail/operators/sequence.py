"""Sequence operators over viewing timelines.

Windows over single views are partitioned by the viewer and a block of time, or
by more than that, so that they share one shuffle and one viewer's rows are
spread over tasks; what blocks must know of one another is a small table. What
depends on earlier answers is scanned session by session. Aggregates go from chains to days to viewers, so that rows are
summed before they are shuffled. Gaps and lengths are whole seconds. Rows without
a time take no part. Times are read on the session's wall clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SESSION_GAP_S, CHAIN_GAP_S, CHAIN_LEAST, BACKGROUND_S = 30 * 60, 15 * 60, 4, 1200
NIGHT_FROM, NIGHT_TO = 23, 5
#: Seconds of a block of a viewer's time.
BLOCK_S = 86_400
SESSION = ["viewer_id", "session_no"]


def _within(*keys: str):
    return Window.partitionBy(*keys).orderBy("watched_at", "event_id")


def _us(c: str | Column) -> Column:
    return F.unix_micros(c)


def is_night(ts: str | Column) -> Column:
    hour = F.hour(ts)
    return (hour >= NIGHT_FROM) | (hour < NIGHT_TO)


def _carry(dated: DataFrame, gap_us: int) -> DataFrame:
    """A row per viewer and block, with what its rows must know of the blocks about it.

    Blocks are summed where their rows lie; only the sums of a viewer, a row a
    block, meet in one window.
    """
    within = Window.partitionBy("viewer_id", "_block").orderBy("_t")
    step = F.col("_t") - F.lag("_t").over(within)
    inner = dated.select("viewer_id", "_block", _us("watched_at").alias("_t")).withColumn("_breaks", (step > gap_us).cast("int"))
    each = inner.groupBy("viewer_id", "_block").agg(F.min("_t").alias("first"), F.max("_t").alias("last"), F.coalesce(F.sum("_breaks"), F.lit(0)).alias("breaks"))
    by = Window.partitionBy("viewer_id").orderBy("_block")
    before, after = F.lag("last").over(by), F.lead("first").over(by)
    each = each.withColumns({"_before": before, "_after": after})
    begins = F.when(F.col("_before").isNull() | (F.col("first") - F.col("_before") > gap_us), 1).otherwise(0)
    each = each.withColumn("_starts", F.col("breaks") + begins)
    return each.select(
        F.col("viewer_id").alias("_viewer"), F.col("_block").alias("_of"), "_before", "_after",
        F.coalesce(F.sum("_starts").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_sessions"),
    )


def _cut(views: DataFrame, gap_s: int, block_s: int, channels: bool = False) -> DataFrame:
    """session_no and gap_s of dated views, block by block of each viewer's time.

    A viewer's rows are dealt by blocks of time, so that one viewer fills as many
    tasks as any number of viewers. A block's first row learns of the row before
    it, its last row of the row after it, and all rows of the sessions before
    them from a table of blocks. ``channels``: also new_channel, of the first view
    of a channel; the table of blocks then holds the block's views of that kind.
    """
    gap_us = gap_s * 1_000_000
    dated = views.filter(F.col("watched_at").isNotNull()).withColumn("_block", F.floor(_us("watched_at") / (block_s * 1_000_000)))
    carry = _carry(dated, gap_us)
    if channels:
        first = dated.filter(F.col("channel_id").isNotNull()).groupBy("viewer_id", "channel_id").agg(F.min(F.struct("watched_at", "event_id", "_block")).alias("f"))
        fresh = first.groupBy(F.col("viewer_id").alias("_fv"), F.col("f._block").alias("_fb")).agg(F.collect_list("f.event_id").alias("_fresh"))
        carry = carry.join(fresh, F.col("_viewer").eqNullSafe(F.col("_fv")) & (F.col("_of") == F.col("_fb")), "left").drop("_fv", "_fb")
    rows = dated.join(carry, F.col("viewer_id").eqNullSafe(F.col("_viewer")) & (F.col("_block") == F.col("_of")))
    w, t = _within("viewer_id", "_block"), _us("watched_at")
    before, after = F.coalesce(F.lag(t).over(w), "_before"), F.coalesce(F.lead(t).over(w), "_after")
    rows = rows.withColumns({"_new": F.when(before.isNull() | (t - before > gap_us), 1).otherwise(0), "gap_s": F.when(after - t <= gap_us, F.floor((after - t) / 1_000_000)).cast("long")})
    if channels:
        rows = rows.withColumn("new_channel", F.coalesce(F.array_contains("_fresh", F.col("event_id")), F.lit(False)))
    rows = rows.withColumn("_nth", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("session_no", F.col("_sessions") + F.col("_nth"))
    return rows.select(*views.columns, "session_no", "gap_s", *(["new_channel"] if channels else []))


def sessionize(views: DataFrame, gap_s: int = SESSION_GAP_S, block_s: int = BLOCK_S) -> DataFrame:
    """Adds session_no (from 1, oldest first) and gap_s to the session's next start: a longer gap starts a session."""
    return _cut(views, gap_s, block_s)


def mark_edges(rows: DataFrame) -> DataFrame:
    """Adds edge: what the gap to the next start says."""
    gap, length = F.col("gap_s"), F.coalesce(F.col("duration_s"), F.lit(0))
    edge = F.when(gap.isNull() | (length <= 0), F.lit(None)).when(gap >= length, "through").when(2 * gap < length, "skipped").otherwise("most")
    return rows.withColumn("edge", edge)


#: What the scan of a session adds to its rows, in Spark's and Arrow's types.
SCANNED = [("overlap", "boolean", pa.bool_()), ("place", "integer", pa.int32()), ("session_start", "timestamp", pa.timestamp("us", "UTC")), ("area_before", "string", pa.string()), ("chain_no", "integer", pa.int32()), ("seconds", "long", pa.int64())]


def scan_sessions(rows: DataFrame, least_s: int = BACKGROUND_S, chain_gap_s: int = CHAIN_GAP_S, together: bool = False) -> DataFrame:
    """Adds overlap, place, session_start, area_before, chain_no and seconds.

    A row overlaps if it runs beside the last row that doesn't, which depends on
    earlier answers and can't be said by a window function. A main-lane row goes
    on with the island of the last main-lane row before it, or begins one where
    the area or too long a gap breaks it; rows beside the main lane stand in the
    island they run in. ``seconds`` is the running sum of lengths. The session's
    rows are sorted in their partition and scanned once; only one row's state is
    held, so a session of any length fits. ``together``: the rows of a session
    are in one partition already.
    """
    schema = StructType([*rows.schema.fields])
    for name, kind, _ in SCANNED:
        schema = schema.add(name, kind)
    at = {c: rows.columns.index(c) for c in (*SESSION, "watched_at", "duration_s", "area")}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = None
        start = end = last = place = chain = total = 0
        area, long = None, False
        for batch in batches:
            column = lambda c: batch.column(at[c])  # noqa: B023, E731
            out = [], [], [], [], [], []
            times = column("watched_at").cast(pa.int64()).to_pylist()
            for viewer, number, t, length, topic in zip(column("viewer_id").to_pylist(), column("session_no").to_pylist(), times, column("duration_s").to_pylist(), column("area").to_pylist(), strict=True):
                length = int(length or 0)
                if session != (viewer, number):
                    session, start, place, chain, total, beside, before, area = (viewer, number), t, 0, 0, 0, False, None, None
                else:
                    beside, before = long and t < end and topic != area, area
                place, total = place + 1, total + length
                if not beside:
                    if chain == 0 or topic != area or t - last > chain_gap_s * 1_000_000:
                        chain += 1
                    end, last, area, long = t + length * 1_000_000, t, topic, length >= least_s
                for values, value in zip(out, (beside, place, start, before, chain, total), strict=True):
                    values.append(value)
            added = [pa.array(values, kind) for values, (_, _, kind) in zip(out, SCANNED, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema=pa.schema([*batch.schema, *((name, kind) for name, _, kind in SCANNED)]))

    own = rows if together else rows.repartition(*SESSION)
    return own.sortWithinPartitions(*SESSION, "watched_at", "event_id").mapInArrow(scan, schema)


def timeline(views: DataFrame, chain_gap_s: int = CHAIN_GAP_S, block_s: int = BLOCK_S, channels: bool = True) -> DataFrame:
    """All dated views with session, edge and what the scan adds; ``channels``: with the first view of each channel, if views have one."""
    rows = mark_edges(_cut(views, SESSION_GAP_S, block_s, channels and "channel_id" in views.columns))
    return scan_sessions(rows, chain_gap_s=chain_gap_s)


def main_lane(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("overlap"))


def sessions(rows: DataFrame) -> DataFrame:
    """One row per session: start, last start, views, seconds, gap before."""
    each = rows.groupBy(*SESSION).agg(F.min("watched_at").alias("started"), F.max("watched_at").alias("ended"), F.count("*").alias("views"), F.sum("duration_s").alias("duration_s"))
    w = Window.partitionBy("viewer_id").orderBy("session_no")
    gap = F.floor((_us("started") - _us(F.lag("ended").over(w))) / 1_000_000).cast("long")
    newest = F.row_number().over(Window.partitionBy("viewer_id").orderBy(F.col("session_no").desc()))
    return each.withColumn("gap_before_s", F.coalesce(gap, F.lit(0))).withColumn("ordinal", newest - 1)


def chains(rows: DataFrame, least: int = CHAIN_LEAST) -> DataFrame:
    """Runs of one area: ordinal, len, area, span_s, duration_s, door, place range.

    Lengths count main-lane rows; the duration sums all rows of the range, as a
    difference of running sums.
    """
    edged, length = F.when(F.col("edge").isNotNull(), F.col("place")), F.coalesce("duration_s", F.lit(0))
    each = main_lane(rows).groupBy(*SESSION, "chain_no").agg(
        F.count("*").alias("len"), F.first("area").alias("area"), F.min("place").alias("first_place"), F.max("place").alias("last_place"),
        F.min("watched_at").alias("started"), F.max("watched_at").alias("ended"), F.min_by("area_before", "place").alias("door"),
        F.count_distinct("channel_id").alias("channels"), F.count_if(F.col("edge") == "through").alias("held"), F.count("edge").alias("edged"),
        F.max_by("edge", edged).alias("exit_edge"), (F.max_by("seconds", "place") - F.min_by(F.col("seconds") - length, "place")).alias("duration_s"),
    )
    ordinal = F.row_number().over(Window.partitionBy(*SESSION).orderBy("chain_no"))
    span = F.floor((_us("ended") - _us("started")) / 1_000_000).cast("long")
    return each.filter(F.col("len") >= least).withColumn("span_s", span).withColumn("ordinal", ordinal)


#: What chains are ranked by; newest first on ties.
CHAIN_KEYS = {"depth": "len", "span": "span_s", "hours": "duration_s", "channels": "channels", "held": "CASE WHEN edged > 0 THEN held / edged ELSE -1 END", "date": "0"}
#: The same of days.
DAY_KEYS = {
    "peak": "peak", "views": "views", "chain": "chain_max", "night": "CASE WHEN views > 0 THEN night_views / views ELSE 0 END", "hours": "duration_s",
    "areas": "areas", "held": "CASE WHEN edged > 0 THEN through / edged ELSE -1 END", "new": "new_channels", "date": "epoch_day",
}


def ranked(found: DataFrame, key: str, keys: dict[str, str], newest: str, k: int | None = None, area: str | None = None) -> DataFrame:
    """Chains or days by a key, the newest first on ties, of one area or of all; ``by`` is the key's value."""
    own = (found if area is None else found.filter(F.col("area") == area)).withColumn("by", F.expr(keys[key]).cast("double"))
    own = own.orderBy(F.col("by").desc(), F.col(newest).desc(), "viewer_id")
    return own if k is None else own.limit(k)


def _chain_sums(rows: DataFrame) -> DataFrame:
    """A row per viewer, day of the session's start, session and island."""
    lane = ~F.col("overlap")
    count = lambda c: F.count_if(lane & c)
    fresh = F.count_if("new_channel") if "new_channel" in rows.columns else F.lit(0).cast("long")
    return rows.groupBy("viewer_id", F.date_format("session_start", "yyyy-MM-dd").alias("day"), "session_no", "chain_no").agg(
        F.count("*").alias("views"), F.count_if(lane).alias("len"), F.min_by("area", "place").alias("area"), F.sum("duration_s").alias("duration_s"), F.min("watched_at").alias("started"), F.count_if(F.col("place") == 1).alias("sessions"),
        count(is_night("watched_at")).alias("night_views"), count(F.col("edge") == "through").alias("through"), count(F.col("edge").isNotNull()).alias("edged"), fresh.alias("new_channels"),
    )


def dominant(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each group, the least on ties."""
    return rows.groupBy(*keys).agg(F.mode(value, deterministic=True).alias(name))


def days(rows: DataFrame, least: int = CHAIN_LEAST) -> DataFrame:
    """A row per viewer and day on which a session began; all its views count there."""
    deep = F.when(F.col("len") >= least, F.col("len"))
    sums = ("views", "duration_s", "sessions", "night_views", "through", "edged", "new_channels")
    by_area = _chain_sums(rows).repartition("viewer_id", "day").groupBy("viewer_id", "day", "area").agg(
        F.sum("len").alias("_lane"), F.coalesce(F.sum(deep), F.lit(0)).alias("chain_views"), F.max(deep).alias("chain_max"), F.min("session_no").alias("session_from"), F.max("session_no").alias("session_to"), *(F.sum(c).alias(c) for c in sums)
    )
    each = by_area.groupBy("viewer_id", "day").agg(
        F.min_by("area", F.struct((-F.col("_lane")).alias("n"), "area")).alias("area"), F.count_if((F.col("_lane") > 0) & F.col("area").isNotNull()).alias("areas"), F.sum("chain_views").alias("chain_views"), F.coalesce(F.max("chain_max"), F.lit(0)).alias("chain_max"),
        F.min("session_from").alias("session_from"), F.max("session_to").alias("session_to"), *(F.sum(c).alias(c) for c in sums),
    )
    return each.withColumn("epoch_day", F.unix_date(F.to_date("day")))


def peaks(found: DataFrame) -> DataFrame:
    """Adds peak (0 to 1000) and its axis: the share of days with strictly less."""
    night = F.when(F.col("views") == 0, 0.0).otherwise(F.col("night_views") / F.col("views"))
    axes = {"views": F.col("views").cast("double"), "chain": F.col("chain_max").cast("double"), "night": night, "areas": F.col("areas").cast("double")}
    total = F.count("*").over(Window.partitionBy("viewer_id"))
    ranked = found
    for name, value in axes.items():
        below = F.rank().over(Window.partitionBy("viewer_id").orderBy(value)) - 1
        ranked = ranked.withColumn(f"_{name}", F.floor(below * 1000 / total).cast("int"))
    ranked = ranked.withColumn("peak", F.greatest(*(f"_{a}" for a in axes)))
    axis = F.when(F.col("peak") == 0, F.lit(None))
    for name in axes:
        axis = axis.when(F.col(f"_{name}") == F.col("peak"), name)
    return ranked.withColumn("peak_axis", axis).drop(*(f"_{a}" for a in axes))


def transitions(rows: DataFrame) -> DataFrame:
    """(viewer_id, from_area, to_area, n, days): main-lane steps inside sessions."""
    steps = main_lane(rows).filter(F.col("place") > 1).withColumn("day", F.date_format("session_start", "yyyy-MM-dd"))
    each = steps.groupBy("viewer_id", F.col("area_before").alias("from_area"), F.col("area").alias("to_area"), "day").agg(F.count("*").alias("n"))
    return each.groupBy("viewer_id", "from_area", "to_area").agg(F.sum("n").alias("n"), F.count("*").alias("days"))


def positions(rows: DataFrame) -> DataFrame:
    """Main-lane views per area and place in the session: 1, 2, 3, 4-6, 7-10, 11+."""
    n = F.row_number().over(_within(*SESSION))
    bucket = F.when(F.col("n") <= 3, F.col("n").cast("string")).when(F.col("n") <= 6, "4-6").when(F.col("n") <= 10, "7-10").otherwise("11+")
    return main_lane(rows).withColumn("n", n).groupBy("viewer_id", bucket.alias("bucket"), "area").agg(F.count("*").alias("views"))


def retention(rows: DataFrame) -> DataFrame:
    """Main-lane views by area, what their gaps say, and shares in millionths."""
    e = F.col("edge")
    each = main_lane(rows).groupBy("viewer_id", "area").agg(F.count("*").alias("main"), F.count_if(e == "through").alias("through"), F.count_if(e == "most").alias("most"), F.count_if(e == "skipped").alias("skipped"))
    total = F.sum("main").over(Window.partitionBy("viewer_id"))
    edged = F.col("through") + F.col("most") + F.col("skipped")
    return each.withColumn("share", F.floor(F.col("main") * 1_000_000 / total).cast("long")).withColumn("held", F.coalesce(F.floor(F.try_divide(F.col("through") * 1_000_000, edged)), F.lit(0)).cast("long"))


def first_contacts(rows: DataFrame, days_after: int = 30) -> DataFrame:
    """Per channel: first and last time, views, and those within so many days."""
    first = F.min("watched_at").over(Window.partitionBy("viewer_id", "channel_id"))
    near = _us("watched_at") - _us("first_at") <= days_after * 86_400_000_000
    seen = rows.filter(F.col("channel_id").isNotNull()).withColumn("first_at", first)
    return seen.groupBy("viewer_id", "channel_id").agg(F.min("first_at").alias("first_at"), F.max("watched_at").alias("last_at"), F.count("*").alias("views"), F.count_if(near).alias("n30"))


def session_areas(rows: DataFrame) -> DataFrame:
    each = main_lane(rows).groupBy(*SESSION, "area").agg(F.count("*").alias("views"))
    w = Window.partitionBy(*SESSION).orderBy(F.col("views").desc(), "area")
    return each.withColumn("rank", F.row_number().over(w))


def headline(rows: DataFrame, least: int = CHAIN_LEAST) -> DataFrame:
    """One row per viewer: totals, longest session, deepest chain, busiest day; the newest on ties.

    One pass over the timeline: islands, sessions, days and viewers are summed in turn.
    """
    deep = F.col("len") >= least
    at = F.struct("len", "started", "session_no")
    session = _chain_sums(rows).repartition("viewer_id").groupBy("viewer_id", "day", "session_no").agg(
        F.sum("views").alias("views"), F.sum(F.col("views") - F.col("len")).alias("overlap_views"), F.sum("duration_s").alias("duration_s"), F.max(F.when(deep, at)).alias("deepest"), F.sum(F.when(deep, F.col("len"))).alias("chain_views")
    )
    own = [F.sum(c).alias(c) for c in ("overlap_views", "duration_s", "chain_views")]
    day = session.groupBy("viewer_id", "day").agg(F.sum("views").alias("views"), F.count("*").alias("sessions"), F.max(F.struct("views", "session_no")).alias("longest"), F.max("deepest").alias("deepest"), *own)
    out = day.groupBy("viewer_id").agg(F.sum("views").alias("views"), F.sum("sessions").alias("sessions"), F.max("longest").alias("l"), F.max("deepest").alias("d"), F.max(F.struct("views", "day")).alias("b"), *own)
    return out.select(
        "viewer_id", "views", "sessions", "overlap_views", "duration_s", F.col("l.session_no").alias("longest_session"), F.col("l.views").alias("longest_views"), F.coalesce("d.len", F.lit(0)).alias("deepest_chain"), F.col("d.session_no").alias("deepest_session"), F.col("d.started").alias("deepest_started"),
        F.coalesce("chain_views", F.lit(0)).alias("chain_views"), F.col("b.day").alias("busiest_day"), F.col("b.views").alias("busiest_views"),
    )


def neighbourhood(found: DataFrame, reach: int = 10) -> DataFrame:
    """For each day with sessions: the views of so many such days about it."""
    w = Window.partitionBy("viewer_id").orderBy("day")
    near = w.rowsBetween(-reach, reach)
    return found.select("viewer_id", "day", F.count("*").over(near).alias("near_days"), F.sum("views").over(near).alias("near_views"), F.lag("day").over(w).alias("day_before"), F.lead("day").over(w).alias("day_after"))


def lenses(found: DataFrame) -> DataFrame:
    """Each measure of a day against the viewer's most, in thousandths."""
    w = Window.partitionBy("viewer_id")
    share = lambda c: F.coalesce(F.floor(F.try_divide(F.col(c) * 1000, F.max(c).over(w))), F.lit(0)).cast("long").alias(f"{c}_lens")
    return found.select("viewer_id", "day", *map(share, ("views", "duration_s", "chain_max", "night_views", "areas", "new_channels")))


def session_neighbours(found: DataFrame) -> DataFrame:
    """Sessions with the day they stand on and the starts of the viewer's older and newer ones."""
    w = Window.partitionBy("viewer_id").orderBy("session_no")
    return found.select("viewer_id", "session_no", F.date_format("started", "yyyy-MM-dd").alias("day"), F.lag("started").over(w).alias("older"), F.lead("started").over(w).alias("newer"))


def chain_neighbours(found: DataFrame) -> DataFrame:
    """Chains with their place among their session's and the starts of the earlier and later one."""
    w = Window.partitionBy(*SESSION).orderBy("ordinal")
    return found.select(*SESSION, "ordinal", F.count("*").over(Window.partitionBy(*SESSION)).alias("of"), F.lag("started").over(w).alias("earlier"), F.lead("started").over(w).alias("later"))
