"""Positional JSON of a viewer's sessions, chains, days and transitions.

Rows point at one another by place: sessions stand newest first, each before its
own views, days oldest first, areas by name. Times are seconds after the
viewer's first view. Names are numbers of a viewer's dictionaries, dense from 0
by first appearance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequence as q

AXES = ("views", "chain", "night", "areas")


def _json(*parts) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(p.cast("string"), F.lit("-1")) for p in parts)), F.lit("]"))


def payload(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """(viewer_id, kind, place, payload); rows: a timeline that is read several times; areas: (area, area_no)."""
    own = Window.partitionBy("viewer_id")
    named = F.broadcast(areas)  # a row an area, as the config lists them
    seconds = lambda c: F.floor(F.unix_micros(c) / 1_000_000).cast("long")
    s = q.sessions(rows).withColumn("t0", F.min("started").over(own))
    newer = F.coalesce(F.sum("views").over(own.orderBy(F.col("session_no").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("row", F.col("ordinal") + newer).withColumn("span", F.floor((F.unix_micros("ended") - F.unix_micros("started")) / 1_000_000).cast("long"))
    sitting = s.select("viewer_id", F.lit("session").alias("kind"), F.col("ordinal").cast("long").alias("place"), _json(F.col("row"), seconds("started") - seconds("t0"), F.col("span"), F.col("views"), F.col("gap_before_s")).alias("payload"))

    found = q.chains(rows).join(s.select(*q.SESSION, F.col("ordinal").alias("sitting"), "row"), q.SESSION).join(named, "area")
    nth = F.row_number().over(own.orderBy(F.col("session_no").desc(), "chain_no")) - 1
    chain = found.select("viewer_id", F.lit("chain").alias("kind"), nth.cast("long").alias("place"), _json(F.col("sitting"), F.col("row") + F.col("first_place"), F.col("row") + F.col("last_place"), F.col("len"), F.col("area_no"), F.col("span_s"), F.col("duration_s")).alias("payload"))

    per_day = q.peaks(q.days(rows)).join(named, "area", "left")
    axis = F.array_position(F.array(*map(F.lit, AXES)), F.col("peak_axis")) - 1
    facts = ("epoch_day", "views", "area_no", "session_from", "session_to", "duration_s", "chain_views", "chain_max", "night_views", "areas", "through", "edged", "new_channels", "peak")
    day = per_day.select("viewer_id", F.lit("day").alias("kind"), (F.row_number().over(own.orderBy("day")) - 1).cast("long").alias("place"), _json(*map(F.col, facts), axis).alias("payload"))

    steps = q.transitions(rows).join(named.select(F.col("area").alias("from_area"), F.col("area_no").alias("f")), "from_area").join(named.select(F.col("area").alias("to_area"), F.col("area_no").alias("t")), "to_area")
    step = steps.select("viewer_id", F.lit("transition").alias("kind"), (F.row_number().over(own.orderBy(F.col("n").desc(), "f", "t")) - 1).cast("long").alias("place"), _json(F.col("f"), F.col("t"), F.col("n")).alias("payload"))
    return reduce(DataFrame.unionByName, (sitting, chain, day, step))


EDGES = ("through", "most", "skipped")


def dictionary(rows: DataFrame, column: str, block_s: int = q.BLOCK_S) -> DataFrame:
    """(viewer_id, value, no): a viewer's values but null, numbered by first appearance.

    Values are numbered within the block of time that they first appear in;
    blocks add the numbers of the blocks before them. So only counts, a row a
    block, meet in a window over a viewer.
    """
    own = rows.filter(F.col("watched_at").isNotNull() & F.col(column).isNotNull())
    first = own.groupBy("viewer_id", F.col(column).alias("value")).agg(F.min(F.struct("watched_at", "event_id")).alias("at"))
    first = first.withColumn("block", F.floor(F.unix_micros("at.watched_at") / (block_s * 1_000_000)))
    by = Window.partitionBy("_viewer").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = first.groupBy(F.col("viewer_id").alias("_viewer"), F.col("block").alias("_of")).agg(F.count("*").alias("n"))
    before = before.select("_viewer", "_of", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("viewer_id", "block").orderBy("at", "value")) - 1
    each = first.join(before, F.col("viewer_id").eqNullSafe(F.col("_viewer")) & (F.col("block") == F.col("_of")))
    return each.select("viewer_id", "value", (F.col("before") + nth).cast("long").alias("no"))


def view_rows(rows: DataFrame, columns: tuple[str, ...], block_s: int = q.BLOCK_S) -> DataFrame:
    """(viewer_id, place, payload) of each view of a timeline that is read several times.

    The payload holds the seconds after the viewer's first view, the numbers of
    the columns' values, the length, the edge and whether the view overlaps; -1
    is none.
    """
    s = q.sessions(rows)
    own = Window.partitionBy("viewer_id")
    newer = F.coalesce(F.sum("views").over(own.orderBy(F.col("session_no").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.select(F.col("viewer_id").alias("_viewer"), F.col("session_no").alias("_session"), (F.col("ordinal") + newer).alias("_row"), F.min("started").over(own).alias("_t0"))
    each = rows.join(s, F.col("viewer_id").eqNullSafe(F.col("_viewer")) & (F.col("session_no") == F.col("_session")))
    for k, column in enumerate(columns):
        d = dictionary(rows, column, block_s).select(F.col("viewer_id").alias(f"_v{k}"), F.col("value").alias(f"_x{k}"), F.col("no").alias(f"_no{k}"))
        each = each.join(d, F.col("viewer_id").eqNullSafe(F.col(f"_v{k}")) & (F.col(column) == F.col(f"_x{k}")), "left")
    seconds = lambda c: F.floor(F.unix_micros(c) / 1_000_000).cast("long")
    edge = F.array_position(F.array(*map(F.lit, EDGES)), F.col("edge")) - 1
    parts = [seconds("watched_at") - seconds("_t0"), *(F.col(f"_no{k}") for k in range(len(columns))), F.col("duration_s"), edge, F.col("overlap").cast("int")]
    return each.select("viewer_id", (F.col("_row") + F.col("place")).cast("long").alias("place"), _json(*parts).alias("payload"))
