"""Timelines on a stream: sessions, overlaps and chains from rows in any order.

Rows wait in a viewer's list state, a packed Arrow batch an element, until the
watermark has passed them; then no earlier row can come, and they are scanned in
time order from the viewer's value
state: the last row, the main lane and the open island of the open session. An
event-time timer closes a session once the watermark is a gap behind its last
row, and with it the viewer's state goes: idle viewers hold none.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.sequence import BACKGROUND_S, CHAIN_GAP_S, CHAIN_LEAST, SESSION_GAP_S

#: What comes out: a row per view, one per closed chain, one per closed session.
OUT = "kind string, viewer_id long, event_id long, session_us long, at_us long, overlap boolean, area string, len long, span_s long, duration_s long"
_OPEN = "start long, last long, views long, seconds long, lane long, until long, area string, long boolean, c_area string, c_len long, c_start long, c_last long, c_from long, c_to long"
_OPEN_NAMES = [part.split()[0] for part in _OPEN.split(", ")]
#: The provider of state that timers and several states of a key need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_KINDS = {name: {"string": "object", "long": "Int64", "boolean": "boolean"}[kind] for name, kind in (part.split() for part in OUT.split(", "))}
#: Columns of the rows that wait, and how many stand in one packed batch.
_WAITING, PACKED = {"t": "int64", "event_id": "int64", "area": "string", "duration_s": "int64"}, 10_000


def _frame(out: list) -> pd.DataFrame:
    columns = zip(*out, strict=True) if out else [()] * len(_KINDS)
    return pd.DataFrame({name: pd.array(list(x), dtype=kind) if kind != "object" else pd.Series(x, dtype=kind) for (name, kind), x in zip(_KINDS.items(), columns, strict=True)})


def _schema() -> pa.Schema:
    return pa.schema([(name, kind) for name, kind in _WAITING.items()])


def _packed(rows: pa.Table) -> list[tuple[bytes]]:
    """The rows as elements of the list state."""
    return [(b.serialize().to_pybytes(),) for b in rows.combine_chunks().to_batches(max_chunksize=PACKED)]


def _unpacked(elements) -> pa.Table:
    schema = _schema()
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(e[0])), schema) for e in elements], schema)


class Timelines(StatefulProcessor):
    """Per viewer: rows (watched_at us, event_id, area, duration_s) to rows of OUT."""

    def __init__(self, gap_s: int = SESSION_GAP_S, least_s: int = BACKGROUND_S, chain_gap_s: int = CHAIN_GAP_S, chain_least: int = CHAIN_LEAST):
        self.gap, self.least, self.chain_gap, self.chain_least = gap_s * 1_000_000, least_s, chain_gap_s * 1_000_000, chain_least

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            t = part["t"].astype("int64")
            first = int(t.min()) if first is None else min(first, int(t.min()))
            areas = pa.array([None if pd.isna(x) else str(x) for x in part["area"]], pa.string())
            lengths = part["duration_s"].fillna(0).astype("int64")
            self.waiting.appendList(_packed(pa.table([pa.array(t), pa.array(part["event_id"].astype("int64")), areas, pa.array(lengths)], schema=_schema())))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))  # at once, if the watermark has passed it
        yield _frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = _unpacked(self.waiting.get() if self.waiting.exists() else [])
        passed = pc.less_equal(waiting["t"], mark)
        ready, rest = waiting.filter(passed).sort_by([("t", "ascending"), ("event_id", "ascending")]), waiting.filter(pc.invert(passed))
        state = dict(zip(_OPEN_NAMES, self.open.get(), strict=True)) if self.open.exists() else None
        viewer, out = key[0], []
        for row in zip(*(c.to_pylist() for c in ready.columns), strict=True):
            state = self._step(viewer, state, row, out)
        if state is not None and mark >= state["last"] + self.gap:
            self._close(viewer, state, out)
            state = None
        if len(ready):
            if len(rest):
                self.waiting.put(_packed(rest))
            else:
                self.waiting.clear()
        due = []
        if state is None:
            self.open.clear()
        else:
            self.open.update(tuple(state[n] for n in _OPEN_NAMES))
            due.append(-(-(state["last"] + self.gap) // 1000))
        if len(rest):
            due.append(-(-pc.min(rest["t"]).as_py() // 1000))
        if due:
            self.handle.registerTimer(min(due))
        yield _frame(out)

    def _step(self, viewer, s: dict | None, row: tuple, out: list) -> dict:
        t, event, area, length = row
        if s is not None and t - s["last"] > self.gap:
            self._close(viewer, s, out)
            s = None
        new = s is None
        beside = not new and s["long"] and t < s["until"] and area != s["area"]
        if new:
            s = dict.fromkeys(_OPEN_NAMES, 0) | {"start": t, "area": None, "c_area": None, "long": False}
        if not beside:
            if new or area != s["area"] or t - s["lane"] > self.chain_gap:
                self._end_chain(viewer, s, out)
                s |= {"c_area": area, "c_len": 0, "c_start": t, "c_from": s["seconds"]}
            s |= {"lane": t, "until": t + length * 1_000_000, "area": area, "long": length >= self.least, "c_len": s["c_len"] + 1, "c_last": t, "c_to": s["seconds"] + length}
        s |= {"last": t, "views": s["views"] + 1, "seconds": s["seconds"] + length}
        out.append(("view", viewer, event, s["start"], t, bool(beside), area, None, None, length))
        return s

    def _end_chain(self, viewer, s: dict, out: list) -> None:
        if s["c_len"] >= self.chain_least:
            out.append(("chain", viewer, None, s["start"], s["c_start"], None, s["c_area"], s["c_len"], (s["c_last"] - s["c_start"]) // 1_000_000, s["c_to"] - s["c_from"]))

    def _close(self, viewer, s: dict, out: list) -> None:
        self._end_chain(viewer, s, out)
        out.append(("session", viewer, None, s["start"], s["start"], None, None, s["views"], (s["last"] - s["start"]) // 1_000_000, s["seconds"]))


def timelines(events: DataFrame, late: str = "1 hour", processor: Timelines | None = None) -> DataFrame:
    """Rows of OUT from a stream of (viewer_id, watched_at, event_id, area, duration_s).

    Rows later than the watermark are dropped; rows without a viewer only move
    it, as heartbeats do. The state store must be that of ``ROCKS`` (see ``rocks``).
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's worker has no shipped files
    # Said of the time as well, so that the condition isn't moved below the watermark.
    own = events.withWatermark("watched_at", late).filter(F.when(F.col("watched_at").isNotNull(), F.col("viewer_id").isNotNull()).otherwise(False))
    rows = own.select("viewer_id", "watched_at", F.unix_micros("watched_at").alias("t"), "event_id", "area", "duration_s")
    return rows.groupBy("viewer_id").transformWithStateInPandas(processor or Timelines(), OUT, "append", "eventTime")


@contextmanager
def rocks(spark: SparkSession):
    """Queries that start inside keep their state in the provider of ``ROCKS``."""
    key = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, held) if held else spark.conf.unset(key)
