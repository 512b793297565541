"""Ordered folds over keyed streams: the stateful operators as Structured Streaming jobs.

Each takes a streaming DataFrame and keeps, for a key, only what its next row needs (the last
output points, the last kept mask, the accepted times of a window), so state grows with the
number of live keys and not with their history. Rows with a null key share one state; null coordinates never count as a violation.

Without ``delay`` a micro-batch's rows of a key are put in order before they are folded and must fit a task; sources bound them by files
or bytes a trigger. Rows that come in a later batch are folded after those before them, whatever their time. ``idle`` (milliseconds) drops the
state of keys that stay silent so long; without it, it stays.

With ``delay`` (seconds) rows are folded in order of event time, whatever batches they come in: they are held until the
watermark, the newest time seen less the delay, has reached them, and then folded in order. Times are 0 or later. Rows that come when the
watermark has passed them are late and dropped; those within the delay of the newest row stay held
until newer ones come. What is held of a key is its rows of the last ``delay`` seconds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumentrack.operators import masks as mk
from lumentrack.operators.trajectory import acceleration_step, speed_step

TRACK = "obj_id long, pos long, x double, y double, z double, hit boolean, measure double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(stream: DataFrame, key: str, order: list[str], output: str, state: str, start: tuple, step: Callable, idle: int | None = None) -> DataFrame:
    """Rows that ``step(state, row) -> (state, output row or None)`` gives for each key's rows in ``order``.

    ``start`` is the state of a key not seen before; ``state`` and ``output`` are schemas.
    """
    names = [field.split()[0] for field in output.split(", ")]

    def run(_, batches, held):
        if held.hasTimedOut:
            held.remove()
            return
        now = held.get if held.exists else start
        out = []
        for row in pd.concat(list(batches)).sort_values(order, kind="stable").itertuples(index=False):
            now, found = step(now, row)
            if found is not None:
                out.append(found)
        held.update(now)
        if idle:
            held.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(key).applyInPandasWithState(run, output, state, "append", "ProcessingTimeTimeout" if idle else "NoTimeout")


def _plain(value: Any) -> Any:
    """A cell as a state store takes it."""
    value = value.tolist() if hasattr(value, "tolist") else value
    return None if isinstance(value, float) and value != value else value


class _InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark reaches them, then folds them in order."""

    def __init__(self, names: list[str], schema: str, order: list[str], output: list[str], state: str, start: tuple, step: Callable):
        self.names, self.schema, self.order, self.output, self.state, self.start, self.step = names, schema, order, output, state, start, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.now = handle.getValueState("now", self.state)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark, least = timerValues.getCurrentWatermarkInMs(), None
        for pdf in rows:
            pdf = pdf[pdf["event_ms"] > mark]
            if len(pdf):
                self.held.appendList([tuple(map(_plain, r)) for r in pdf[self.names].itertuples(index=False)])
                least = min(int(pdf["event_ms"].min()), least if least is not None else int(pdf["event_ms"].min()))
        if least is not None:
            self.handle.registerTimer(least)
        yield pd.DataFrame(columns=self.output)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = pd.DataFrame([tuple(r) for r in self.held.get()], columns=self.names)
        due = rows["event_ms"] <= mark
        if due.any():
            now = tuple(self.now.get()) if self.now.exists() else self.start
            out = []
            for row in rows[due].sort_values(self.order, kind="stable").itertuples(index=False):
                now, found = self.step(now, row)
                if found is not None:
                    out.append(found)
            self.now.update(now)
            rest = rows[~due]
            self.held.clear()
            if len(rest):
                self.held.appendList([tuple(map(_plain, r)) for r in rest.itertuples(index=False)])
                self.handle.registerTimer(int(rest["event_ms"].min()))
            yield pd.DataFrame(out, columns=self.output)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, seconds: Column, order: list[str], output: str, state: str, start: tuple, step: Callable, delay: float) -> DataFrame:
    """As ``fold``, by event time ``seconds``, which must be the first of ``order``. The session's state store becomes RocksDB, which timers and lists need."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    named = stream.columns
    ahead = round(delay * 1000) + 1000  # a watermark starts at 0: times from 0 on must lie beyond it, less the delay
    rows = stream.withColumn("event_ms", F.floor(seconds * 1000).cast("long") + ahead).withColumn("event_at", F.timestamp_millis("event_ms")).withWatermark("event_at", f"{round(delay * 1000)} milliseconds")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "event_at")
    columns = [field.split()[0] for field in output.split(", ")]
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=_InOrder([*named, "event_ms"], fields, order, columns, state, start, step), outputStructType=output, outputMode="Append", timeMode="EventTime")


def _either(stream: DataFrame, key: str, order: list[str], output: str, state: str, start: tuple, step: Callable, idle: int | None, delay: float | None) -> DataFrame:
    if delay is None:
        return fold(stream, key, order, output, state, start, step, idle)
    return in_order(stream, key, F.col(order[0]).cast("double"), order, output, state, start, step, delay)


def rate_limit(requests: DataFrame, window: float, most: int, idle: int | None = None, delay: float | None = None) -> DataFrame:
    """(key, id, at) -> key, id, accepted: fewer than ``most`` accepted requests lie in the ``window`` seconds before."""

    def step(state, row):
        kept = [t for t in state[0] if t > row.at - window]
        ok = len(kept) < most
        return ([*kept, float(row.at)] if ok else kept,), (row.key, row.id, ok)

    return _either(requests.select("key", "id", "at"), "key", ["at", "id"], "key long, id long, accepted boolean", "times array<double>", ([],), step, idle, delay)


def temporal_filter(masks: DataFrame, least: float = 0.5, idle: int | None = None) -> DataFrame:
    """(obj_id, ord, bits) -> obj_id, pos of masks of 64 pixels whose overlap with the object's last kept mask is at least ``least``; pos counts an object's masks."""

    def step(state, row):
        last, pos = state
        bits = int(row.bits) & (1 << 64) - 1
        seen = bits if last is None else int(last) & (1 << 64) - 1
        union = (seen | bits).bit_count()
        keep = not union or (seen & bits).bit_count() / union >= least
        return (row.bits if keep else last, pos + 1), (row.obj_id, pos) if keep else None

    return fold(masks.select("obj_id", "ord", "bits"), "obj_id", ["ord"], "obj_id long, pos int", "bits long, pos int", (None, 0), step, idle)


def mask_filter(masks: DataFrame, least: float = 0.5, idle: int | None = None, delay: float | None = None) -> DataFrame:
    """(obj_id, frame, runs, is_valid) -> obj_id, frame of masks of any size that stay: valid ones whose overlap with the object's last kept mask is at least ``least``.

    The state of an object is the last kept mask as one array of whole numbers, three a run, whatever the frame's size. An object's first valid
    mask stays; those rejected don't change the state. With ``delay`` a frame's number is its time in seconds.
    """
    flat = F.flatten(F.transform(F.array_sort("runs"), lambda s: F.array(s["y"], s["x0"], s["x1"])))
    rows = masks.select("obj_id", "frame", flat.alias("spans"), F.coalesce("is_valid", F.lit(False)).alias("is_valid"))

    def step(state, row):
        kept = state[0]
        if not row.is_valid:
            return (kept,), None
        own = [int(v) for v in row.spans]
        split = lambda v: list(zip(v[::3], v[1::3], v[2::3], strict=True))
        stays = kept is None or mk.run_iou(split(own), split([int(v) for v in kept])) >= least
        return (own if stays else kept,), (row.obj_id, row.frame) if stays else None

    return _either(rows, "obj_id", ["frame"], "obj_id long, frame long", "spans array<int>", (None,), step, idle, delay)


def clamp_speed(points: DataFrame, max_speed: float, midpoint: bool = False, idle: int | None = None, delay: float | None = None) -> DataFrame:
    """(obj_id, t, ord, x, y, z) -> the track with points beyond ``max_speed`` from the last output moved to where it is met, or ``midpoint``, halfway."""

    def step(state, row):
        *last, pos = state
        here, hit, speed = speed_step(tuple(last) if pos else None, row, (row.x, row.y, row.z), max_speed, midpoint)
        return (row.t, *here, pos + 1), (row.obj_id, pos, *here, hit, speed)

    return _either(points.select("obj_id", "t", "ord", "x", "y", "z"), "obj_id", ["t", "ord"], TRACK, "t double, x double, y double, z double, pos long", (None, None, None, None, 0), step, idle, delay)


def clamp_acceleration(points: DataFrame, max_acceleration: float, idle: int | None = None, delay: float | None = None) -> DataFrame:
    """As ``clamp_speed`` for the acceleration from the last two outputs; an object's first two points pass, and those where time stands still."""

    def step(state, row):
        before, last, pos = tuple(state[:4]), tuple(state[4:8]), state[8]
        here, hit, size = acceleration_step(before if pos > 1 else None, last if pos else None, row, (row.x, row.y, row.z), max_acceleration)
        return (*last, row.t, *here, pos + 1), (row.obj_id, pos, *here, hit, size)

    state = "t0 double, x0 double, y0 double, z0 double, t1 double, x1 double, y1 double, z1 double, pos long"
    return _either(points.select("obj_id", "t", "ord", "x", "y", "z"), "obj_id", ["t", "ord"], TRACK, state, (None,) * 8 + (0,), step, idle, delay)


def job_changes(events: DataFrame, final: str, idle: int | None = None, delay: float | None = None) -> DataFrame:
    """(job_id, at, ord, state) -> job_id, seq, state of each change until the job has ended in ``final``; later events are ignored."""

    def step(held, row):
        seq, ended = held
        return held if ended else (seq + 1, row.state == final), None if ended else (row.job_id, seq, row.state)

    return _either(events.select("job_id", "at", "ord", "state"), "job_id", ["at", "ord"], "job_id long, seq long, state string", "seq long, ended boolean", (0, False), step, idle, delay)
