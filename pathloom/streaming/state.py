"""Keyed state over event time: streams that need a key's events in order, or that do something when time passes.

All operators here are stateful processors of structured streaming with typed state, so they need the RocksDB state
store. An event waits in its key's list state until the watermark has passed it; then all that are due are applied in
the order of (ts, id). So the result doesn't depend on how events are spread over micro-batches, as long as none comes
later than the watermark's delay; those that do are dropped and counted by Spark (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pathloom import constants as K
from pathloom.streaming.events import STATES
from pathloom.streaming.trackers import TRACKERS, Route, _number

c = F.col

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(events: DataFrame, key: list[str], processor: StatefulProcessor, schema: str, mode: str, initial: DataFrame | None = None) -> DataFrame:
    spark = events.sparkSession
    if spark.conf.get(_STORE) != _ROCKS:
        raise RuntimeError(f"set {_STORE} to {_ROCKS}")
    return events.groupBy(*key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="EventTime",
        initialState=None if initial is None else initial.groupBy(*key),
    )


def use_typed_state(spark) -> None:
    """Choose the state store these operators need, for queries started from now on."""
    spark.conf.set(_STORE, _ROCKS)


class InOrder(StatefulProcessor):
    """Applies a key's events in the order of event time; subclasses say what an event does.

    Events are rows with ``ts_us`` and ``id`` first. A key has one timer for the earliest event that waits, and one for
    the end of its own state where a subclass sets it.
    """

    #: Further fields of an event, and the type of the state between events.
    EVENT, STATE = "", ""
    #: Columns of a result row.
    RESULT: tuple[str, ...] = ()

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"ts_us long, id long{', ' if self.EVENT else ''}{self.EVENT}")
        self.state = handle.getValueState("state", self.STATE)
        self.ends = handle.getValueState("ends", "ms long")
        self.names = ["ts_us", "id", *(field.split()[0] for field in self.EVENT.split(", ") if field)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = []
        for batch in rows:
            found += [tuple(_plain(x) for x in row) for row in batch[self.names].itertuples(index=False)]
        self.waiting.appendList(found)
        self.handle.registerTimer(_ms(min(row[0] for row in found)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        events = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((row for row in events if row[0] <= now_us), key=lambda row: row[:2])
        later = [row for row in events if row[0] > now_us]
        if due:
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(_ms(min(row[0] for row in later)))
            else:
                self.waiting.clear()
        out: list[tuple] = []
        for event in due:
            self._expire(_ms(event[0]))
            state = self.state.get() if self.state.exists() else None
            after, rows = self.apply(key, state, event)
            out += rows
            if after is not None:
                self.state.update(after)
                self.ends.update((_ms(event[0]) + self.keep_ms,))
        if not self._expire(now_us // 1000) and due and self.ends.exists():
            self.handle.registerTimer(self.ends.get()[0])
        if out:
            yield pd.DataFrame(out, columns=self.RESULT)

    def _expire(self, now_ms: int) -> bool:
        """Drop the state if its time is over; true if nothing is left of it."""
        if self.ends.exists() and self.ends.get()[0] <= now_ms:
            self.state.clear()
            self.ends.clear()
            self.forgotten()
        return not self.ends.exists()

    def apply(self, key, state: tuple | None, event: tuple) -> tuple[tuple | None, list[tuple]]:
        """(state afterwards, result rows) of an event."""
        raise NotImplementedError

    def forgotten(self) -> None:
        """Called when the key's state was dropped."""

    def close(self) -> None:
        pass


def _ms(us: int) -> int:
    return -(-int(us) // 1000)


def _plain(value):
    return None if value is None or value != value else value.item() if hasattr(value, "item") else value


def _in_order(events: DataFrame, ident: str, delay: str, key: list[str], fields: list[Column]) -> DataFrame:
    timed = events.withWatermark("ts", delay)
    return timed.select(*key, "ts", F.unix_micros("ts").alias("ts_us"), c(ident).cast("long").alias("id"), *fields)


# -- navigation sessions ----------------------------------------------------------------------------------------
class _Session(InOrder):
    EVENT, STATE, RESULT = "event string", "at int", ("trip_id", "event_id", "state")

    def apply(self, key, state, event):
        at = STATES[state[0] if state else 0]
        at = K.NAVIGATION_TRANSITIONS[at].get(event[2], at)
        return (STATES.index(at),), [(key[0], event[1], at)]


def replay_stream(events: DataFrame, delay: str = "10 minutes", keep_s: int = 86_400) -> DataFrame:
    """The state of its session after each event (trip_id, event_id, state), once the watermark has passed it.

    Events are (trip_id, event_id, ts, event), in any order within the delay; the batch twin is ``replay``. A session
    without events for ``keep_s`` is forgotten and would begin again at the first state.
    """
    ordered = _in_order(events, "event_id", delay, ["trip_id"], [c("event")])
    return _run(ordered, ["trip_id"], _Session(keep_s * 1000), "trip_id long, event_id long, state string", "Append")


# -- spacing ----------------------------------------------------------------------------------------------------
class _Spaced(InOrder):
    STATE, RESULT = "until_us long", ("key", "at_us", "id")

    def apply(self, key, state, event):
        if state and event[0] < state[0]:
            return None, []
        return (event[0] + self.keep_ms * 1000,), [(key[0], *event)]


def spaced_stream(rows: DataFrame, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """(key, at_us, id) of the first row of a key and of each next one at least ``seconds`` after the last kept one.

    Rows are (key, ts, id). The cool-down is a timer: when it has run out, the key has no state left. The batch
    twin is ``spaced``.
    """
    ordered = _in_order(rows, "id", delay, ["key"], [])
    kind = rows.schema["key"].dataType.simpleString()
    return _run(ordered, ["key"], _Spaced(seconds * 1000), f"key {kind}, at_us long, id long", "Append")


# -- newest row per key -----------------------------------------------------------------------------------------
class Newest(StatefulProcessor):
    """The newest row of a key; a row is given out again when it has become stale, and forgotten later."""

    def __init__(self, key: tuple[str, ...], fields: str, stale_ms: int | None, keep_ms: int) -> None:
        self.key, self.fields, self.stale_ms, self.keep_ms = key, fields, stale_ms, keep_ms
        self.names = ["ts_us", "id", *(field.split()[0] for field in fields.split(", "))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", f"ts_us long, id long, {self.fields}, stale boolean")

    def _times(self, row: tuple) -> list[int]:
        """When the row becomes stale and when it is forgotten."""
        at = _ms(row[0])
        return ([] if self.stale_ms is None else [at + self.stale_ms + 1]) + [at + self.keep_ms + 1]

    def _out(self, key, row: tuple) -> pd.DataFrame:
        return pd.DataFrame([(*key, *row)], columns=[*self.key, *self.names, "stale"])

    def handleInputRows(self, key, rows, timerValues):
        best = None
        for batch in rows:
            top = batch.sort_values(["ts_us", "id"]).iloc[-1]
            seen = tuple(_plain(top[name]) for name in self.names)
            best = seen if best is None or seen[:2] > best[:2] else best
        before = self.row.get() if self.row.exists() else None
        if before is not None and tuple(before[:2]) >= best[:2]:
            return
        if before is not None:
            for at in self._times(before):
                self.handle.deleteTimer(at)
        now = timerValues.getCurrentWatermarkInMs()
        row = (*best, self.stale_ms is not None and now > _ms(best[0]) + self.stale_ms)
        self.row.update(row)
        for at in self._times(row):
            self.handle.registerTimer(at)
        yield self._out(key, row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.row.exists():
            return
        row, at = tuple(self.row.get()), expiredTimerInfo.getExpiryTimeInMs()
        if at == self._times(row)[-1]:
            self.row.clear()
        elif at in self._times(row) and not row[-1]:
            row = (*row[:-1], True)
            self.row.update(row)
            yield self._out(key, row)

    def close(self) -> None:
        pass


def status_stream(observations: DataFrame, delay: str = "30 seconds", stale_s: int = K.STALE_S, keep_s: int = 3600) -> DataFrame:
    """Changes of each vehicle's status (provider, vehicle_id, ts_us, id, lat, lon, available, stale): a newer
    observation, or the last one having become stale. Vehicles unseen for ``keep_s`` leave the state.

    Observations are (provider, vehicle_id, observation_id, ts, lat, lon, available); the batch twin is
    ``with_stale(latest_status(...), watermark)``.
    """
    fields = "lat double, lon double, available boolean"
    timed = _in_order(observations, "observation_id", delay, ["provider", "vehicle_id"], [c("lat"), c("lon"), c("available")])
    kind = ", ".join(f"{n} {observations.schema[n].dataType.simpleString()}" for n in ("provider", "vehicle_id"))
    newest = Newest(("provider", "vehicle_id"), fields, stale_s * 1000, keep_s * 1000)
    return _run(timed, ["provider", "vehicle_id"], newest, f"{kind}, ts_us long, id long, {fields}, stale boolean", "Update")


def fix_stream(fixes: DataFrame, delay: str = "30 seconds", keep_s: int = 86_400) -> DataFrame:
    """Newest fix of each device (device_id, ts_us, id, lat, lon) whenever it changes; devices unseen for ``keep_s``
    leave the state. Fixes are (device_id, fix_id, ts, lat, lon); the batch twin is ``latest_fix``."""
    fields = "lat double, lon double"
    timed = _in_order(fixes, "fix_id", delay, ["device_id"], [c("lat"), c("lon")])
    newest = Newest(("device_id",), fields, None, keep_s * 1000)
    return _run(timed, ["device_id"], newest, f"device_id long, ts_us long, id long, {fields}, stale boolean", "Update").drop("stale")


# -- trackers ---------------------------------------------------------------------------------------------------
class _Followed(InOrder):
    EVENT = "lat double, lon double, accuracy_m double, heading double, speed double"

    def __init__(self, kind: str, keep_ms: int) -> None:
        super().__init__(keep_ms)
        self.kind = kind
        self.STATE = TRACKERS[kind].STATE
        self.RESULT = ("trip_id", "fix_id", *(f.split()[0] for f in TRACKERS[kind].FIELDS.split(",")))

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.route = handle.getListState("route", "idx long, lat double, lon double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """The trip's route is put into its state once, before any fix."""
        rows = initialState[["idx", "lat", "lon"]].itertuples(index=False)
        self.route.appendList([tuple(_plain(x) for x in row) for row in rows])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        vertices = sorted(map(tuple, self.route.get())) if self.route.exists() else []
        self.tracker = TRACKERS[self.kind](Route([v[1] for v in vertices], [v[2] for v in vertices])) if len(vertices) > 1 else None
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def apply(self, key, state, event):
        if self.tracker is None:
            return None, []
        if state:
            self.tracker.restore(state)
        _, fix_id, lat, lon, accuracy, heading, speed = event
        found = self.tracker.update((lat, lon, accuracy, _number(heading), _number(speed)))
        return self.tracker.saved(), [(key[0], fix_id, *found)]

    def forgotten(self):
        self.route.clear()
        self.tracker = None


def follow_stream(fixes: DataFrame, routes: DataFrame, kind: str, delay: str = "10 minutes", keep_s: int = 1800) -> DataFrame:
    """Tracker over a stream of fixes (trip_id, fix_id, ts, lat, lon, accuracy_m, heading, speed).

    ``routes`` is a table (trip_id, idx, lat, lon); each trip's vertices are loaded into its state when the stream
    starts, so fixes are not joined with routes. What is kept between fixes are the tracker's few numbers. A trip
    without a fix for ``keep_s`` is over: its state and route are dropped, and later fixes of it give no rows. The batch
    twin is ``follow``.
    """
    ordered = _in_order(fixes, "fix_id", delay, ["trip_id"], [c(n) for n in ("lat", "lon", "accuracy_m", "heading", "speed")])
    schema = f"trip_id long, fix_id long, {TRACKERS[kind].FIELDS}"
    return _run(ordered, ["trip_id"], _Followed(kind, keep_s * 1000), schema, "Append", routes.select("trip_id", "idx", "lat", "lon"))
