"""Position matching along a route: small per-fix helpers and the Spark jobs that feed them.

The recurrences of a trip are sequential (each fix depends on the state left by the one before), so trips are the unit
of parallelism. Rows are partitioned by trip and sorted, and a task streams through its batches holding the state of
one trip: the route's vertices and a few numbers, never the trip's fixes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom import constants as K
from pathloom.operators.rounds import RoundState, stage_width

c = F.col
#: Length of a chunk of time in gaps, when rows are spaced.
SPAN_GAPS = 64


def _metres(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    p1, p2 = np.radians(lat), np.radians(lats)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * K.EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(a)))


class Route:
    """Vertices of a route with what both trackers need of them."""

    def __init__(self, lats: np.ndarray, lons: np.ndarray) -> None:
        self.lats, self.lons = np.asarray(lats, float), np.asarray(lons, float)
        p = np.radians(self.lats)
        d = np.radians(np.diff(self.lons))
        half = np.sin(np.diff(p) / 2) ** 2 + np.cos(p[:-1]) * np.cos(p[1:]) * np.sin(d / 2) ** 2
        self.lengths = 2 * K.EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(half)))
        self.along = np.concatenate([[0.0], np.cumsum(self.lengths)])
        east = np.sin(d) * np.cos(p[1:])
        north = np.cos(p[:-1]) * np.sin(p[1:]) - np.sin(p[:-1]) * np.cos(p[1:]) * np.cos(d)
        self.headings = np.degrees(np.arctan2(east, north)) % 360


class Matcher:
    """Most likely vertex for the newest of the last few fixes (a Viterbi pass over nearby vertices)."""

    FIELDS = "geometry_index long, distance_m double, confidence double, off_route boolean"
    #: What is kept between fixes; ``fixes`` holds the numbers of the last few, one after the other.
    STATE = "last_index int, streak int, fixes array<double>"

    def __init__(self, route: Route, window: int = 5) -> None:
        self.route, self.last_index, self.streak = route, 0, 0
        self.fixes: deque[tuple[float, float, float, float | None, float | None]] = deque(maxlen=window)

    def saved(self) -> tuple:
        return self.last_index, self.streak, [x for fix in self.fixes for x in fix]

    def restore(self, state: tuple) -> None:
        self.last_index, self.streak, numbers = state
        self.fixes.clear()
        self.fixes.extend(tuple(numbers[i : i + 5]) for i in range(0, len(numbers), 5))

    def _emission(self, fix: tuple, at: np.ndarray) -> np.ndarray:
        lat, lon, accuracy, heading, _ = fix
        sigma = max(5.0, accuracy)
        score = -(_metres(lat, lon, self.route.lats[at], self.route.lons[at]) ** 2) / (2 * sigma * sigma)
        if heading is not None:
            ahead = at < len(self.route.headings)
            gap = np.abs((heading - self.route.headings[at[ahead]] + 180) % 360 - 180)
            score[ahead] -= gap / 90
        return score

    def update(self, fix: tuple) -> tuple[int, float, float, bool]:
        self.fixes.append(fix)
        first = max(0, self.last_index - 2)
        away = _metres(fix[0], fix[1], self.route.lats[first:], self.route.lons[first:])
        at = first + np.argsort(away, kind="stable")[:8]
        scores = self._emission(self.fixes[0], at)
        gaps = np.abs(self.route.along[at][:, None] - self.route.along[at][None, :])
        backwards = at[None, :] < at[:, None] - 1
        for seen in list(self.fixes)[1:]:
            expected = max(0.0, seen[4] or 0.0)
            moves = np.where(backwards, -12.0, -np.abs(gaps - expected) / 80)
            scores = (scores[:, None] + moves).max(axis=0) + self._emission(seen, at)
        best = int(np.argmax(scores))
        index = int(at[best])
        distance = float(_metres(fix[0], fix[1], self.route.lats[[index]], self.route.lons[[index]])[0])
        if distance > max(30.0, fix[2] * 1.8):
            self.streak += 1
        else:
            self.streak, self.last_index = 0, max(self.last_index, index)
        confidence = float(np.clip(np.exp(scores[best] / len(self.fixes)), 0.0, 1.0))
        return index, distance, confidence, self.streak >= 3


class Progress:
    """Best segment near the last one, remaining distance, off-route hysteresis and arrival."""

    FIELDS = (
        "geometry_index long, distance_m double, remaining_m double, fraction double, off_route boolean, arrived boolean"
    )

    STATE = "segment int, progress double, streak int"

    def __init__(self, route: Route) -> None:
        self.route, self.segment, self.progress, self.streak = route, 0, 0.0, 0

    def saved(self) -> tuple:
        return self.segment, self.progress, self.streak

    def restore(self, state: tuple) -> None:
        self.segment, self.progress, self.streak = state

    def update(self, fix: tuple) -> tuple[int, float, float, float, bool, bool]:
        lat, lon, accuracy, heading, _ = fix
        r = self.route
        low, high = max(0, self.segment - 8), min(len(r.lats) - 1, self.segment + 120)
        at = np.arange(low, high)
        east = K.METRES_PER_DEGREE * np.cos(np.radians(lat))
        bx, by = (r.lons[at + 1] - r.lons[at]) * east, (r.lats[at + 1] - r.lats[at]) * K.METRES_PER_DEGREE
        px, py = (lon - r.lons[at]) * east, (lat - r.lats[at]) * K.METRES_PER_DEGREE
        squared = bx * bx + by * by
        share = np.where(squared > 0, np.clip((px * bx + py * by) / np.where(squared > 0, squared, 1), 0, 1), 0.0)
        away = np.hypot(px - share * bx, py - share * by)
        along = r.along[at] + share * r.lengths[at]
        score = away.copy()
        if heading is not None:
            score += np.minimum(45, np.abs((heading - r.headings[at] + 540) % 360 - 180)) * 0.35
        back = along + max(25.0, accuracy) < self.progress
        score += np.where(back, np.minimum(250, self.progress - along) * 0.8, 0.0)
        best = int(np.argmin(score))
        threshold = max(28.0, accuracy * 1.8)
        if away[best] > threshold or along[best] > self.progress + 2000:
            self.streak += 1
        else:
            self.streak = 0
            self.segment = max(self.segment, int(at[best]))
            self.progress = max(self.progress, float(along[best]))
        total = float(r.along[-1])
        remaining = max(0.0, total - self.progress)
        to_end = float(_metres(lat, lon, r.lats[-1:], r.lons[-1:])[0])
        arrived = remaining <= max(35.0, threshold) and to_end <= max(30.0, threshold)
        fraction = self.progress / total if total > 0 else 0.0
        return min(len(r.lats) - 1, int(at[best]) + 1), float(away[best]), remaining, fraction, self.streak >= 3, arrived


TRACKERS: dict[str, type] = {"matcher": Matcher, "progress": Progress}


def _number(value: float) -> float | None:
    return None if pd.isna(value) else float(value)


def _one_by_one(trips: list[tuple]) -> list[list[tuple]]:
    """Results of each trip's fixes; a trip is its tracker and (lat, lon, accuracy, heading, speed) rows."""
    return [[tracker.update((*fix[:3], _number(fix[3]), _number(fix[4]))) for fix in fixes.tolist()] for tracker, fixes in trips]


def _match_together(trips: list[tuple]) -> list[list[tuple]]:
    """``Matcher.update`` for the fixes of several trips, the first fixes of all trips at once, then the second ones."""
    out: list = [None] * len(trips)
    # routes are padded to one length, so only routes of about one length go together
    alike: dict[int, list[int]] = {}
    for i, (tracker, _) in enumerate(trips):
        alike.setdefault(len(tracker.route.lats).bit_length(), []).append(i)
    for members in alike.values():
        for i, found in zip(members, _match_alike([trips[i] for i in members])):
            out[i] = found
    return out


def _match_alike(trips: list[tuple]) -> list[list[tuple]]:
    trackers = [t for t, _ in trips]
    window, routes = trackers[0].fixes.maxlen, [t.route for t in trackers]
    length = np.array([len(r.lats) for r in routes])
    steps = np.array([len(f) for _, f in trips])
    wide = length.max()

    def padded(values: list[np.ndarray]) -> np.ndarray:
        whole = np.zeros((len(values), wide))
        for i, v in enumerate(values):
            whole[i, : len(v)] = v
        return whole

    lats, lons, along, headings = (padded([getattr(r, n) for r in routes]) for n in ("lats", "lons", "along", "headings"))
    # a trip's fixes behind those it still holds
    held = window - 1
    fixes = np.full((len(trips), held + steps.max(), 5), np.nan)
    since = np.empty(len(trips), int)
    for i, (tracker, new) in enumerate(trips):
        old = list(tracker.fixes)[-held:] if held else []
        since[i] = held - len(old)
        if old:
            fixes[i, since[i] : held] = np.array(old, float)
        fixes[i, held : held + len(new)] = new
    last, streak = np.array([t.last_index for t in trackers]), np.array([t.streak for t in trackers])
    out: list[list[tuple]] = [[] for _ in trips]
    place = np.arange(wide)
    for step in range(steps.max()):
        live = np.flatnonzero(steps > step)
        rows, now = live[:, None], fixes[live, held + step]
        off = (place < np.maximum(0, last[live] - 2)[:, None]) | (place >= length[live][:, None])
        away = _metres(now[:, :1], now[:, 1:2], lats[live], lons[live])
        away[np.isnan(away)] = 1e300
        away[off] = np.inf
        at = np.argsort(away, axis=1, kind="stable")[:, :8]
        none = np.take_along_axis(off, at, axis=1)
        near_lats, near_lons, near_along, near_headings = lats[rows, at], lons[rows, at], along[rows, at], headings[rows, at]
        ahead = at < length[live][:, None] - 1
        gaps = np.abs(near_along[:, :, None] - near_along[:, None, :])
        backwards = at[:, None, :] < at[:, :, None] - 1
        scores, count = np.zeros(at.shape), np.zeros(len(live), int)
        for position in range(step, held + step + 1):
            seen = fixes[live, position]
            metres = _metres(seen[:, :1], seen[:, 1:2], near_lats, near_lons)
            sigma = np.where(seen[:, 2] > 5.0, seen[:, 2], 5.0)[:, None]
            emission = -(metres**2) / (2 * sigma * sigma)
            turn = np.abs((seen[:, 3:4] - near_headings + 180) % 360 - 180)
            emission = np.where(ahead & ~np.isnan(seen[:, 3:4]), emission - turn / 90, emission)
            expected = np.where(seen[:, 4] > 0, seen[:, 4], 0.0)[:, None, None]
            moves = np.where(backwards, -12.0, -np.abs(gaps - expected) / 80)
            moved = (scores[:, :, None] + moves).max(axis=1) + emission
            there = position >= since[live]
            fresh = np.where((count > 0)[:, None], moved, emission)
            fresh[none] = -np.inf
            scores = np.where(there[:, None], fresh, scores)
            count += there
        best = np.argmax(scores, axis=1)[:, None]
        index, distance, score = (np.take_along_axis(v, best, axis=1)[:, 0] for v in (at, metres, scores))
        limit = now[:, 2] * 1.8
        beyond = distance > np.where(limit > 30.0, limit, 30.0)
        streak[live] = np.where(beyond, streak[live] + 1, 0)
        last[live] = np.where(beyond, last[live], np.maximum(last[live], index))
        confidence = np.clip(np.exp(score / count), 0.0, 1.0)
        for i, *found in zip(live.tolist(), index.tolist(), distance.tolist(), confidence.tolist(), (streak[live] >= 3).tolist()):
            out[i].append(tuple(found))
    for i, (tracker, new) in enumerate(trips):
        tracker.last_index, tracker.streak = int(last[i]), int(streak[i])
        tracker.fixes.extend((*fix[:3], _number(fix[3]), _number(fix[4])) for fix in new[-window:].tolist())
    return out


#: How the fixes of several trips are followed; every trip's own fixes stay in order.
TOGETHER: dict[str, Callable] = {"matcher": _match_together, "progress": _one_by_one}


def _follow(kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [f.split()[0] for f in TRACKERS[kind].FIELDS.split(",")]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trip, vertices, tracker = None, [], None
        for batch in batches:
            if batch.empty:
                continue
            ids, is_fix = batch["trip_id"].to_numpy(), batch["is_fix"].to_numpy() != 0
            numbers = batch[["lat", "lon", "accuracy_m", "heading", "speed"]].to_numpy(float, na_value=np.nan)
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            trips, kept = [], []
            for start, end in zip(starts, np.append(starts[1:], len(ids))):
                if ids[start] != trip:
                    trip, vertices, tracker = ids[start], [], None
                first = start + np.count_nonzero(~is_fix[start:end])
                vertices.extend(numbers[start:first, :2])
                if first == end or (tracker is None and len(vertices) < 2):
                    continue
                if tracker is None:
                    tracker = TRACKERS[kind](Route(*np.array(vertices).T))
                trips.append((tracker, numbers[first:end]))
                kept.append(np.arange(first, end))
            if trips:
                found = [one for results in TOGETHER[kind](trips) for one in results]
                out = pd.DataFrame(found, columns=names)
                of = batch.iloc[np.concatenate(kept)]
                out.insert(0, "trip_id", of["trip_id"].to_numpy())
                out.insert(1, "fix_id", of["fix_id"].to_numpy())
                yield out

    return stream


def follow(fixes: DataFrame, vertices: DataFrame, kind: str) -> DataFrame:
    """Run a tracker over every trip.

    ``fixes``: (trip_id, fix_id, ts_us, lat, lon, accuracy_m, heading, speed); ``vertices``: (trip_id, idx, lat, lon).
    A trip's vertices travel in the same sorted partition just ahead of its fixes. Trips without a route give no rows.
    """
    none = F.lit(None).cast("double")
    route = vertices.select(
        "trip_id", F.lit(0).alias("is_fix"), c("idx").alias("ts_us"), F.lit(-1).cast("long").alias("fix_id"), "lat", "lon",
        none.alias("accuracy_m"), none.alias("heading"), none.alias("speed"),
    )
    seen = fixes.select("trip_id", F.lit(1).alias("is_fix"), "ts_us", "fix_id", "lat", "lon", "accuracy_m", "heading", "speed")
    rows = route.unionByName(seen).repartition(stage_width(fixes.sparkSession), "trip_id")
    ordered = rows.sortWithinPartitions("trip_id", "is_fix", "ts_us", "fix_id")
    return ordered.mapInPandas(_follow(kind), f"trip_id long, fix_id long, {TRACKERS[kind].FIELDS}")


def spaced(rows: DataFrame, seconds: float) -> DataFrame:
    """First row per ``key`` and then the next one at least ``seconds`` after the last kept one (key, at_us, id).

    Rows point at the first row of their key that is far enough behind them; what is kept is the chain from the first
    row on. The pointers come from a scan of chunks of time, with each chunk's first row carried to the chunks before,
    so a hot key is spread over its chunks. The chain is marked by doubling: pointers over 1, 2, 4, ... rows, and after
    each round the marked rows and those they point at. Rows of a key at one instant are one, the least id.
    """
    gap = int(seconds * 1e6)
    state = RoundState(rows.sparkSession, "spaced")
    single = state.keep(rows.groupBy("key", "at_us").agg(F.min("id").alias("id")), "rows")
    marked = state.keep(single.groupBy("key").agg(F.min(F.struct("at_us", "id")).alias("_f")).select("key", "_f.*"), "firsts")
    jumps = state.keep(_next_eligible(single, gap), "jump-0")
    # what nothing points at can only be a first row
    entries = jumps.select("key", c("to_us").alias("at_us")).union(marked.select("key", "at_us")).distinct()
    jumps = state.keep(jumps.join(entries, ["key", "at_us"]), "jumps-0")
    number = 0
    while True:
        number += 1
        ahead = marked.join(jumps, ["key", "at_us"]).select("key", c("to_us").alias("at_us"), c("to_id").alias("id"))
        if ahead.isEmpty():
            return marked
        marked = state.keep(marked.union(ahead), f"marked-{number}")
        further = jumps.select("key", c("at_us").alias("to_us"), c("to_us").alias("_us"), c("to_id").alias("_id"))
        doubled = jumps.drop("to_id").join(further, ["key", "to_us"]).select("key", "at_us", c("_us").alias("to_us"), c("_id").alias("to_id"))
        jumps = state.keep(doubled, f"jumps-{number}")


def _next_eligible(rows: DataFrame, gap: int) -> DataFrame:
    """(key, at_us, to_us, to_id): the first row at least ``gap`` after each row, for rows that have one."""
    span = max(gap, 1) * SPAN_GAPS
    none = F.lit(None).cast("long")
    asked = rows.select("key", (c("at_us") + gap).alias("_at"), F.lit(0).alias("_row"), "at_us", none.alias("id"))
    seen = rows.select("key", c("at_us").alias("_at"), F.lit(1).alias("_row"), "at_us", "id")
    both = asked.union(seen).withColumn("_chunk", F.floor(c("_at") / span))
    # behind a question comes the row that stands at the same instant or next
    back = Window.partitionBy("key", "_chunk").orderBy(c("_at").desc(), c("_row").desc())
    inside = F.last(F.when(c("_row") == 1, F.struct("at_us", "id")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    heads = both.groupBy("key", "_chunk").agg(F.min(F.when(c("_row") == 1, F.struct("at_us", "id"))).alias("_head"))
    after = Window.partitionBy("key").orderBy(c("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("key", "_chunk", F.last("_head", ignorenulls=True).over(after).alias("_after"))
    found = both.withColumn("_inside", inside).filter(c("_row") == 0).join(heads, ["key", "_chunk"])
    to = F.coalesce("_inside", "_after")
    return found.select("key", "at_us", to["at_us"].alias("to_us"), to["id"].alias("to_id")).filter(c("to_us").isNotNull())
