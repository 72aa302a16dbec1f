"""Vehicle, device, request and navigation-event streams, each with a batch twin of the same semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom import constants as K

c = F.col


def latest_status(observations: DataFrame) -> DataFrame:
    """Newest observation per vehicle. Works on a table and, in update mode, on a stream."""
    row = F.struct("observed_at", "observation_id", "lat", "lon", "available")
    newest = observations.groupBy("provider", "vehicle_id").agg(F.max(row).alias("_r"))
    return newest.select("provider", "vehicle_id", "_r.*")


def with_stale(status: DataFrame, as_of: Column, seconds: int = K.STALE_S) -> DataFrame:
    return status.withColumn("stale", c("observed_at") < as_of - F.expr(f"INTERVAL {seconds} SECONDS"))


def latest_fix(fixes: DataFrame) -> DataFrame:
    newest = fixes.groupBy("device_id").agg(F.max(F.struct("ts", "fix_id", "lat", "lon")).alias("_r"))
    return newest.select("device_id", "_r.*")


def request_hash(request: Column) -> Column:
    """Identity of a canonical request (a struct with its fields in fixed order)."""
    return F.sha2(F.to_json(request), 256)


def unique_requests(requests: DataFrame, ttl: str = "300 seconds") -> DataFrame:
    """Streaming de-duplication: repeats of a request within the TTL of its first sight are dropped."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["request_hash"])


# -- navigation sessions ----------------------------------------------------------------------------------------
STATES = tuple(K.NAVIGATION_TRANSITIONS)
EVENTS = tuple(sorted({e for row in K.NAVIGATION_TRANSITIONS.values() for e in row}))


def _effect(event: Column) -> Column:
    """What an event does, as an array: position = state before, value = state after."""
    def after(state: str, name: str) -> int:
        return STATES.index(K.NAVIGATION_TRANSITIONS[state].get(name, state))

    table = F.create_map(
        *[x for name in EVENTS for x in (F.lit(name), F.array(*[F.lit(after(s, name)) for s in STATES]))]
    )
    return F.coalesce(table[event], F.array(*[F.lit(i) for i in range(len(STATES))]))


def _compose(effects: Column) -> Column:
    """Effects applied one after the other, as one effect."""
    same = F.array(*[F.lit(i) for i in range(len(STATES))])
    return F.aggregate(effects, same, lambda acc, e: F.transform(acc, lambda s: F.element_at(e, s + 1)))


def replay(events: DataFrame, chunk: Column) -> DataFrame:
    """Final state of each session from its events (trip_id, event, ts, event_id).

    What a run of events does to a session is a table of states, and such tables compose. So the events of a session
    are folded chunk by chunk (``chunk`` must be monotone in time) and only one table per chunk reaches the session's
    own task, however long the session is.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event")))
    chunks = events.withColumn("_chunk", chunk).groupBy("trip_id", "_chunk").agg(
        _compose(F.transform(ordered, lambda e: _effect(e["event"]))).alias("_effect")
    )
    folded = chunks.groupBy("trip_id").agg(
        _compose(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_effect"))), lambda s: s["_effect"])).alias("_effect")
    )
    names = F.array(*[F.lit(s) for s in STATES])
    return folded.select("trip_id", F.element_at(names, F.element_at("_effect", 1) + 1).alias("state"))
