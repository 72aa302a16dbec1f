"""Batch twins of the streaming operators (T1-T8), hysteresis (W6) and feed status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.geo import haversine_m
from pathloom.operators.scan import previous_row
from pathloom.plans import mapping as M
from pathloom.plans.registry import Tables, query
from pathloom.streaming import events as E
from pathloom.streaming import trackers as T

c = F.col

_STATUS = f"SELECT provider, vehicle_id, event_id AS observation_id, observed_at, lat, lon, NOT (is_disabled OR is_reserved) AS available FROM ({M.VEHICLES}) v"


@query(
    "T1",
    f"""SELECT provider, vehicle_id, observation_id, available, observed_at < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 120 SECOND AS stale FROM (
          SELECT *, row_number() OVER (PARTITION BY provider, vehicle_id ORDER BY observed_at DESC, observation_id DESC) AS rn FROM ({_STATUS}) s) x WHERE rn = 1""",
)
def t1(t: Tables) -> DataFrame:
    status = E.with_stale(E.latest_status(t.sql(_STATUS)), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    return status.select("provider", "vehicle_id", "observation_id", "available", "stale")


@query("T5", "SELECT user_id AS device_id, arg_max(event_id, ts) AS fix_id FROM events GROUP BY user_id")
def t5(t: Tables) -> DataFrame:
    fixes = t.sql(M.FIXES).withColumnsRenamed({"trip_id": "device_id", "event_id": "fix_id"})
    return E.latest_fix(fixes).select("device_id", "fix_id")


def _fixes(t: Tables) -> DataFrame:
    return t.sql(M.FIXES).select(
        "trip_id", c("event_id").alias("fix_id"), F.unix_micros(c("ts").cast("timestamp")).alias("ts_us"), "lat", "lon", "accuracy_m",
        F.when(c("event_id") % 3 == 0, (c("event_id") % 90).cast("double")).alias("heading"), F.lit(1.4).alias("speed"),
    )


@query("T2")
def t2(t: Tables) -> DataFrame:
    matched = T.follow(_fixes(t), t.sql(M.ROUTE_VERTICES), "matcher")
    return matched.select("trip_id", "fix_id", "geometry_index", F.round("distance_m", 3).alias("distance_m"), F.round("confidence", 6).alias("confidence"), "off_route")


@query("T3")
def t3(t: Tables) -> DataFrame:
    tracked = T.follow(_fixes(t), t.sql(M.ROUTE_VERTICES), "progress")
    return tracked.select(
        "trip_id", "fix_id", "geometry_index", F.round("distance_m", 3).alias("distance_m"), F.round("remaining_m", 3).alias("remaining_m"),
        F.round("fraction", 6).alias("fraction"), "off_route", "arrived",
    )


@query("T4")
def t4(t: Tables) -> DataFrame:
    """Off-route alerts; after one, the next comes 30 s later at the earliest."""
    fixes = _fixes(t)
    tracked = T.follow(fixes, t.sql(M.ROUTE_VERTICES), "progress").filter(c("off_route") & ~c("arrived"))
    timed = tracked.join(fixes.select("trip_id", "fix_id", "ts_us"), ["trip_id", "fix_id"])
    alerts = T.spaced(timed.select(c("trip_id").alias("key"), c("ts_us").alias("at_us"), c("fix_id").alias("id")), 30)
    return alerts.select(c("key").alias("trip_id"), c("id").alias("fix_id"))


_REQUESTED = "SELECT event_id, ts, user_id % 5 AS origin, event_type AS mode, CAST(floor(value / 5e1) AS BIGINT) AS destination FROM events"


@query(
    "T6",
    f"""WITH RECURSIVE e AS (SELECT coalesce(destination, -1) AS d, coalesce(mode, '') AS m, origin AS o, epoch_us(ts) AS at_us, min(event_id) AS event_id FROM ({_REQUESTED}) q GROUP BY 1, 2, 3, 4),
          n AS (SELECT d, m, o, at_us, min(at_us) OVER later AS to_us, first_value(event_id) OVER later AS to_id FROM e
            WINDOW later AS (PARTITION BY d, m, o ORDER BY at_us RANGE BETWEEN 300000000 FOLLOWING AND UNBOUNDED FOLLOWING)),
          r AS (SELECT d, m, o, min(at_us) AS at_us, arg_min(event_id, at_us) AS event_id FROM e GROUP BY d, m, o
            UNION ALL SELECT n.d, n.m, n.o, n.to_us, n.to_id FROM r JOIN n ON n.d = r.d AND n.m = r.m AND n.o = r.o AND n.at_us = r.at_us WHERE n.to_us IS NOT NULL)
        SELECT event_id FROM r""",
)
def t6(t: Tables) -> DataFrame:
    """Requests that are not answered by a response at most 300 s old to the same canonical request."""
    asked = t.sql(_REQUESTED).withColumn("request_hash", E.request_hash(F.struct("destination", "mode", "origin")))
    timed = asked.select(c("request_hash").alias("key"), F.unix_micros(c("ts").cast("timestamp")).alias("at_us"), c("event_id").alias("id"))
    return T.spaced(timed, 300).select(c("id").alias("event_id"))


_SESSION = """SELECT user_id AS trip_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'PLAN' WHEN 'view' THEN 'ROUTES_READY' WHEN 'click' THEN 'START' WHEN 'error' THEN 'OFF_ROUTE'
  WHEN 'purchase' THEN CASE WHEN event_id % 10 = 0 THEN 'ARRIVE' ELSE 'STOP' END END AS event FROM events"""
_NEXT = """CASE WHEN s = 'idle' AND e = 'PLAN' THEN 'planning.requesting' WHEN s = 'planning.requesting' AND e = 'ROUTES_READY' THEN 'preview' WHEN s = 'preview' AND e = 'START' THEN 'navigating'
  WHEN s = 'preview' AND e = 'PLAN' THEN 'planning.requesting' WHEN s = 'navigating' AND e = 'OFF_ROUTE' THEN 'recalculating' WHEN s = 'navigating' AND e = 'ARRIVE' THEN 'arrived'
  WHEN s = 'recalculating' AND e = 'ROUTES_READY' THEN 'navigating' WHEN e = 'STOP' AND s <> 'idle' THEN 'idle' ELSE s END"""


@query(
    "T7",
    f"""SELECT trip_id, list_reduce(list_prepend('idle', list(event ORDER BY ts, event_id)), lambda s, e: {_NEXT}) AS state FROM ({_SESSION}) x GROUP BY trip_id""",
)
def t7(t: Tables) -> DataFrame:
    return E.replay(t.sql(_SESSION), F.to_date("ts"))


@query(
    "T8",
    f"""SELECT user_id AS subject, count(*) FILTER (ts + INTERVAL 30 DAY > TIMESTAMP '{M.AS_OF}') AS kept, count(*) FILTER (ts + INTERVAL 30 DAY <= TIMESTAMP '{M.AS_OF}') AS expired
        FROM events WHERE event_type = 'view' GROUP BY user_id""",
)
def t8(t: Tables) -> DataFrame:
    expires = c("ts") + F.expr("INTERVAL 30 DAYS")
    alive = expires > F.lit(M.AS_OF).cast("timestamp_ntz")
    views = t["events"].filter(c("event_type") == "view")
    return views.groupBy(c("user_id").alias("subject")).agg(F.count_if(alive).alias("kept"), F.count_if(~alive).alias("expired"))


@query(
    "W6",
    f"""SELECT trip_id, event_id, x AND coalesce(lag(x, 1) OVER w, false) AND coalesce(lag(x, 2) OVER w, false) AS off_route FROM (
          SELECT trip_id, event_id, ts, {M.haversine('lat', 'lon', '32.06', 'CAST(34.75 AS DOUBLE) + (trip_id % 50) * 100 / 1e5')} > greatest(300, accuracy_m * 40) AS x FROM ({M.FIXES}) f) y
        WINDOW w AS (PARTITION BY trip_id ORDER BY ts, event_id)""",
)
def w6(t: Tables) -> DataFrame:
    away = haversine_m(c("lat"), c("lon"), 32.06, F.lit(34.75) + (c("trip_id") % 50) * 100 / 1e5)
    fixes = t.sql(M.FIXES).withColumn("exceeds", away > F.greatest(F.lit(300.0), c("accuracy_m") * 40))
    return off_route(fixes.select("trip_id", "event_id", "ts", "exceeds"), F.to_date("ts")).select("trip_id", "event_id", "off_route")


def off_route(fixes: DataFrame, chunk) -> DataFrame:
    """A fix is off route when it and the two before it exceed the threshold."""
    seen = previous_row(fixes, ["trip_id"], ["ts", "event_id"], ["exceeds"], chunk, depth=2)
    earlier = [F.coalesce(c(f"prev{d}_exceeds"), F.lit(False)) for d in (1, 2)]
    return seen.withColumn("off_route", c("exceeds") & earlier[0] & earlier[1])


@query(
    "A9",
    f"""SELECT provider, count(*) AS observations, CASE WHEN max(observed_at) < TIMESTAMP '2024-01-30 23:50:00' THEN 'configured' ELSE 'online' END AS status FROM ({M.VEHICLES}) v GROUP BY provider
        UNION ALL SELECT 9, 0, 'not_configured'""",
)
def a9(t: Tables) -> DataFrame:
    expected = t.spark.range(1).select(F.explode(F.array(*[F.lit(p).cast("long") for p in (0, 1, 2, 9)])).alias("provider"))
    return feed_status(expected, t.sql(M.VEHICLES), F.lit("2024-01-30 23:50:00").cast("timestamp_ntz"))


def feed_status(expected: DataFrame, observations: DataFrame, fresh_since) -> DataFrame:
    """Per expected feed: whether it was ever seen, and whether its newest observation is fresh."""
    seen = observations.groupBy("provider").agg(F.count("*").alias("observations"), F.max("observed_at").alias("_newest"))
    status = (
        F.when(c("observations").isNull(), "not_configured").when(c("_newest") < fresh_since, "configured").otherwise("online")
    )
    return expected.join(seen, "provider", "left").select("provider", F.coalesce("observations", F.lit(0)).alias("observations"), status.alias("status"))
