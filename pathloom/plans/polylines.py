"""Polyline and path-geometry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import geo, profile
from pathloom.operators import polyline as P
from pathloom.operators.scan import with_neighbour
from pathloom.operators.spatial import nearest
from pathloom.plans import mapping as M
from pathloom.plans.registry import Tables, query

c = F.col

_CHARS = """array_to_string(list_transform(range(CAST(ceil(length(bin({z})) / 5.0) AS BIGINT)), lambda i:
  chr(CAST(63 + (({z} >> CAST(5 * i AS INTEGER)) & 31) + CASE WHEN i < CAST(ceil(length(bin({z})) / 5.0) AS BIGINT) - 1 THEN 32 ELSE 0 END AS INTEGER))), '')"""
ENCODE_SQL = f"""
SELECT route_id, string_agg({_CHARS.format(z='za')} || {_CHARS.format(z='zb')}, '' ORDER BY idx) AS polyline FROM (
  SELECT route_id, idx, CASE WHEN da < 0 THEN -2 * da - 1 ELSE 2 * da END AS za, CASE WHEN db < 0 THEN -2 * db - 1 ELSE 2 * db END AS zb FROM (
    SELECT route_id, idx, a - coalesce(lag(a) OVER w, 0) AS da, b - coalesce(lag(b) OVER w, 0) AS db FROM (
      SELECT route_id, idx, CAST(round_even(lat * 1e6, 0) AS BIGINT) AS a, CAST(round_even(lon * 1e6, 0) AS BIGINT) AS b FROM ({M.WALKS}) k) q
    WINDOW w AS (PARTITION BY route_id ORDER BY idx)) d) z GROUP BY route_id"""


@query("C6", ENCODE_SQL)
def c6(t: Tables) -> DataFrame:
    return P.encode_polylines(t.sql(M.WALKS), ["route_id"])


@query(
    "C7",
    f"""SELECT route_id, idx, round_even(lat * 1e6, 0) / 1e6 AS lat6, round_even(lon * 1e6, 0) / 1e6 AS lon6,
               round_even(lat * 1e5, 0) / 1e5 AS lat5, round_even(lon * 1e5, 0) / 1e5 AS lon5 FROM ({M.WALKS}) k""",
)
def c7(t: Tables) -> DataFrame:
    walks = t.sql(M.WALKS)
    fine = P.decode_polylines(P.encode_polylines(walks, ["route_id"]), ["route_id"])
    coarse = P.decode_polylines(P.encode_polylines(walks, ["route_id"], precision=5), ["route_id"], precision=5)
    return fine.select("route_id", "idx", c("lat").alias("lat6"), c("lon").alias("lon6")).join(
        coarse.select("route_id", "idx", c("lat").alias("lat5"), c("lon").alias("lon5")), ["route_id", "idx"]
    )


@query(
    "C8",
    f"""SELECT event_id, idx, round(round(d, 6), 4) AS distance_m FROM (
          SELECT f.event_id, v.idx, {M.haversine('f.lat', 'f.lon', 'v.lat', 'v.lon')} AS d,
                 row_number() OVER (PARTITION BY f.event_id ORDER BY round({M.haversine('f.lat', 'f.lon', 'v.lat', 'v.lon')}, 6), v.idx) AS rn
          FROM ({M.FIXES}) f JOIN ({M.ROUTE_VERTICES}) v ON f.trip_id = v.trip_id) x WHERE rn = 1""",
)
def c8(t: Tables) -> DataFrame:
    found = nearest(
        t.sql(M.FIXES).select("event_id", "trip_id", "lat", "lon"),
        t.sql(M.ROUTE_VERTICES),
        point_id="event_id",
        target_id="idx",
        by=["trip_id"],
    )
    return found.select("event_id", "idx", F.round("distance_m", 4).alias("distance_m"))


@query(
    "W1",
    f"""SELECT route_id, idx, round(coalesce(sum(d) OVER (PARTITION BY route_id ORDER BY idx), 0), 3) AS along_m FROM (
          SELECT route_id, idx, {M.haversine('pl', 'pn', 'lat', 'lon')} AS d FROM (
            SELECT *, lag(lat) OVER w AS pl, lag(lon) OVER w AS pn FROM ({M.WALKS}) k WINDOW w AS (PARTITION BY route_id ORDER BY idx)) a) b""",
)
def w1(t: Tables) -> DataFrame:
    along = P.cumulative_distances(t.sql(M.WALKS), ["route_id"])
    return along.select("route_id", "idx", F.round("along_m", 3).alias("along_m"))


@query(
    "A8",
    f"""SELECT route_id, round(coalesce(sum(d), 0), 3) AS length_m FROM (
          SELECT route_id, {M.haversine('pl', 'pn', 'lat', 'lon')} AS d FROM (
            SELECT *, lag(lat) OVER w AS pl, lag(lon) OVER w AS pn FROM ({M.WALKS}) k WINDOW w AS (PARTITION BY route_id ORDER BY idx)) a) b GROUP BY route_id""",
)
def a8(t: Tables) -> DataFrame:
    lengths = P.polyline_length(t.sql(M.WALKS), ["route_id"])
    return lengths.select("route_id", F.round("length_m", 3).alias("length_m"))


# consecutive vertices of a walk as the edges of a path
PATH_EDGES_SQL = f"""
SELECT route_id, idx AS seq, route_id * 100000 + idx AS edge_id, lat AS lat1, lon AS lon1, lat2, lon2, 2 + idx % 3 AS n_points,
       (route_id * 37 + idx * 13) % 100 AS shade_seed, {M.haversine('lat', 'lon', 'lat2', 'lon2')} AS distance_m
FROM (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM ({M.WALKS}) k WINDOW w AS (PARTITION BY route_id ORDER BY idx)) a
WHERE lat2 IS NOT NULL"""


def path_edges(t: Tables) -> DataFrame:
    steps = with_neighbour(t.sql(M.WALKS), ["route_id"], "idx", ["lat", "lon"], step=1, prefix="next_")
    steps = steps.filter(c("next_lat").isNotNull())
    return steps.select(
        "route_id",
        c("idx").alias("seq"),
        (c("route_id") * 100000 + c("idx")).alias("edge_id"),
        F.concat(F.lit("Street "), (c("idx") % 7).cast("string")).alias("name"),
        c("lat").alias("lat1"),
        c("lon").alias("lon1"),
        c("next_lat").alias("lat2"),
        c("next_lon").alias("lon2"),
        (2 + c("idx") % 3).alias("n_points"),
        F.pmod(c("route_id") * 37 + c("idx") * 13, F.lit(100)).alias("shade_seed"),
        geo.haversine_m(c("lat"), c("lon"), c("next_lat"), c("next_lon")).alias("distance_m"),
    )


_DEPARTURE_S = 1704096000  # 2024-01-01 08:00 UTC, 10:00 local


@query(
    "W2",
    f"""SELECT route_id, seq, start_index, start_index + n_points - 1 AS end_index, round(s, 6) AS shade,
          CASE WHEN s >= 0.75 THEN 'shade' WHEN s >= 0.25 THEN 'mixed' ELSE 'sun' END AS classification FROM (
          SELECT *, greatest(0.0, least(1.0, v[l + 1] * (1 - (p - floor(p))) + v[(l + 1) % 24 + 1] * (p - floor(p)))) AS s FROM (
            SELECT *, CAST(floor(p) AS BIGINT) % 24 AS l, list_transform(range(24), lambda h: ((shade_seed + h * 17) % 100) / 1e2) AS v FROM (
              SELECT *, CAST(coalesce(sum(n_points - 1) OVER w, 0) AS BIGINT) AS start_index,
                     ((36000 + coalesce(sum(distance_m / 1.35) OVER w, 0)) % 86400) / 86400.0 * 24 AS p
              FROM ({PATH_EDGES_SQL}) e WINDOW w AS (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) a) b) d""",
)
def w2(t: Tables) -> DataFrame:
    timed = P.entry_times(path_edges(t), ["route_id"], F.lit(1.35))
    bins = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.pmod(c("shade_seed") + h * 17, F.lit(100)) / 100.0)
    at = F.pmod(F.lit(36000.0) + c("entry_s"), F.lit(86400.0))
    shaded = timed.withColumn("s", profile.daily_value(bins, at))
    return shaded.select(
        "route_id", "seq", "start_index", "end_index", F.round("s", 6).alias("shade"),
        profile.exposure_class(c("s")).alias("classification"),
    )


@query(
    "W3",
    f"""WITH e AS (SELECT *, {M.bearing('lat1', 'lon1', 'lat2', 'lon2')} AS b FROM ({PATH_EDGES_SQL}) p),
        m AS (SELECT *, lag(b) OVER (PARTITION BY route_id ORDER BY seq) AS pb,
                     CAST(coalesce(sum(n_points - 1) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS geometry_index FROM e)
        SELECT route_id, seq, 'maneuver-' || edge_id AS maneuver_id, CASE WHEN seq = 0 THEN 'navigation.depart' ELSE 'navigation.turn' END AS instruction_key,
               CASE WHEN seq = 0 THEN 'depart' ELSE {M.turn_class(M.turn('pb', 'b'))} END AS modifier, 'Street ' || (seq % 7) AS street_name,
               geometry_index, round_even(distance_m * 10, 0) / 10 AS distance_m FROM m
        UNION ALL SELECT route_id, max(seq) + 1, 'maneuver-arrive', 'navigation.arrive', 'arrive', NULL, CAST(sum(n_points - 1) AS BIGINT), 0.0 FROM e GROUP BY route_id""",
)
def w3(t: Tables) -> DataFrame:
    turns = P.maneuvers(path_edges(t), ["route_id"])
    return turns.select(
        "route_id", "seq", "maneuver_id", "instruction_key", "modifier", "street_name", "geometry_index", "distance_m"
    )


# walks cut into legs of five vertices; even legs repeat the first vertex of the next leg
_LEG_VERTICES = f"""
SELECT route_id, CAST(floor(idx / 5e0) AS BIGINT) AS leg_index, idx % 5 AS pos, lat, lon FROM ({M.WALKS}) k
UNION ALL
SELECT route_id, CAST(floor(idx / 5e0) AS BIGINT) - 1 AS leg_index, CAST(5 AS BIGINT) AS pos, lat, lon FROM ({M.WALKS}) k2
WHERE idx % 10 = 5"""


@query(
    "R10",
    f"""SELECT route_id, leg_index, pos, CAST(row_number() OVER (PARTITION BY route_id ORDER BY leg_index, pos) - 1 AS BIGINT) AS idx, lat, lon FROM (
          SELECT *, lag(lat) OVER w AS pl, lag(lon) OVER w AS pn FROM ({_LEG_VERTICES}) v WINDOW w AS (PARTITION BY route_id ORDER BY leg_index, pos)) x
        WHERE NOT (pos = 0 AND coalesce(pl = lat AND pn = lon, false))""",
)
def r10(t: Tables) -> DataFrame:
    return P.stitch_legs(t.sql(_LEG_VERTICES)).select("route_id", "leg_index", "pos", "idx", "lat", "lon")


@query(
    "J13",
    f"""WITH m AS (SELECT route_id, seq, CAST(coalesce(sum(n_points - 1) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g
                   FROM ({PATH_EDGES_SQL}) p),
        q AS (SELECT k.event_id, k.user_id AS route_id, k.event_id % n.total AS progress_index FROM events k
              JOIN (SELECT route_id, CAST(sum(n_points - 1) AS BIGINT) AS total FROM ({PATH_EDGES_SQL}) p2 GROUP BY route_id) n ON n.route_id = k.user_id)
        SELECT q.event_id, q.route_id, q.progress_index, max(m.seq) AS maneuver FROM q JOIN m ON m.route_id = q.route_id AND m.g <= q.progress_index
        GROUP BY q.event_id, q.route_id, q.progress_index""",
)
def j13(t: Tables) -> DataFrame:
    edges = path_edges(t)
    turns = P.maneuvers(edges, ["route_id"]).filter(c("modifier") != "arrive").select("route_id", "seq", "geometry_index")
    counts = edges.groupBy("route_id").agg(F.sum(c("n_points") - 1).cast("long").alias("n_vertices"))
    progress = (
        t["events"].select("event_id", c("user_id").alias("route_id")).join(counts, "route_id")
        .select("event_id", "route_id", (c("event_id") % c("n_vertices")).alias("progress_index"))
    )
    return P.current_maneuver(progress, turns, counts, "route_id").select(
        "event_id", "route_id", "progress_index", "maneuver"
    )


_SLICES = f"SELECT route_id, idx AS start_index, idx + 1 + idx % 3 AS end_index FROM ({M.WALKS}) w WHERE idx % 2 = 0"


@query(
    "J14",
    f"""SELECT a.route_id, a.start_index, a.end_index, string_agg(CAST(CAST(round(v.lon * 1e5, 0) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round(v.lat * 1e5, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY v.idx) AS points
        FROM ({_SLICES}) a JOIN ({M.WALKS}) v ON v.route_id = a.route_id AND v.idx BETWEEN a.start_index AND a.end_index GROUP BY 1, 2, 3""",
)
def j14(t: Tables) -> DataFrame:
    cut = P.slices(t.sql(_SLICES), t.sql(M.WALKS), "route_id")
    text = F.transform(
        c("points"),
        lambda p: F.concat_ws(" ", F.round(p["lon"] * 1e5).cast("long"), F.round(p["lat"] * 1e5).cast("long")),
    )
    return cut.select("route_id", "start_index", "end_index", F.array_join(text, ",").alias("points"))
