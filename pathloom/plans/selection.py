"""Route comparison and per-request aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import rules
from pathloom.functions.geo import round_even
from pathloom.operators import selection as S
from pathloom.operators.scan import keep_first
from pathloom.plans import mapping as M
from pathloom.plans.polylines import PATH_EDGES_SQL, path_edges
from pathloom.plans.registry import Tables, query

c = F.col

_A = f"a AS ({M.ALTERNATIVES}), r AS ({M.ROUTE_REQUESTS})"
_FAST = "f AS (SELECT request_id, min(duration_s) AS fd FROM a GROUP BY request_id)"


def _shade_sql(default: int) -> str:
    return f"""SELECT request_id, pos, polyline_key FROM (SELECT a.request_id, a.pos, a.polyline_key,
      row_number() OVER (PARTITION BY a.request_id ORDER BY a.sun_min, a.duration_s, a.pos) AS rn
      FROM a JOIN f USING (request_id) JOIN r USING (request_id) WHERE a.duration_s <= f.fd * (1 + coalesce(r.time_cap, {default}.0::DOUBLE) / 100)) x WHERE rn = 1"""


_QUICK = """q AS (SELECT request_id, pos, polyline_key, signals, duration_s, distance_m FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY duration_s, pos) AS rn FROM a) x WHERE rn = 1)"""


@query(
    "R1",
    f"""WITH {_A}, {_FAST}, b AS ({_shade_sql(15)}), m AS ({_shade_sql(30)})
        SELECT request_id, b.pos AS balanced_pos, m.pos AS maximum_pos FROM b JOIN m USING (request_id)""",
)
def r1(t: Tables) -> DataFrame:
    picks = S.shade_picks(t.sql(M.ALTERNATIVES), t.sql(M.ROUTE_REQUESTS))
    return picks.select("request_id", c("balanced.pos").alias("balanced_pos"), c("maximum.pos").alias("maximum_pos"))


@query(
    "R2",
    f"""WITH {_A}, {_FAST}, {_QUICK}, b AS ({_shade_sql(15)}), m AS ({_shade_sql(30)}),
        u AS (SELECT request_id, 'route.fastest' AS label, 0 AS i, pos, polyline_key FROM q UNION ALL
              SELECT request_id, 'route.balancedShade', 1, pos, polyline_key FROM b UNION ALL
              SELECT request_id, 'route.maximumShade', 2, pos, polyline_key FROM m),
        o AS (SELECT u.*, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN label = CASE r.walk_preference WHEN 'balanced_shade' THEN 'route.balancedShade'
                WHEN 'maximum_shade' THEN 'route.maximumShade' ELSE 'route.fastest' END THEN 0 ELSE 1 END, i) AS rk FROM u JOIN r USING (request_id)),
        d AS (SELECT *, row_number() OVER (PARTITION BY request_id, polyline_key ORDER BY rk) AS seen FROM o)
        SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY rk) - 1 AS position, label, pos,
               CASE WHEN count(*) OVER (PARTITION BY request_id) = 1 THEN 'least_exposed_route' END AS fallback FROM d WHERE seen = 1""",
)
def r2(t: Tables) -> DataFrame:
    return S.shade_comparison(t.sql(M.ALTERNATIVES), t.sql(M.ROUTE_REQUESTS))


@query(
    "R3",
    f"""WITH {_A}, {_QUICK},
        k AS (SELECT a.*, q.signals - a.signals AS red, row_number() OVER (PARTITION BY request_id ORDER BY a.duration_s + a.signals * 25, a.pos) AS rn
              FROM a JOIN q USING (request_id) JOIN r USING (request_id)
              WHERE (q.signals - a.signals >= 2 OR (q.signals > 0 AND (q.signals - a.signals) / q.signals >= 0.2::DOUBLE))
                AND a.duration_s <= q.duration_s * (1 + coalesce(r.time_cap, 10.0::DOUBLE) / 100)
                AND a.distance_m <= q.distance_m * (1 + coalesce(r.distance_cap, 15.0::DOUBLE) / 100)),
        l AS (SELECT * FROM k WHERE rn = 1)
        SELECT q.request_id, CASE WHEN l.pos IS NOT NULL AND r.road_preference = 'fewer_lights' THEN 1::BIGINT ELSE 0::BIGINT END AS position, 'route.fastest' AS label, q.pos,
               CASE WHEN l.pos IS NULL THEN 'no_material_signal_reduction' END AS fallback, -1::BIGINT AS signals_avoided
        FROM q JOIN r USING (request_id) LEFT JOIN l USING (request_id)
        UNION ALL SELECT l.request_id, CASE WHEN r.road_preference = 'fewer_lights' THEN 0::BIGINT ELSE 1::BIGINT END, 'route.fewerLights', l.pos, NULL, greatest(0, l.red)
        FROM l JOIN r USING (request_id)""",
)
def r3(t: Tables) -> DataFrame:
    return S.signal_comparison(t.sql(M.ALTERNATIVES), t.sql(M.ROUTE_REQUESTS))


@query(
    "R4",
    f"""WITH {_A}, {_QUICK}, k AS (SELECT request_id, pos, duration_s FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sun_min, pos) AS rn FROM a) x WHERE rn = 1)
        SELECT request_id, CASE WHEN k.duration_s <= q.duration_s * 1.2::DOUBLE THEN k.pos ELSE q.pos END AS pos FROM q JOIN k USING (request_id)""",
)
def r4(t: Tables) -> DataFrame:
    return S.comfort_choice(t.sql(M.ALTERNATIVES))


@query(
    "R5",
    f"""WITH {_A}, {_QUICK}, w AS (SELECT request_id, pos, polyline_key FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY transfers, duration_s, pos) AS rn FROM a) x WHERE rn = 1)
        SELECT q.request_id, CASE WHEN q.polyline_key <> w.polyline_key AND r.transit_preference = 'fewer_transfers' THEN 1::BIGINT ELSE 0::BIGINT END AS position,
               CASE WHEN q.polyline_key = w.polyline_key THEN 'route.fastestFewestTransfers' ELSE 'route.fastest' END AS label, q.pos FROM q JOIN w USING (request_id) JOIN r USING (request_id)
        UNION ALL SELECT w.request_id, CASE WHEN r.transit_preference = 'fewer_transfers' THEN 0::BIGINT ELSE 1::BIGINT END, 'route.fewerTransfers', w.pos
        FROM q JOIN w USING (request_id) JOIN r USING (request_id) WHERE q.polyline_key <> w.polyline_key""",
)
def r5(t: Tables) -> DataFrame:
    return S.transit_comparison(t.sql(M.ALTERNATIVES), t.sql(M.ROUTE_REQUESTS))


_DIVERSE = f"""SELECT trip_id AS itinerary_id, trip_id % 10 AS request_id, CAST((trip_id * 37) % 50 + 60 AS DOUBLE) AS duration_s, idx, lat, lon
  FROM ({M.ROUTE_VERTICES}) v"""


@query(
    "R6",
    f"""WITH g AS (SELECT request_id, itinerary_id, duration_s, string_agg(CAST(CAST(round_even(lat * 1e4, 0) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round_even(lon * 1e4, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY idx) AS k
                   FROM ({_DIVERSE}) d GROUP BY 1, 2, 3),
        n AS (SELECT *, row_number() OVER (PARTITION BY request_id, k ORDER BY duration_s, itinerary_id) AS seen FROM g
              JOIN (SELECT request_id, min(duration_s) AS best FROM g GROUP BY 1) b USING (request_id) WHERE duration_s <= best * 1.5)
        SELECT * FROM (SELECT request_id, itinerary_id, duration_s, row_number() OVER (PARTITION BY request_id ORDER BY duration_s, itinerary_id) AS rank FROM n WHERE seen = 1) x WHERE rank <= 3""",
)
def r6(t: Tables) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("idx", "lat", "lon")))
    trips = t.sql(_DIVERSE).groupBy("request_id", "itinerary_id", "duration_s").agg(
        F.transform(ordered, lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon"))).alias("geometry")
    )
    return S.diverse(trips).select("request_id", "itinerary_id", "duration_s", "rank")


_MODE_OF = "CASE CAST(request_id % 3 AS INTEGER) WHEN 0 THEN 'walk' WHEN 1 THEN 'bike' ELSE 'car' END"


@query(
    "R7",
    f"""WITH {_A}, {_QUICK}, x AS (SELECT a.*, q.duration_s AS fd, q.distance_m AS fm, q.signals AS fs, {_MODE_OF} AS mode FROM a JOIN q USING (request_id))
        SELECT request_id, pos, round_even(distance_m * 10, 0) / 10 AS distance_m, round_even(duration_s * 10, 0) / 10 AS duration_s,
          CASE WHEN mode = 'walk' THEN round_even(distance_m * 10, 0) / 10 ELSE 0.0 END AS walking_distance_m,
          CASE WHEN mode = 'bike' THEN round_even(distance_m * 10, 0) / 10 ELSE 0.0 END AS cycling_distance_m,
          CASE WHEN mode = 'walk' THEN round_even(sun_min * 100, 0) / 100 END AS sun_exposure_minutes,
          CASE WHEN mode = 'car' THEN CAST(signals AS DOUBLE) END AS traffic_signals,
          CASE WHEN pos > 1 AND mode = 'car' THEN CAST(greatest(0, fs - signals) AS DOUBLE) END AS signals_avoided,
          CASE WHEN fd <= 0 THEN 0.0 ELSE round_even(greatest(0.0, (duration_s / fd - 1) * 100) * 100, 0) / 100 END AS detour_time_percent,
          CASE WHEN fm <= 0 THEN 0.0 ELSE round_even(greatest(0.0, (distance_m / fm - 1) * 100) * 100, 0) / 100 END AS detour_distance_percent FROM x""",
)
def r7(t: Tables) -> DataFrame:
    routes = t.sql(f"SELECT *, {_MODE_OF} AS mode, pos > 1 AND {_MODE_OF} = 'car' AS is_fewer_lights FROM ({M.ALTERNATIVES}) a")
    return metrics(routes, S.fastest(routes))


def metrics(routes: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metrics block of each route against its request's fastest one; fields that do not apply to a mode are null."""
    joined = routes.join(baseline, "request_id")
    metres = round_even(c("distance_m"), 1)
    return joined.select(
        "request_id",
        "pos",
        metres.alias("distance_m"),
        round_even(c("duration_s"), 1).alias("duration_s"),
        F.when(c("mode") == "walk", metres).otherwise(0.0).alias("walking_distance_m"),
        F.when(c("mode").isin("bike", "scooter"), metres).otherwise(0.0).alias("cycling_distance_m"),
        F.when(c("mode") == "walk", round_even(c("sun_min"), 2)).alias("sun_exposure_minutes"),
        F.when(c("mode").isin("car", "motorcycle", "truck"), c("signals").cast("double")).alias("traffic_signals"),
        F.when(c("is_fewer_lights"), F.greatest(F.lit(0), c("fastest.signals") - c("signals")).cast("double")).alias("signals_avoided"),
        rules.detour_percent(c("duration_s"), c("fastest.duration_s")).alias("detour_time_percent"),
        rules.detour_percent(c("distance_m"), c("fastest.distance_m")).alias("detour_distance_percent"),
    )


@query(
    "R8",
    f"""WITH {_A}, z AS (SELECT a.*, r.transit_preference AS p, a.duration_s + (a.pos * 7) % 5 * 60 AS arrival_s FROM a JOIN r USING (request_id)),
        one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN p = 'fewer_transfers' THEN transfers ELSE duration_s END, arrival_s, pos) AS k1 FROM z) x WHERE k1 <= 4),
        two AS (SELECT *, min(duration_s) OVER (PARTITION BY request_id) AS best,
                  row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN p = 'fewer_transfers' THEN transfers ELSE duration_s END, duration_s, k1) AS k2 FROM one)
        SELECT request_id, k2 AS position, pos, CASE WHEN best <= 0 THEN 0.0 ELSE round_even(greatest(0.0, (duration_s / best - 1) * 100) * 100, 0) / 100 END AS detour_percent FROM two WHERE k2 <= 3""",
)
def r8(t: Tables) -> DataFrame:
    alternatives = t.sql(M.ALTERNATIVES, lineitem="l_orderkey").withColumn("arrival_s", c("duration_s") + (c("pos") * 7) % 5 * 60)
    return S.rank_itineraries(alternatives, t.sql(M.ROUTE_REQUESTS))


@query(
    "R9",
    f"""WITH {_A}, {_QUICK} SELECT a.request_id, a.pos, CASE WHEN NOT r.context_complete THEN 'shade_data_temporarily_unavailable'
          WHEN r.rental_fallback THEN 'rental_availability_unavailable' END AS fallback FROM a JOIN q USING (request_id) JOIN r USING (request_id)
        WHERE r.context_complete OR a.pos = q.pos""",
)
def r9(t: Tables) -> DataFrame:
    return S.context_fallback(t.sql(M.ALTERNATIVES), t.sql(M.ROUTE_REQUESTS))


@query("A5", f"SELECT request_id, min(duration_s) AS duration_s, arg_min(pos, duration_s * 1000 + pos) AS pos FROM ({M.ALTERNATIVES}) a GROUP BY request_id")
def a5(t: Tables) -> DataFrame:
    best = S.fastest(t.sql(M.ALTERNATIVES))
    return best.select("request_id", c("fastest.duration_s").alias("duration_s"), c("fastest.pos").alias("pos"))


@query(
    "W7",
    f"""SELECT request_id, polyline_key, pos, duration_s FROM (SELECT *, row_number() OVER (PARTITION BY request_id, polyline_key ORDER BY pos) AS rn FROM ({M.ALTERNATIVES}) a) x WHERE rn = 1""",
)
def w7(t: Tables) -> DataFrame:
    routes = t.sql(M.ALTERNATIVES).select("request_id", "polyline_key", "pos", "duration_s")
    return keep_first(routes, ["request_id", "polyline_key"], ["pos"])


@query(
    "W8",
    f"""SELECT request_id, pos, rank FROM (SELECT request_id, pos, row_number() OVER (PARTITION BY request_id ORDER BY duration_s DESC, pos) AS rank FROM ({M.ALTERNATIVES}) a) x WHERE rank <= 3""",
)
def w8(t: Tables) -> DataFrame:
    ranked = S.top_k(t.sql(M.ALTERNATIVES), ["request_id"], [c("duration_s").desc(), c("pos")], 3)
    return ranked.select("request_id", "pos", "rank")


_SIGNAL = "CASE WHEN (edge_id % 3) = 0 THEN edge_id % 40 END"


@query(
    "A1",
    f"""SELECT route_id, round(sum(distance_m), 3) AS distance_m, round(sum(distance_m / 1.35), 3) AS duration_s,
               round(sum(distance_m / 1.35 * (1 - shade_seed / 1e2)), 3) AS sun_s, count(DISTINCT {_SIGNAL}) AS signals
        FROM ({PATH_EDGES_SQL}) p GROUP BY route_id""",
)
def a1(t: Tables) -> DataFrame:
    edges = path_edges(t).withColumn("duration_s", c("distance_m") / 1.35)
    edges = edges.withColumn("sun_s", c("duration_s") * (1 - c("shade_seed") / 100.0))
    return path_totals(edges.withColumn("signal_id", F.when(c("edge_id") % 3 == 0, c("edge_id") % 40)), ["route_id"]).select(
        "route_id", *[F.round(n, 3).alias(n) for n in ("distance_m", "duration_s", "sun_s")], "signals"
    )


def path_totals(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of each path: distance, duration, sun exposure and distinct signals."""
    return edges.groupBy(*keys).agg(
        F.sum("distance_m").alias("distance_m"),
        F.sum("duration_s").alias("duration_s"),
        F.sum("sun_s").alias("sun_s"),
        F.count_distinct("signal_id").alias("signals"),
    )


@query(
    "A2",
    f"""SELECT route_id, round(sum(distance_m * (shade_seed / 1e2)) / sum(distance_m), 6) AS shade_fraction,
               round(coalesce(sum(CASE WHEN edge_id % 2 = 0 THEN distance_m * (shade_seed / 1e2) END), 0) / sum(distance_m), 6) AS high_fraction FROM ({PATH_EDGES_SQL}) p GROUP BY route_id""",
)
def a2(t: Tables) -> DataFrame:
    edges = path_edges(t).withColumn("shade", c("shade_seed") / 100.0)
    edges = edges.withColumn("confidence", F.when(c("edge_id") % 2 == 0, "high").otherwise("low"))
    return shade_fractions(edges, ["route_id"]).select(
        "route_id", F.round("shade_fraction", 6).alias("shade_fraction"), F.round("high_fraction", 6).alias("high_fraction")
    )


def shade_fractions(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Distance-weighted shade, in total and from high-confidence edges only."""
    weighted = c("distance_m") * c("shade")
    total = F.sum("distance_m")
    return edges.groupBy(*keys).agg(
        F.when(total > 0, F.sum(weighted) / total).alias("shade_fraction"),
        F.when(total > 0, F.coalesce(F.sum(F.when(c("confidence") == "high", weighted)), F.lit(0.0)) / total).alias("high_fraction"),
    )


@query(
    "A4",
    f"""SELECT itinerary_id, coalesce(sum(distance_m) FILTER (mode = 'walk'), 0) AS walking_m, coalesce(sum(distance_m) FILTER (mode IN ('bike', 'scooter')), 0) AS cycling_m,
               sum(distance_m) AS total_m, greatest(0, count(*) FILTER (mode = 'transit') - 1) AS transfers FROM ({M.ITINERARY_LEGS}) g GROUP BY itinerary_id""",
)
def a4(t: Tables) -> DataFrame:
    return leg_rollup(t.sql(M.ITINERARY_LEGS), ["itinerary_id"])


def leg_rollup(legs: DataFrame, keys: list[str]) -> DataFrame:
    metres = c("distance_m")
    return legs.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(c("mode") == "walk", metres)), F.lit(0.0)).alias("walking_m"),
        F.coalesce(F.sum(F.when(c("mode").isin("bike", "scooter"), metres)), F.lit(0.0)).alias("cycling_m"),
        F.sum(metres).alias("total_m"),
        F.greatest(F.lit(0), F.count_if(c("mode") == "transit") - 1).alias("transfers"),
    )


@query(
    "A7",
    f"""SELECT user_id, round(avg(a), 10) AS lat, round(avg(b), 10) AS lon FROM (SELECT DISTINCT user_id, round(lat * 1e3) / 1e3 AS a, round(lon * 1e3) / 1e3 AS b FROM ({M.POINTS}) p) d GROUP BY user_id""",
)
def a7(t: Tables) -> DataFrame:
    points = t.sql(M.POINTS).select(
        "user_id", (F.round(c("lat") * 1e3) / 1e3).alias("lat"), (F.round(c("lon") * 1e3) / 1e3).alias("lon")
    )
    return centroid(points, ["user_id"], "lat", "lon").select(
        "user_id", F.round("lat", 10).alias("lat"), F.round("lon", 10).alias("lon")
    )


def centroid(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Centroid of the distinct member points of each cluster."""
    distinct = points.select(*keys, x, y).distinct()
    return distinct.groupBy(*keys).agg(F.avg(x).alias(x), F.avg(y).alias(y))


@query(
    "Q5",
    f"""SELECT route_id, bool_or(edge_id % 9 = 0 OR edge_id % 7 = 0) AS incomplete FROM ({PATH_EDGES_SQL}) p GROUP BY route_id""",
)
def q5(t: Tables) -> DataFrame:
    edges = path_edges(t).withColumns(
        {"max_height_m": F.when(c("edge_id") % 9 != 0, 4.0), "max_weight_t": F.when(c("edge_id") % 7 != 0, 20.0)}
    )
    return truck_warnings(edges, ["route_id"])


def truck_warnings(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Paths with any edge whose height or weight limit is unknown."""
    missing = c("max_height_m").isNull() | c("max_weight_t").isNull()
    return edges.groupBy(*keys).agg(F.bool_or(missing).alias("incomplete"))
