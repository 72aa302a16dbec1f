"""Filter queries (F1-F11, F13; F12 lives with the schedule search)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom import constants as K
from pathloom.functions import rules
from pathloom.operators.cells import boxes_to_points
from pathloom.plans import mapping as M
from pathloom.plans.registry import Tables, query

c = F.col


@query(
    "F1",
    f"SELECT point_id, lat BETWEEN 31.94 AND 32.20 AND lon BETWEEN 34.69 AND 34.93 AS covered FROM ({M.POINTS}) p",
)
def f1(t: Tables) -> DataFrame:
    return t.sql(M.POINTS).select("point_id", rules.inside_box(c("lat"), c("lon")).alias("covered"))


def intersect_box(boxes: DataFrame, box: tuple[float, float, float, float] = K.COVERAGE_BBOX) -> DataFrame:
    """Requested box cut down to a coverage box, with a flag for an empty result."""
    west, south, east, north = box
    cut = boxes.withColumns(
        {
            "west": F.greatest(c("west"), F.lit(west)),
            "south": F.greatest(c("south"), F.lit(south)),
            "east": F.least(c("east"), F.lit(east)),
            "north": F.least(c("north"), F.lit(north)),
        }
    )
    return cut.withColumn("valid", (c("west") <= c("east")) & (c("south") <= c("north")))


_BOXES = """SELECT event_id, CAST(34.5 AS DOUBLE) + (event_id % 50) / 1e2 AS west, CAST(31.8 AS DOUBLE) + (event_id % 45) / 1e2 AS south,
  CAST(34.52 AS DOUBLE) + (event_id % 50 + event_id % 7) / 1e2 AS east, CAST(31.82 AS DOUBLE) + (event_id % 45 + event_id % 5) / 1e2 AS north FROM events"""


@query(
    "F2",
    f"""SELECT event_id, w AS west, s AS south, e AS east, n AS north, w <= e AND s <= n AS valid FROM (
          SELECT event_id, greatest(west, 34.69::DOUBLE) AS w, greatest(south, 31.94::DOUBLE) AS s, least(east, 34.93::DOUBLE) AS e,
                 least(north, 32.20::DOUBLE) AS n FROM ({_BOXES}) b) x""",
)
def f2(t: Tables) -> DataFrame:
    return intersect_box(t.sql(_BOXES)).select("event_id", "west", "south", "east", "north", "valid")


_WANTED = f"""SELECT place_id, category, lat, lon, CASE CAST(place_id % 4 AS INTEGER) WHEN 0 THEN '' WHEN 1 THEN 'BUILDING, MACHINERY'
  WHEN 2 THEN 'AUTOMOBILE' END AS wanted FROM ({M.PLACES}) p"""


@query(
    "F3",
    f"""SELECT place_id, category FROM ({_WANTED}) w WHERE lat BETWEEN 32.05 AND 32.15 AND lon BETWEEN 34.75 AND 34.85
          AND (coalesce(wanted, '') = '' OR list_contains(list_transform(string_split(wanted, ','), lambda s: trim(s)), category))""",
)
def f3(t: Tables) -> DataFrame:
    inside = rules.inside_box(c("lat"), c("lon"), (34.75, 32.05, 34.85, 32.15))
    return t.sql(_WANTED).filter(inside & rules.in_categories(c("category"), c("wanted"))).select("place_id", "category")


def nearby_vehicles(centres: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Available, fresh vehicles in the walking catchment of each centre."""
    boxes = centres.select(
        "centre_id",
        (c("lat") - 0.008).alias("south"),
        (c("lon") - 0.009).alias("west"),
        (c("lat") + 0.008).alias("north"),
        (c("lon") + 0.009).alias("east"),
    )
    usable = vehicles.filter(c("available") & ~c("stale"))
    return boxes_to_points(boxes, usable, ["centre_id"], 0.009)


_STATUS = f"""SELECT event_id AS observation_id, provider, vehicle_id, lat, lon, NOT (is_disabled OR is_reserved) AS available,
  event_id % 7 = 0 AS stale FROM ({M.VEHICLES}) v"""


@query(
    "F4",
    f"""SELECT p.place_id AS centre_id, count(*) AS vehicles, CAST(sum(v.observation_id) AS BIGINT) AS id_sum
        FROM ({M.PLACES}) p JOIN ({_STATUS}) v ON v.lat BETWEEN p.lat - 0.008::DOUBLE AND p.lat + 0.008::DOUBLE
          AND v.lon BETWEEN p.lon - 0.009::DOUBLE AND p.lon + 0.009::DOUBLE AND v.available AND NOT v.stale GROUP BY p.place_id""",
)
def f4(t: Tables) -> DataFrame:
    return vehicles_around(t.sql(M.PLACES).withColumnRenamed("place_id", "centre_id"), t.sql(_STATUS))


def vehicles_around(centres: DataFrame, vehicles: DataFrame) -> DataFrame:
    """(centre_id, vehicles, id_sum) of the vehicles in each centre's catchment; centres without any are left out.

    Centres at one spot have one catchment, and observations at one spot are counted before they meet a centre, so the
    pairs that are looked at follow the different spots.
    """
    usable = vehicles.filter(c("available") & ~c("stale"))
    seen = usable.groupBy("lat", "lon").agg(F.count("*").alias("_n"), F.sum("observation_id").alias("_sum"))
    spots = centres.select("lat", "lon").distinct().select(F.struct("lat", "lon").alias("centre_id"), "lat", "lon")
    flagged = seen.withColumns({"available": F.lit(True), "stale": F.lit(False)})
    found = nearby_vehicles(spots, flagged).groupBy("centre_id").agg(F.sum("_n").alias("vehicles"), F.sum("_sum").alias("id_sum"))
    at = found.select(c("centre_id.lat").alias("lat"), c("centre_id.lon").alias("lon"), "vehicles", "id_sum")
    return centres.join(at, ["lat", "lon"]).select("centre_id", "vehicles", "id_sum")


_MODES = f"""SELECT source, target, CASE WHEN (source + target) % 4 = 0 THEN 'walk,bike,scooter' ELSE 'walk,bike,scooter,car,motorcycle,truck' END AS mode_list,
  CASE WHEN source % 2 = 0 THEN 'car' ELSE 'walk' END AS wanted FROM ({M.STREETS}) s"""


@query("F5", f"SELECT source, target, wanted FROM ({_MODES}) m WHERE list_contains(string_split(mode_list, ','), wanted)")
def f5(t: Tables) -> DataFrame:
    edges = t.sql(M.by_key(_MODES)).withColumn("modes", F.split("mode_list", ","))
    return edges.filter(F.array_contains(c("modes"), c("wanted"))).select("source", "target", "wanted")


_LIMITS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 5 = 0 THEN 0.0 WHEN l_suppkey % 5 = 1 THEN NULL ELSE CAST(l_suppkey % 5 AS DOUBLE) END AS vehicle_h,
  CASE WHEN l_partkey % 6 = 0 THEN CAST(0 AS DOUBLE) WHEN l_partkey % 6 = 1 THEN NULL ELSE CAST(l_partkey % 6 AS DOUBLE) END AS limit_h FROM lineitem"""


@query(
    "F6",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, NOT (coalesce(vehicle_h, 0) <> 0 AND coalesce(limit_h, 0) <> 0 AND coalesce(vehicle_h > limit_h, false)) AS allowed
        FROM ({_LIMITS}) x""",
)
def f6(t: Tables) -> DataFrame:
    allowed = rules.dimension_allowed(c("vehicle_h").cast("double"), c("limit_h"))
    return t.sql(_LIMITS).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", allowed.alias("allowed"))


@query(
    "F7",
    f"""SELECT source, target FROM ({M.STREETS}) s WHERE crossing_kind IS NULL OR crossing_confidence <> 'low' OR target % 3 = 0""",
)
def f7(t: Tables) -> DataFrame:
    allow = c("target") % 3 == 0
    return (
        t.sql(M.by_key(M.STREETS))
        .filter(rules.crossing_allowed(c("crossing_kind"), c("crossing_confidence"), allow))
        .select("source", "target")
    )


_SIDES = f"""SELECT s.source, s.target, s.crossing_kind, s.side AS edge_side, m.mode, d.side AS current_side FROM ({M.STREETS}) s
  CROSS JOIN (VALUES ('walk'), ('bike')) AS m(mode) CROSS JOIN (VALUES ('left'), ('right'), ('center')) AS d(side)"""


@query(
    "F8",
    f"""SELECT * FROM (SELECT source, target, mode, current_side, CASE WHEN mode <> 'walk' OR crossing_kind IS NOT NULL THEN 'center' WHEN edge_side IS NULL THEN current_side
          WHEN current_side = 'center' OR current_side = edge_side THEN edge_side END AS next_side FROM ({_SIDES}) x) y WHERE next_side IS NOT NULL""",
)
def f8(t: Tables) -> DataFrame:
    moved = t.sql(M.by_key(_SIDES)).withColumn(
        "next_side", rules.next_side(c("mode"), c("current_side"), c("crossing_kind"), c("edge_side"))
    )
    return moved.filter(c("next_side").isNotNull()).select("source", "target", "mode", "current_side", "next_side")


_TIMED = """SELECT event_id, event_id % 2 = 0 AS arrive_by, 1704067200 + event_id AS requested_s,
  1704067200 + event_id - 90 + event_id % 61 AS departure_s, 1704067200 + event_id + event_id % 121 AS arrival_s FROM events"""


@query(
    "F9",
    f"SELECT event_id FROM ({_TIMED}) x WHERE CASE WHEN arrive_by THEN arrival_s - requested_s <= 60 ELSE requested_s - departure_s <= 60 END",
)
def f9(t: Tables) -> DataFrame:
    kept = rules.on_time(c("arrive_by"), c("departure_s"), c("arrival_s"), c("requested_s"))
    return t.sql(_TIMED).filter(kept).select("event_id")


@query(
    "F10",
    f"""SELECT itinerary_id FROM ({M.ITINERARY_LEGS}) g GROUP BY itinerary_id
        HAVING NOT bool_or(mode = 'transit' AND NOT (itinerary_id % 3 = 0) AND (bike_rule <> 1))""",
)
def f10(t: Tables) -> DataFrame:
    legs = t.sql(M.ITINERARY_LEGS).withColumn("bikes_allowed", F.when(c("bike_rule") < 2, c("bike_rule") == 1))
    folds = c("itinerary_id") % 3 == 0
    return permitted_itineraries(legs, ["itinerary_id"], folds).select("itinerary_id")


def permitted_itineraries(legs: DataFrame, keys: list[str], can_fold) -> DataFrame:
    """Itineraries whose every transit leg admits the vehicle; an unknown permission counts as a denial."""
    denied = (c("mode") == "transit") & ~(F.coalesce(c("bikes_allowed"), F.lit(False)) | can_fold)
    return legs.groupBy(*keys).agg(F.bool_or(denied).alias("_denied")).filter(~c("_denied")).drop("_denied")


@query(
    "F11",
    f"SELECT s.source, s.target FROM ({M.STREETS}) s WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey * 3 = s.source AND s.target = s.source + 1)",
)
def f11(t: Tables) -> DataFrame:
    closed = t["nation"].select((c("n_nationkey").cast("long") * 3).alias("source")).withColumn("target", c("source") + 1)
    return t.sql(M.by_key(M.STREETS)).select("source", "target").join(closed, ["source", "target"], "left_anti")


@query(
    "F13",
    f"SELECT event_id, user_id FROM events WHERE event_type = 'view' AND ts + INTERVAL 30 DAY > TIMESTAMP '{M.AS_OF}'",
)
def f13(t: Tables) -> DataFrame:
    history = t["events"].filter(c("event_type") == "view")
    return unexpired(history, c("ts") + F.expr("INTERVAL 30 DAYS"), M.AS_OF).select("event_id", "user_id")


def unexpired(frame: DataFrame, expires_at, as_of: str) -> DataFrame:
    """Records still valid at an explicit instant."""
    return frame.filter(expires_at > F.lit(as_of).cast("timestamp_ntz"))
