"""Itinerary documents of three provider contracts, normalised to itinerary, leg and maneuver tables.

Request columns expected next to each payload: ``mode``, ``kind``, ``can_fold``, ``arrive_by`` (boolean) and
``requested_s`` (epoch seconds of the requested departure or arrival), and ``preference``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import rules, text
from pathloom.operators.polyline import decode_polylines, polyline_length
from pathloom.operators.selection import top_k

c = F.col

_STREET_TRIP = (
    "struct<legs:array<struct<shape:string,summary:struct<length:double,time:double>,maneuvers:array<struct<"
    "instruction:string,begin_shape_index:double,length:double,time:double,type:double,street_names:array<string>>>>>>"
)
STREET = f"trip {_STREET_TRIP}, alternates array<struct<trip:{_STREET_TRIP}>>"
_PLACE = "struct<name:string>"
TRANSIT = (
    "itineraries array<struct<startTime:string,endTime:string,legs:array<struct<mode:string,bikesAllowed:boolean,distance:double,"
    f"duration:double,from:{_PLACE},to:{_PLACE},legGeometry:struct<points:string>,agencyName:string,displayName:string,"
    "routeShortName:string,headsign:string,startTime:string,endTime:string>>>>"
)
PLANNER = (
    "plan struct<itineraries:array<struct<startTime:bigint,endTime:bigint,legs:array<struct<mode:string,bikesAllowed:string,"
    f"distance:double,duration:double,from:{_PLACE},to:{_PLACE},legGeometry:struct<points:string>,agencyName:string,"
    "routeShortName:string,headsign:string>>>>>"
)


def geometries(legs: DataFrame, precision: int) -> DataFrame:
    """Vertices of the distinct polylines of a leg table; equal shapes are decoded once."""
    return decode_polylines(legs.filter(c("polyline") != "").select("polyline").distinct(), ["polyline"], "polyline", precision)


# -- street contract --------------------------------------------------------------------------------------------
def street_legs(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """Legs of the main trip and its alternates; kilometres become metres."""
    parsed = payloads.withColumn("_p", F.from_json(payload, STREET))
    trips = F.concat(F.array("_p.trip"), F.coalesce(F.transform("_p.alternates", lambda a: a["trip"]), F.array().cast(f"array<{_STREET_TRIP}>")))
    rows = parsed.select(key, "mode", "arrive_by", "requested_s", F.posexplode(trips).alias("itinerary", "_t"))
    legs = rows.select(key, "mode", "arrive_by", "requested_s", "itinerary", F.posexplode("_t.legs").alias("leg_index", "_l"))
    return legs.select(
        key, "itinerary", "leg_index", "mode", "arrive_by", "requested_s", F.coalesce("_l.shape", F.lit("")).alias("polyline"),
        (F.coalesce("_l.summary.length", F.lit(0.0)) * 1000).alias("distance_m"),
        F.coalesce("_l.summary.time", F.lit(0.0)).alias("duration_s"), c("_l.maneuvers").alias("maneuvers"),
    )


def street_itineraries(legs: DataFrame, key: str) -> DataFrame:
    """One row per itinerary; for arrival requests the departure is counted back."""
    total = legs.groupBy(key, "itinerary", "mode", "arrive_by", "requested_s").agg(
        F.sum("duration_s").alias("duration_s"), F.sum("distance_m").alias("distance_m"), F.count("*").alias("legs")
    )
    departure = F.when(c("arrive_by"), c("requested_s") - c("duration_s")).otherwise(c("requested_s"))
    return total.withColumn("departure_s", departure).withColumn("arrival_s", departure + c("duration_s"))


def street_maneuvers(legs: DataFrame, key: str) -> DataFrame:
    rows = legs.select(key, "itinerary", "leg_index", F.posexplode("maneuvers").alias("position", "_m"))
    return rows.select(
        key, "itinerary", "leg_index", "position", F.coalesce("_m.instruction", F.lit("Continue")).alias("instruction"),
        F.coalesce(c("_m.begin_shape_index").cast("long"), F.lit(0)).alias("begin_index"),
        (F.coalesce("_m.length", F.lit(0.0)) * 1000).alias("distance_m"), F.coalesce("_m.time", F.lit(0.0)).alias("duration_s"),
        F.get("_m.street_names", F.lit(0)).alias("street_name"),
        rules.maneuver_modifier(c("_m.instruction"), F.coalesce("_m.type", F.lit(0.0))).alias("modifier"),
    )


# -- transit contract -------------------------------------------------------------------------------------------
def transit_legs(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """All legs with their mapped mode and whether the request's vehicle is admitted on them."""
    parsed = payloads.withColumn("_p", F.from_json(payload, TRANSIT))
    asked = [key, "mode", "kind", "can_fold", "arrive_by", "requested_s", "preference"]
    rows = parsed.select(*asked, F.posexplode("_p.itineraries").alias("itinerary", "_i"))
    legs = rows.select(
        *asked, "itinerary", rules.parse_instant(c("_i.startTime")).alias("start"), rules.parse_instant(c("_i.endTime")).alias("end"),
        F.posexplode("_i.legs").alias("leg_index", "_l"),
    )
    raw = rules.provider_mode(F.coalesce("_l.mode", F.lit("")))
    shared = F.upper("_l.mode") == "BIKE_SHARING"
    leg_mode = F.when((c("mode") == "scooter_transit") & (raw == "bike") & ~shared, "scooter").otherwise(raw)
    folds = rules.can_fold(c("can_fold"), rules.effective_vehicle(c("mode"), c("kind")))
    carries = c("mode").isin("bike_transit", "scooter_transit")
    allowed = F.coalesce(c("_l.bikesAllowed"), F.lit(False))
    return legs.select(
        *asked, "itinerary", "leg_index", F.unix_seconds("start").alias("departure_s"), F.unix_seconds("end").alias("arrival_s"),
        leg_mode.alias("leg_mode"), ((raw == "transit") & carries & ~folds & ~allowed).alias("denied"),
        F.coalesce("_l.legGeometry.points", F.lit("")).alias("polyline"),
        F.coalesce("_l.distance", F.lit(0.0)).alias("reported_m"), F.coalesce("_l.duration", F.lit(0.0)).alias("duration_s"),
        text.display_text(F.coalesce("_l.from.name", F.lit("Origin")), "Origin").alias("from_name"),
        text.display_text(F.coalesce("_l.to.name", F.lit("Destination")), "Destination").alias("to_name"),
        F.coalesce("_l.displayName", "_l.routeShortName").alias("route_name"),
        F.when(c("_l.headsign").isNotNull(), text.display_text(c("_l.headsign"), "")).alias("headsign"),
        F.when(folds, "ALLOWED_FOLDED_POLICY").when(allowed, "ALLOWED_GTFS").alias("bicycle_permission"),
    )


def with_geometry(legs: DataFrame, precision: int) -> DataFrame:
    """Legs with the vertex count of their shape and a distance, measured on the shape where none is reported."""
    shapes = geometries(legs, precision)
    lengths = polyline_length(shapes, ["polyline"]).join(shapes.groupBy("polyline").agg(F.count("*").alias("points")), "polyline")
    measured: Column = F.when(c("reported_m") != 0, c("reported_m")).otherwise(c("length_m"))
    return legs.join(lengths, "polyline", "left").withColumn("points", F.coalesce("points", F.lit(0))).withColumn("distance_m", measured)


def transit_itineraries(legs: DataFrame, key: str, keep: int = 4) -> DataFrame:
    """Permitted itineraries on time, ranked; legs without a usable shape do not count."""
    usable = c("points") >= 2
    total = with_geometry(legs, 6).groupBy(key, "itinerary", "arrive_by", "requested_s", "preference", "departure_s", "arrival_s").agg(
        F.bool_or("denied").alias("_denied"), F.count_if(usable).alias("legs"),
        F.count_if(usable & (c("leg_mode") == "transit")).alias("transit_legs"),
        F.sum(F.when(usable, c("distance_m"))).alias("distance_m"),
    )
    good = total.filter(
        ~c("_denied") & (c("legs") > 0) & rules.on_time(c("arrive_by"), c("departure_s"), c("arrival_s"), c("requested_s"))
    )
    first = F.when(c("preference") == "fewer_transfers", c("transit_legs")).otherwise(c("arrival_s") - c("departure_s"))
    return top_k(good, [key], [first, c("arrival_s"), c("itinerary")], keep).drop("_denied")


# -- planner contract -------------------------------------------------------------------------------------------
def planner_legs(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    parsed = payloads.withColumn("_p", F.from_json(payload, PLANNER))
    rows = parsed.select(key, "kind", F.posexplode("_p.plan.itineraries").alias("itinerary", "_i"))
    legs = rows.select(
        key, "kind", "itinerary", F.timestamp_millis("_i.startTime").alias("departure_at"), F.timestamp_millis("_i.endTime").alias("arrival_at"),
        F.posexplode("_i.legs").alias("leg_index", "_l"),
    )
    mode = rules.provider_mode(F.coalesce("_l.mode", F.lit("")))
    permission = c("_l.bikesAllowed")
    unknown = (mode == "transit") & (c("kind") == "full_size_bike") & ~F.coalesce(permission == "ALLOWED", F.lit(False))
    return legs.select(
        key, "itinerary", "leg_index", "departure_at", "arrival_at", mode.alias("leg_mode"), unknown.alias("denied"),
        F.coalesce("_l.legGeometry.points", F.lit("")).alias("polyline"), F.coalesce("_l.distance", F.lit(0.0)).alias("distance_m"),
        F.coalesce("_l.duration", F.lit(0.0)).alias("duration_s"), F.coalesce("_l.from.name", F.lit("Origin")).alias("from_name"),
        F.coalesce("_l.to.name", F.lit("Destination")).alias("to_name"), c("_l.routeShortName").alias("route_name"),
        c("_l.headsign").alias("headsign"), permission.alias("bicycle_permission"),
    )


def planner_itineraries(legs: DataFrame, key: str) -> DataFrame:
    total = legs.groupBy(key, "itinerary", "departure_at", "arrival_at").agg(
        F.bool_or("denied").alias("_denied"), F.count("*").alias("legs"), F.sum("distance_m").alias("distance_m")
    )
    return total.filter(~c("_denied")).drop("_denied")
