"""Route comparison: picks among the alternatives of each request.

Alternatives need (request_id, pos, duration_s, distance_m, sun_min, signals, transfers, polyline_key). Every pick is
a partial aggregation, so a request with very many alternatives is reduced before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.rules import detour_percent

c = F.col
ROUTE = ("pos", "duration_s", "distance_m", "sun_min", "signals", "transfers", "polyline_key")


def _route() -> Column:
    return F.struct(*ROUTE)


def _fastest() -> Column:
    return F.min_by(_route(), F.struct("duration_s", "pos"))


def fastest(alternatives: DataFrame) -> DataFrame:
    """Fastest alternative of each request, as a struct column ``fastest``."""
    return alternatives.groupBy("request_id").agg(_fastest().alias("fastest"))


def _with_request(alternatives: DataFrame, requests: DataFrame, *columns: str) -> DataFrame:
    """Alternatives next to their request's baseline and wishes."""
    base = fastest(alternatives).join(requests.select("request_id", *columns), "request_id")
    return alternatives.join(base, "request_id")


def within(value: Column, baseline: Column, percent: Column) -> Column:
    return value <= baseline * (1 + percent / 100)


def _shade_pick(cap: Column) -> Column:
    allowed = within(c("duration_s"), c("fastest.duration_s"), cap)
    order = F.when(allowed, F.struct("sun_min", "duration_s", "pos"))
    return F.min_by(F.when(allowed, _route()), order)


def shade_picks(alternatives: DataFrame, requests: DataFrame, preference: str = "walk_preference") -> DataFrame:
    """Per request: fastest, least sun within the balanced cap, least sun within the maximum cap."""
    joined = _with_request(alternatives, requests, "time_cap", preference)
    return joined.groupBy("request_id", preference).agg(
        F.first("fastest").alias("fastest"),
        _shade_pick(F.coalesce(c("time_cap"), F.lit(15.0))).alias("balanced"),
        _shade_pick(F.coalesce(c("time_cap"), F.lit(30.0))).alias("maximum"),
    )


def _ranked(options: Column) -> Column:
    """Options (label, route, ...) in order, later ones with an already seen geometry removed."""
    return F.filter(
        options,
        lambda o, i: ~F.exists(
            F.slice(options, F.lit(1), i), lambda earlier: earlier["route"]["polyline_key"] == o["route"]["polyline_key"]
        ),
    )


def _explode(frame: DataFrame, options: Column, fallback: Column) -> DataFrame:
    kept = frame.withColumn("_options", options)
    rows = kept.select("request_id", fallback.alias("fallback"), F.posexplode("_options").alias("position", "_o"))
    return rows.select(
        "request_id",
        c("position").cast("long").alias("position"),
        c("_o.label").alias("label"),
        c("_o.route.pos").alias("pos"),
        "fallback",
    )


def shade_comparison(alternatives: DataFrame, requests: DataFrame) -> DataFrame:
    """Fastest, balanced and maximum shade, the preferred one first, without repeated geometry."""
    picks = shade_picks(alternatives, requests)
    preferred = (
        F.when(c("walk_preference") == "balanced_shade", "route.balancedShade")
        .when(c("walk_preference") == "maximum_shade", "route.maximumShade")
        .otherwise("route.fastest")
    )

    def option(i: int, label: str, route: str) -> Column:
        return F.struct(
            (preferred != label).alias("other"), F.lit(i).alias("i"), F.lit(label).alias("label"), c(route).alias("route")
        )

    options = F.array_sort(
        F.array(
            option(0, "route.fastest", "fastest"),
            option(1, "route.balancedShade", "balanced"),
            option(2, "route.maximumShade", "maximum"),
        )
    )
    kept = picks.withColumn("_sorted", options).withColumn("_kept", _ranked(c("_sorted")))
    fallback = F.when(F.size("_kept") == 1, "least_exposed_route")
    return _explode(kept, c("_kept"), fallback)


def signal_comparison(alternatives: DataFrame, requests: DataFrame) -> DataFrame:
    """Fastest next to the best alternative with materially fewer lights, or the fastest alone with a reason."""
    joined = _with_request(alternatives, requests, "time_cap", "distance_cap", "road_preference")
    reduction = c("fastest.signals") - c("signals")
    material = (reduction >= 2) | ((c("fastest.signals") > 0) & (reduction / c("fastest.signals") >= 0.2))
    allowed = (
        material
        & within(c("duration_s"), c("fastest.duration_s"), F.coalesce(c("time_cap"), F.lit(10.0)))
        & within(c("distance_m"), c("fastest.distance_m"), F.coalesce(c("distance_cap"), F.lit(15.0)))
    )
    order = F.when(allowed, F.struct((c("duration_s") + c("signals") * 25).alias("score"), c("pos")))
    picks = joined.groupBy("request_id", "road_preference").agg(
        F.first("fastest").alias("fastest"), F.min_by(F.when(allowed, _route()), order).alias("low")
    )
    quick = F.struct(F.lit("route.fastest").alias("label"), c("fastest").alias("route"))
    calm = F.struct(F.lit("route.fewerLights").alias("label"), c("low").alias("route"))
    options = (
        F.when(c("low").isNull(), F.array(quick))
        .when(c("road_preference") == "fewer_lights", F.array(calm, quick))
        .otherwise(F.array(quick, calm))
    )
    avoided = F.greatest(F.lit(0), c("fastest.signals") - c("low.signals"))
    rows = _explode(picks, options, F.when(c("low").isNull(), "no_material_signal_reduction"))
    return rows.join(picks.select("request_id", avoided.alias("_avoided")), "request_id").select(
        *rows.columns, F.when(c("label") == "route.fewerLights", c("_avoided")).otherwise(-1).alias("signals_avoided")
    )


def comfort_choice(alternatives: DataFrame) -> DataFrame:
    """The most comfortable alternative (least ``sun_min`` stands for discomfort) if at most 1.2 times the fastest."""
    picks = alternatives.groupBy("request_id").agg(
        _fastest().alias("fastest"), F.min_by(_route(), F.struct("sun_min", "pos")).alias("calm")
    )
    keep = c("calm.duration_s") <= c("fastest.duration_s") * 1.2
    return picks.select("request_id", F.when(keep, c("calm.pos")).otherwise(c("fastest.pos")).alias("pos"))


def transit_comparison(alternatives: DataFrame, requests: DataFrame) -> DataFrame:
    """Fastest against fewest transfers; one row when both share their geometry."""
    picks = alternatives.groupBy("request_id").agg(
        _fastest().alias("fastest"), F.min_by(_route(), F.struct("transfers", "duration_s", "pos")).alias("few")
    )
    picks = picks.join(requests.select("request_id", "transit_preference"), "request_id")

    def option(label: str, route: str) -> Column:
        return F.struct(F.lit(label).alias("label"), c(route).alias("route"))

    quick, few = option("route.fastest", "fastest"), option("route.fewerTransfers", "few")
    options = (
        F.when(
            c("fastest.polyline_key") == c("few.polyline_key"),
            F.array(option("route.fastestFewestTransfers", "fastest")),
        )
        .when(c("transit_preference") == "fewer_transfers", F.array(few, quick))
        .otherwise(F.array(quick, few))
    )
    return _explode(picks, options, F.lit(None).cast("string")).drop("fallback")


def diverse(itineraries: DataFrame, keep: int = 3) -> DataFrame:
    """Alternatives at most 1.5 times the fastest, distinct by coarse sampled geometry, best ``keep`` per request.

    Needs (request_id, itinerary_id, duration_s, geometry array<struct<lat, lon>>).
    """
    n = F.size("geometry")
    stride = F.greatest(F.lit(1), F.floor(n / 20).cast("int"))
    sampled = F.filter("geometry", lambda p, i: i % stride == 0)
    key = F.array_join(
        F.transform(sampled, lambda p: F.concat_ws(" ", F.rint(p["lat"] * 1e4).cast("long"), F.rint(p["lon"] * 1e4).cast("long"))),
        ",",
    )
    keyed = itineraries.select("request_id", "itinerary_id", "duration_s", F.sha2(key, 256).alias("_key"))
    best = keyed.groupBy("request_id").agg(F.min("duration_s").alias("_best"))
    near = keyed.join(best, "request_id").filter(c("duration_s") <= c("_best") * 1.5)
    unique = near.groupBy("request_id", "_key").agg(
        F.min(F.struct("duration_s", "itinerary_id")).alias("_pick")
    )
    return top_k(
        unique.select("request_id", c("_pick.itinerary_id").alias("itinerary_id"), c("_pick.duration_s").alias("duration_s")),
        ["request_id"], [c("duration_s"), c("itinerary_id")], keep,
    )


def top_k(frame: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. The rank filter becomes a group limit, which runs before the shuffle as well."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn(rank, F.row_number().over(w).cast("long")).filter(c(rank) <= k)


def rank_itineraries(alternatives: DataFrame, requests: DataFrame) -> DataFrame:
    """Provider ranking (best four), then the response ranking (best three) with detours.

    ``arrival_s`` breaks ties of the first ranking; the second is stable over the first.
    """
    wished = alternatives.join(requests.select("request_id", "transit_preference"), "request_id")
    few = c("transit_preference") == "fewer_transfers"
    first = top_k(
        wished, ["request_id"],
        [F.when(few, c("transfers").cast("double")).otherwise(c("duration_s")), c("arrival_s"), c("pos")], 4, "_first",
    )
    second = top_k(
        first, ["request_id"],
        [F.when(few, c("transfers").cast("double")).otherwise(c("duration_s")), c("duration_s"), c("_first")], 3, "position",
    )
    best = first.groupBy("request_id").agg(F.min("duration_s").alias("_best"))
    return second.join(best, "request_id").select(
        "request_id", "position", "pos", detour_percent(c("duration_s"), c("_best")).alias("detour_percent")
    )


def context_fallback(alternatives: DataFrame, requests: DataFrame) -> DataFrame:
    """Where map context is incomplete only the fastest alternative survives, with the reason; rental fallbacks are
    stamped on every itinerary."""
    joined = _with_request(alternatives, requests, "context_complete", "rental_fallback")
    kept = joined.filter(c("context_complete") | (c("pos") == c("fastest.pos")))
    reason = F.when(~c("context_complete"), "shade_data_temporarily_unavailable").when(
        c("rental_fallback"), "rental_availability_unavailable"
    )
    return kept.select("request_id", "pos", reason.alias("fallback"))
