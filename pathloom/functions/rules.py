"""Domain rules as column expressions: tags, modes, vehicles, times, limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom import constants as K
from pathloom.functions.geo import round_even


def tag_number(tag: Column) -> Column:
    """Number in a map-feature tag, unit words removed; null when it is not a number."""
    bare = F.trim(F.regexp_replace(F.lower(tag), "meters|meter|m", ""))
    return bare.try_cast("double")


def building_height(height_tag: Column, levels_tag: Column) -> tuple[Column, Column]:
    """(height in metres, confidence) from height and level tags."""
    height, levels = tag_number(height_tag), tag_number(levels_tag)
    has_height = F.coalesce(height.between(1, 300), F.lit(False))
    has_levels = F.coalesce(levels.between(1, 80), F.lit(False))
    metres = F.when(has_height, height).when(has_levels, levels * 3.2).otherwise(10.0)
    return metres, F.when(has_height, "high").when(has_levels, "medium").otherwise("low")


def _map_literal(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def maneuver_modifier(instruction: Column, code: Column) -> Column:
    """Modifier from the provider's type code, else from words of the instruction."""
    words = F.lower(F.coalesce(instruction, F.lit("")))
    by_text = reduce(
        lambda otherwise, rule: F.when(
            reduce(lambda a, b: a | b, [words.contains(k) for k in rule[0]]), rule[1]
        ).otherwise(otherwise),
        reversed(K.MANEUVER_KEYWORDS),
        F.lit("straight"),
    )
    return F.coalesce(_map_literal(K.MANEUVER_CODE)[code.cast("int")], by_text)


def provider_mode(name: Column) -> Column:
    return F.coalesce(_map_literal(K.PROVIDER_MODE)[F.upper(name)], F.lit("transit"))


def effective_vehicle(mode: Column, kind: Column, bike_default: str = "folding_bike") -> Column:
    """Vehicle kind a request travels with. The live default for bike+transit folds, the compact one does not."""
    return (
        F.when(kind != "none", kind)
        .when(mode == "bike_transit", bike_default)
        .when(mode == "scooter_transit", "personal_scooter")
        .otherwise("none")
    )


def can_fold(flag: Column, kind: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | kind.isin(*K.FOLDABLE_KINDS)


def detour_percent(value: Column, baseline: Column) -> Column:
    return F.when(baseline <= 0, 0.0).otherwise(
        round_even(F.greatest(F.lit(0.0), (value / baseline - 1) * 100), 2)
    )


def route_id(version: Column, mode: Column, label: Column, polyline: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", version, mode, label, polyline), 256), 1, 20)


def local_to_instant(wall: Column) -> Column:
    """A naive local time as an instant."""
    return F.to_utc_timestamp(wall, K.LOCAL_ZONE)


def parse_instant(text: Column) -> Column:
    """ISO-8601 text with or without offset (no offset means UTC); null when unparseable."""
    return F.try_to_timestamp(text)


def epoch_or(text: Column, fallback: Column) -> Column:
    """Whole epoch seconds given as text or number, else the fallback."""
    seconds = F.trim(text.cast("string")).try_cast("double")
    return F.coalesce(F.timestamp_seconds(seconds.cast("long")), fallback)


def battery_percent(token: Column) -> Column:
    """Battery from its raw JSON token: a *float* up to 1 is a fraction, anything else is a percentage."""
    value = token.try_cast("double")
    is_float = token.rlike("[.eE]")
    return F.when(is_float & (value <= 1), F.rint(value * 100)).otherwise(value).cast("int")


def instruction_key(modifier: Column, leg_index: Column, position: Column) -> Column:
    return (
        F.when(modifier == "arrive", "navigation.arrive")
        .when((leg_index == 0) & (position == 0), "navigation.depart")
        .otherwise("navigation.turn")
    )


def handoff_key(mode: Column) -> tuple[Column, Column]:
    """(instruction key, modifier) of a synthetic maneuver for a leg that has none."""
    board = mode == "transit"
    return (
        F.when(board, "navigation.board").otherwise("navigation.depart"),
        F.when(board, "board").otherwise("depart"),
    )


def service_name(route_name: Column, headsign: Column, to_name: Column) -> Column:
    label = F.concat_ws(" ", F.when(route_name != "", route_name), F.when(headsign != "", headsign))
    return F.when(label != "", label).otherwise(to_name)


# -- predicates -------------------------------------------------------------------------------------------------
def inside_box(lat: Column, lon: Column, box: tuple[float, float, float, float] = K.COVERAGE_BBOX) -> Column:
    west, south, east, north = box
    return lat.between(south, north) & lon.between(west, east)


def in_categories(category: Column, wanted: Column) -> Column:
    """Membership in a comma list; a blank or missing list admits everything."""
    listed = F.transform(F.split(wanted, ","), lambda p: F.trim(p))
    return (F.coalesce(wanted, F.lit("")) == "") | F.array_contains(listed, category)


def dimension_allowed(vehicle: Column, limit: Column) -> Column:
    """A dimension fits when either side is missing or zero."""
    return ~((F.coalesce(limit, F.lit(0.0)) != 0) & (F.coalesce(vehicle, F.lit(0.0)) > F.coalesce(limit, F.lit(0.0))))


def crossing_allowed(kind: Column, confidence: Column, allow_low: Column) -> Column:
    risky = (F.coalesce(kind, F.lit("")) != "") & (F.coalesce(confidence, F.lit("unknown")) == "low")
    return ~risky | allow_low


def next_side(mode: Column, side: Column, crossing_kind: Column, edge_side: Column) -> Column:
    """Side of the street after an edge; null when the edge may not be entered from this side."""
    bound = F.when(edge_side.isin("left", "right"), edge_side)
    return (
        F.when(mode != "walk", "center")
        .when(F.coalesce(crossing_kind, F.lit("")) != "", "center")
        .when(bound.isNull(), side)
        .when(side.isin("left", "right") & (side != bound), F.lit(None).cast("string"))
        .otherwise(bound)
    )


def on_time(arrive_by: Column, departure: Column, arrival: Column, requested: Column) -> Column:
    """Arrive-by results may be 60 s late, depart results 60 s early (all epoch seconds)."""
    return F.when(arrive_by, arrival <= requested + 60).otherwise(departure >= requested - 60)


def next_departure(after_s: Column, first_s: Column, headway_s: Column) -> Column:
    """Seconds of day of the next run of a frequency trip at or after a time of day; null after the last run."""
    runs = F.floor((after_s - first_s + headway_s - 1) / headway_s)
    start = first_s + runs * headway_s
    return F.when(after_s <= first_s, first_s.cast("double")).when(start <= K.LAST_DEPARTURE_S, start.cast("double"))
