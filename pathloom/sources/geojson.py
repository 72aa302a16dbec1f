"""Place features of GeoJSON search responses, and GeoJSON feature sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom import constants as K
from pathloom.functions import rules, text
from pathloom.operators.scan import keep_first

c = F.col

_TEXT_KEYS = (
    "type", "osm_type", "osm_id", "name", "street", "city", "town", "village", "district", "locality", "county", "housenumber",
)
SCHEMA = (
    "features array<struct<properties:struct<" + ",".join(f"{k}:string" for k in _TEXT_KEYS)
    + ">,geometry:struct<coordinates:array<string>>>>"
)


def place_features(
    payloads: DataFrame, key: str, payload: str = "payload", categories: str | None = None,
    box: tuple[float, float, float, float] = K.COVERAGE_BBOX,
) -> DataFrame:
    """Normalised places of each response, the first feature per identifier."""
    parsed = payloads.select(key, F.from_json(payload, SCHEMA).alias("_p"))
    features = parsed.select(key, F.posexplode("_p.features").alias("position", "_f"))
    p = {k: text.blank_to_null(c(f"_f.properties.{k}")) for k in _TEXT_KEYS}
    spots = c("_f.geometry.coordinates")
    lat, lon = F.get(spots, F.lit(1)).try_cast("double"), F.get(spots, F.lit(0)).try_cast("double")
    rows = features.select(
        key, "position", lat.alias("lat"), lon.alias("lon"), F.coalesce(p["type"], F.lit("place")).alias("category"),
        F.coalesce(p["osm_type"], F.lit("osm")).alias("_type"), p["osm_id"].alias("_id"),
        F.coalesce(p["name"], p["street"], p["city"], p["district"]).alias("_name"), p["housenumber"].alias("_house"),
        F.coalesce(p["street"], p["locality"], p["county"]).alias("_street"),
        F.coalesce(p["city"], p["town"], p["village"], p["district"]).alias("_city"),
    )
    valid = rows.filter(F.coalesce(rules.inside_box(c("lat"), c("lon"), box), F.lit(False)))
    if categories:
        valid = valid.filter(rules.in_categories(c("category"), F.lit(categories)))
    identifier = F.concat_ws(":", F.lit("osm"), c("_type"), F.coalesce(c("_id"), F.format_string("%.6f", c("lat"))))
    first = keep_first(valid.withColumn("place_id", identifier), [key, "place_id"], ["position"])
    named = first.withColumn("name", text.display_name(c("_name"), c("_house"))).filter(c("name") != "")

    def other(part: str) -> Column:
        return F.when(c(part) != c("name"), c(part))

    subtitle = F.concat_ws(text.SEPARATOR, other("_street"), other("_city"))
    return named.select(
        key, "place_id", "name", F.when(text.contains_hebrew(c("name")), c("name")).alias("name_he"),
        F.when(subtitle != "", subtitle).alias("subtitle"), "lat", "lon", "category", F.lit("high").alias("confidence"),
    )


def _feature(properties: Column, kind: str, coordinates: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"), properties.alias("properties"),
            F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        )
    )


def line_features(slices: DataFrame) -> DataFrame:
    """A LineString per annotation slice of at least two points (``points`` array of (lon, lat))."""
    pairs = F.transform("points", lambda p: F.array(p["lon"], p["lat"]))
    lines = slices.filter(F.size("points") >= 2)
    return lines.withColumn("feature", _feature(F.struct("classification"), "LineString", pairs))


def crossing_features(crossings: DataFrame) -> DataFrame:
    """A Point per mapped crossing."""
    known = crossings.filter(F.coalesce(c("crossing_kind"), F.lit("")) != "")
    spot = F.array("lon", "lat")
    return known.withColumn("feature", _feature(F.struct(c("crossing_kind").alias("crossing")), "Point", spot))


def vehicle_features(vehicles: DataFrame) -> DataFrame:
    properties = F.struct(c("vehicle_id").alias("vehicleId"), "provider", "kind", c("battery_percent").alias("battery"))
    return vehicles.withColumn("feature", _feature(properties, "Point", F.array("lon", "lat")))


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited features."""
    features.select("feature").write.mode("overwrite").text(path)
