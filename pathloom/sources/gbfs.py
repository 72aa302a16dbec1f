"""Shared-vehicle feeds: discovery, vehicle types and status documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import rules

c = F.col

_FEEDS = "array<struct<name:string,url:string>>"
_VEHICLE = (
    "struct<bike_id:string,vehicle_id:string,vehicle_type_id:string,lat:string,lon:string,is_reserved:string,is_disabled:string,"
    "current_fuel_percent:string,rental_uris:struct<android:string>>"
)
STATUS = f"last_updated string, data struct<bikes:array<{_VEHICLE}>,vehicles:array<{_VEHICLE}>>"
TYPES = "data struct<vehicle_types:array<struct<vehicle_type_id:string,form_factor:string>>>"


def feed_url(discovery: Column, name: str) -> Column:
    """URL of a named feed in a discovery document, flat or below its first language."""
    flat = F.from_json(F.get_json_object(discovery, "$.data.feeds"), _FEEDS)
    languages = F.map_values(F.from_json(F.get_json_object(discovery, "$.data"), f"map<string,struct<feeds:{_FEEDS}>>"))
    feeds = F.coalesce(flat, F.get(languages, F.lit(0))["feeds"])
    return F.get(F.filter(feeds, lambda f: f["name"] == name), F.lit(0))["url"]


def status_url(discovery: Column) -> Column:
    return F.coalesce(feed_url(discovery, "free_bike_status"), feed_url(discovery, "vehicle_status"))


def vehicle_types(documents: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, vehicle_type_id, kind), the last entry of a type winning."""
    items = documents.select(key, F.posexplode(F.from_json(payload, TYPES)["data"]["vehicle_types"]).alias("_at", "_t"))
    kind = F.when(F.lower("_t.form_factor").contains("scooter"), "shared_scooter").otherwise("shared_bike")
    return items.groupBy(key, c("_t.vehicle_type_id").alias("vehicle_type_id")).agg(F.max_by(kind, "_at").alias("kind"))


def with_kind(vehicles: DataFrame, types: DataFrame, keys: list[str]) -> DataFrame:
    """Kind by vehicle type, else by the name of the type."""
    named = F.when(F.lower("vehicle_type_id").contains("scooter"), "shared_scooter").otherwise("shared_bike")
    joined = vehicles.join(types, [*keys, "vehicle_type_id"], "left")
    return joined.withColumn("kind", F.coalesce("kind", named))


def _truthy(token: Column) -> Column:
    return F.coalesce(~F.lower(token).isin("false", "0", "", "null"), F.lit(False))


def parse_status(documents: DataFrame, key: str, payload: str, types: DataFrame, as_of: Column, stale_s: int = 120) -> DataFrame:
    """Usable vehicles of status documents; reserved and disabled ones are left out. ``as_of``, when the documents were
    read, may be one of their columns."""
    parsed = documents.select(key, as_of.alias("_as_of"), F.from_json(payload, STATUS).alias("_s"))
    items = F.when(F.size("_s.data.bikes") > 0, c("_s.data.bikes")).otherwise(c("_s.data.vehicles"))
    observed = rules.epoch_or(c("_s.last_updated"), c("_as_of"))
    rows = parsed.select(key, "_as_of", observed.alias("observed_at"), F.explode(items).alias("_v"))
    usable = rows.filter(~_truthy(c("_v.is_reserved")) & ~_truthy(c("_v.is_disabled")))
    flat = usable.select(
        key, "_as_of", "observed_at", F.coalesce("_v.bike_id", "_v.vehicle_id").alias("vehicle_id"),
        F.coalesce("_v.vehicle_type_id", F.lit("")).alias("vehicle_type_id"),
        c("_v.lat").cast("double").alias("lat"), c("_v.lon").cast("double").alias("lon"),
        rules.battery_percent(c("_v.current_fuel_percent")).alias("battery_percent"), c("_v.rental_uris.android").alias("deep_link"),
    )
    stale = F.unix_micros("_as_of") - F.unix_micros("observed_at") > stale_s * 1_000_000
    return with_kind(flat, types, [key]).withColumns({"stale": stale, "available": F.lit(True)}).drop("_as_of")


def union_feeds(feeds: DataFrame, vehicles: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(vehicles of the feeds that answered, one warning per feed that failed)."""
    fine = vehicles.join(feeds.filter("ok").select(key), key, "left_semi")
    message = F.concat(c(key).cast("string"), F.lit(" availability is temporarily unavailable."))
    return fine, feeds.filter(~c("ok")).select(key, message.alias("warning"))
