"""Provider-normalisation queries (S5-S12, S15, J8, J9, U3). Documents are put together from the tables' rows, so the
SQL side can read the rows themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.plans import mapping as M
from pathloom.plans.registry import Tables, query
from pathloom.session import ensure_checkpoint_dir
from pathloom.sources import gbfs, geojson, itineraries, osm

c = F.col


def documents(rows: DataFrame, key: str, order: str, item: Column, name: str) -> DataFrame:
    """One JSON document per key holding its items in order."""
    ordered = F.array_sort(F.collect_list(F.struct(c(order).alias("_o"), F.to_json(item).alias("_i"))))
    items = F.array_join(F.transform(ordered, lambda s: s["_i"]), ",")
    return rows.groupBy(key).agg(F.concat(F.lit(f'{{"{name}":['), items, F.lit("]}")).alias("payload"))


_FEATURES = f"""SELECT CAST(floor(place_id / 2e1) AS BIGINT) AS response, place_id, CAST(floor(place_id / 2e0) AS BIGINT) AS osm_id, lat - 0.03 AS lat, lon,
  CASE WHEN place_id % 7 = 0 THEN '' WHEN place_id % 5 = 0 THEN concat('כיכר ', name) ELSE name END AS name, CASE WHEN place_id % 3 = 0 THEN concat(category, ' street') END AS street,
  CASE WHEN place_id % 4 = 1 THEN 'Tel Aviv' END AS city, CASE WHEN place_id % 6 = 0 THEN CAST(place_id % 90 AS VARCHAR(20)) END AS house_number, lower(category) AS category,
  place_id % 11 = 0 AS broken FROM ({M.PLACES}) p"""


@query(
    "S5",
    f"""SELECT response, 'osm:N:' || osm_id AS place_id, display AS name, coalesce(CASE WHEN contains(display, 'כיכר') THEN display END, '-') AS name_he,
          coalesce(nullif(concat_ws(' · ', CASE WHEN street <> display THEN street END, CASE WHEN city <> display THEN city END), ''), '-') AS subtitle, round(lat, 5) AS lat, category FROM (
          SELECT *, concat_ws(' ', coalesce(nullif(trim(name), ''), street, city), house_number) AS display, row_number() OVER (PARTITION BY response, osm_id ORDER BY place_id) AS rn
          FROM ({_FEATURES}) f WHERE NOT broken AND lat BETWEEN 31.94 AND 32.20 AND lon BETWEEN 34.69 AND 34.93 AND category IN ('building', 'machinery', 'household')) x WHERE rn = 1 AND display <> ''""",
)
def s5(t: Tables) -> DataFrame:
    properties = F.struct(
        c("category").alias("type"), F.lit("N").alias("osm_type"), c("osm_id"), "name", "street", "city",
        c("house_number").alias("housenumber"),
    )
    spot = F.when(c("broken"), F.array(F.lit("east"), F.lit("north"))).otherwise(
        F.array(c("lon").cast("string"), c("lat").cast("string"))
    )
    item = F.struct(properties.alias("properties"), F.struct(spot.alias("coordinates")).alias("geometry"))
    payloads = documents(t.sql(_FEATURES), "response", "place_id", item, "features")
    places = geojson.place_features(payloads, "response", categories="building, machinery,household")
    return places.select(
        "response", "place_id", "name", F.coalesce("name_he", F.lit("-")).alias("name_he"),
        F.coalesce("subtitle", F.lit("-")).alias("subtitle"), F.round("lat", 5).alias("lat"), "category",
    )


_ELEMENTS = f"""SELECT CAST(floor(osm_id / 2e1) AS BIGINT) AS response, osm_id, lat0, lon0, half_deg, height_tag, levels_tag, CAST(osm_id % 4 + 2 AS BIGINT) AS n_points, osm_id % 3 = 0 AS is_signal FROM ({M.BUILDINGS}) b"""


@query(
    "S6",
    f"""SELECT response, osm_id % 20 AS position, 'signal' AS kind, CAST(0 AS BIGINT) AS points, 0.0::DOUBLE AS height_m FROM ({_ELEMENTS}) e WHERE is_signal
        UNION ALL SELECT response, osm_id % 20, 'building', n_points, round(CASE WHEN h BETWEEN 1 AND 300 THEN h WHEN l BETWEEN 1 AND 80 THEN l * 3.2 ELSE 10.0 END, 4) FROM (
          SELECT *, TRY_CAST(replace(height_tag, ' m', '') AS DOUBLE) AS h, TRY_CAST(levels_tag AS DOUBLE) AS l FROM ({_ELEMENTS}) e2 WHERE NOT is_signal AND n_points >= 4) x""",
)
def s6(t: Tables) -> DataFrame:
    tags = F.when(c("is_signal"), F.create_map(F.lit("highway"), F.lit("traffic_signals"))).otherwise(
        F.map_filter(
            F.create_map(F.lit("building"), F.lit("yes"), F.lit("height"), c("height_tag"), F.lit("building:levels"), c("levels_tag")),
            lambda _, v: v.isNotNull(),
        )
    )
    # one unreadable point per outline on top of the good ones
    point = F.struct(c("lat0").cast("string").alias("lat"), c("lon0").cast("string").alias("lon"))
    bad = F.struct(F.lit("n/a").alias("lat"), F.lit("0").alias("lon"))
    ring = F.concat(F.array_repeat(point, c("n_points").cast("int")), F.array(bad))
    item = F.struct(
        c("osm_id").alias("id"), F.when(c("is_signal"), c("lat0")).alias("lat"), F.when(c("is_signal"), c("lon0")).alias("lon"),
        tags.alias("tags"), F.when(~c("is_signal"), ring).alias("geometry"),
    )
    payloads = documents(t.sql(_ELEMENTS), "response", "osm_id", item, "elements")
    signals = osm.response_signals(payloads, "response").select(
        "response", c("position").cast("long").alias("position"), F.lit("signal").alias("kind"), F.lit(0).cast("long").alias("points"),
        F.lit(0.0).alias("height_m"),
    )
    built = osm.response_buildings(payloads, "response").select(
        "response", c("position").cast("long").alias("position"), F.lit("building").alias("kind"), F.size("ring").cast("long").alias("points"),
        F.round("height_m", 4).alias("height_m"),
    )
    return signals.unionByName(built)


_VEHICLE_ROWS = f"""SELECT vehicle_id AS feed, event_id, lat, lon, is_reserved, is_disabled, 1704067200 + vehicle_id AS updated_s,
  CASE CAST(event_id % 3 AS INTEGER) WHEN 0 THEN 't1' WHEN 1 THEN 't2' ELSE 'kick_Scooter' END AS vehicle_type_id, event_id % 100 AS battery FROM ({M.VEHICLES}) v"""


@query(
    "S7",
    f"""SELECT feed, event_id AS vehicle_id, CASE WHEN vehicle_type_id = 't1' THEN 'shared_bike' ELSE 'shared_scooter' END AS kind, round(lat, 5) AS lat,
          CAST(CASE WHEN event_id % 2 = 0 THEN battery ELSE battery / 2 END AS INTEGER) AS battery, feed % 2 = 0 AS stale,
          CASE WHEN feed % 2 = 0 THEN 'https://feeds/free' ELSE 'https://feeds/status' END AS url FROM (SELECT * REPLACE (CAST(floor(battery / 2e0) * 2 AS BIGINT) AS battery) FROM ({_VEHICLE_ROWS}) r) x WHERE NOT (is_reserved OR is_disabled)""",
)
def s7(t: Tables) -> DataFrame:
    rows = t.sql(_VEHICLE_ROWS).withColumn("battery", (F.floor(c("battery") / 2) * 2).cast("long"))
    # whole percentages on even vehicles, fractions with a decimal point on odd ones (half as large)
    token = F.when(c("event_id") % 2 == 0, c("battery").cast("string")).otherwise(
        F.concat(F.lit("0."), F.lpad((c("battery") / 2).cast("long").cast("string"), 2, "0"))
    )
    item = F.concat(
        F.lit('{"bike_id":"'), c("event_id").cast("string"), F.lit('","vehicle_type_id":"'), c("vehicle_type_id"),
        F.lit('","lat":'), c("lat").cast("string"), F.lit(',"lon":'), c("lon").cast("string"), F.lit(',"is_reserved":'),
        c("is_reserved").cast("string"), F.lit(',"is_disabled":'), c("is_disabled").cast("string"), F.lit(',"current_fuel_percent":'),
        token, F.lit("}"),
    )
    listed = rows.groupBy("feed", "updated_s").agg(F.array_join(F.collect_list(item), ",").alias("_items"))
    # every other feed uses the newer name of the list
    name = F.when(c("feed") % 2 == 0, "bikes").otherwise("vehicles")
    status = listed.select(
        "feed",
        F.concat(
            F.lit('{"last_updated":'), (c("updated_s") + F.when(c("feed") % 2 == 0, 0).otherwise(600)).cast("string"), F.lit(',"data":{"'), name,
            F.lit('":['), c("_items"), F.lit("]}}"),
        ).alias("payload"),
        F.when(
            c("feed") % 2 == 0,
            '{"data":{"feeds":[{"name":"vehicle_types","url":"https://feeds/types"},{"name":"free_bike_status","url":"https://feeds/free"}]}}',
        ).otherwise('{"data":{"en":{"feeds":[{"name":"vehicle_status","url":"https://feeds/status"}]}}}').alias("discovery"),
        F.lit('{"data":{"vehicle_types":[{"vehicle_type_id":"t1","form_factor":"bicycle"},{"vehicle_type_id":"t2","form_factor":"Scooter_standing"}]}}').alias("types"),
        F.timestamp_seconds(c("updated_s") + 500).alias("as_of"),
    )
    types = gbfs.vehicle_types(status, "feed", "types")
    parsed = gbfs.parse_status(status, "feed", "payload", types, c("as_of"))
    urls = status.select("feed", gbfs.status_url(c("discovery")).alias("url"))
    return parsed.join(urls, "feed").select(
        "feed", c("vehicle_id").cast("long").alias("vehicle_id"), "kind", F.round("lat", 5).alias("lat"), c("battery_percent").alias("battery"),
        "stale", "url",
    )


@query(
    "J9",
    f"""SELECT event_id, CASE WHEN vehicle_type_id = 't1' THEN 'shared_bike' WHEN vehicle_type_id = 't2' THEN 'shared_bike' ELSE 'shared_scooter' END AS kind FROM ({_VEHICLE_ROWS}) r""",
)
def j9(t: Tables) -> DataFrame:
    rows = t.sql(_VEHICLE_ROWS)
    types = rows.select("feed").distinct().select("feed", F.lit("t1").alias("vehicle_type_id"), F.lit("shared_bike").alias("kind"))
    return gbfs.with_kind(rows, types, ["feed"]).select("event_id", "kind")


@query(
    "U3",
    f"""SELECT provider, count(*) AS vehicles, '' AS warning FROM ({M.VEHICLES}) v WHERE provider <> 1 GROUP BY provider
        UNION ALL SELECT DISTINCT provider, 0, provider || ' availability is temporarily unavailable.' FROM ({M.VEHICLES}) v2 WHERE provider = 1""",
)
def u3(t: Tables) -> DataFrame:
    vehicles = t.sql(M.VEHICLES)
    feeds = vehicles.select("provider").distinct().withColumn("ok", c("provider") != 1)
    fine, warnings = gbfs.union_feeds(feeds, vehicles, "provider")
    counted = fine.groupBy("provider").agg(F.count("*").alias("vehicles")).withColumn("warning", F.lit(""))
    return counted.unionByName(warnings.withColumn("vehicles", F.lit(0).cast("long")))


# -- itineraries: an order is a request, its line items the legs ------------------------------------------------
# a well-known three-vertex polyline; with six decimals its vertices are a tenth of the usual ones
SHAPE = "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
_SHAPE_M = f"({M.haversine('3.85', '-12.02', '4.07', '-12.095')} + {M.haversine('4.07', '-12.095', '4.3252', '-12.6453')})"
_ITEMS = f"""SELECT itinerary_id AS request_id, leg_index % 2 AS itinerary, CAST(floor(leg_index / 2e0) AS BIGINT) AS leg_index, mode, distance_m, duration_s, route_name, headsign, to_name,
  bike_rule, maneuver_code, itinerary_id % 2 = 0 AS arrive_by, 1704096000 + itinerary_id * 60 AS requested_s FROM ({M.ITINERARY_LEGS}) g"""


def _grouped(t: Tables, leg: Column) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("leg_index", leg.alias("_leg"))))
    legs = F.transform(ordered, lambda s: s["_leg"]).alias("legs")
    keys = ["request_id", "itinerary", "arrive_by", "requested_s"]
    return t.sql(_ITEMS, lineitem="l_orderkey").groupBy(*keys).agg(legs, F.sum("duration_s").alias("total_s"))


@query(
    "S8",
    f"""SELECT request_id, itinerary, count(*) AS legs, sum(distance_m) AS distance_m, sum(duration_s) AS duration_s,
          CASE WHEN arrive_by THEN requested_s - sum(duration_s) ELSE requested_s END AS departure_s,
          count(*) FILTER (maneuver_code IN (4, 5, 6)) AS arrivals FROM ({_ITEMS}) i GROUP BY request_id, itinerary, arrive_by, requested_s""",
)
def s8(t: Tables) -> DataFrame:
    turn = F.struct(
        F.lit("Go").alias("instruction"), F.lit(0).alias("begin_shape_index"), (c("distance_m") / 1000).alias("length"),
        c("duration_s").alias("time"), c("maneuver_code").alias("type"), F.array(F.lit("Main")).alias("street_names"),
    )
    leg = F.struct(
        F.lit(SHAPE).alias("shape"), F.struct((c("distance_m") / 1000).alias("length"), c("duration_s").alias("time")).alias("summary"),
        F.array(turn).alias("maneuvers"),
    )
    trips = _grouped(t, leg).groupBy("request_id", "arrive_by", "requested_s").agg(
        F.max(F.when(c("itinerary") == 0, F.struct("legs"))).alias("trip"),
        F.collect_list(F.when(c("itinerary") == 1, F.struct(F.struct("legs").alias("trip")))).alias("alternates"),
    )
    payloads = trips.select(
        "request_id", F.lit("walk").alias("mode"), "arrive_by", "requested_s", F.to_json(F.struct("trip", "alternates")).alias("payload")
    )
    legs = itineraries.street_legs(payloads, "request_id")
    turns = itineraries.street_maneuvers(legs, "request_id").groupBy("request_id", "itinerary").agg(
        F.count_if(c("modifier") == "arrive").alias("arrivals")
    )
    return itineraries.street_itineraries(legs, "request_id").join(turns, ["request_id", "itinerary"]).select(
        "request_id", c("itinerary").cast("long").alias("itinerary"), "legs", F.round("distance_m", 3).alias("distance_m"), "duration_s",
        "departure_s", "arrivals",
    )


_OFFSET = "(request_id * 7 + itinerary * 3) % 5 * 60 - 120"


@query(
    "S9",
    f"""WITH l AS (SELECT *, leg_index % 5 <> 4 AS shaped, CASE mode WHEN 'scooter' THEN 'transit' ELSE mode END AS m FROM ({_ITEMS}) i),
        s AS (SELECT request_id, itinerary, arrive_by, requested_s, count(*) FILTER (shaped) AS legs, count(*) FILTER (shaped AND m = 'transit') AS transit_legs,
                sum(CASE WHEN NOT shaped THEN NULL WHEN leg_index % 3 = 2 THEN {_SHAPE_M} ELSE distance_m END) AS distance_m,
                bool_or(m = 'transit' AND request_id % 3 = 1 AND bike_rule <> 1) AS denied,
                CASE WHEN arrive_by THEN requested_s + {_OFFSET} - 1800 ELSE requested_s + {_OFFSET} END AS departure_s, sum(duration_s) AS d FROM l GROUP BY 1, 2, 3, 4),
        k AS (SELECT *, CASE WHEN arrive_by THEN departure_s + 1800 ELSE departure_s + CAST(d AS BIGINT) END AS arrival_s FROM s)
        SELECT request_id, itinerary, legs, transit_legs, round(distance_m, 3) AS distance_m, departure_s, arrival_s FROM k
        WHERE NOT denied AND legs > 0 AND CASE WHEN arrive_by THEN arrival_s <= requested_s + 60 ELSE departure_s >= requested_s - 60 END""",
)
def s9(t: Tables) -> DataFrame:
    shaped = c("leg_index") % 5 != 4
    leg = F.struct(
        F.when(c("mode") == "scooter", "TRAM").when(c("mode") == "transit", "BUS").otherwise(F.upper("mode")).alias("mode"),
        F.when(c("bike_rule") < 2, c("bike_rule") == 1).alias("bikesAllowed"),
        F.when(c("leg_index") % 3 != 2, c("distance_m")).alias("distance"), c("duration_s").alias("duration"),
        F.struct(c("to_name").alias("name")).alias("to"), F.struct(F.when(shaped, SHAPE).alias("points")).alias("legGeometry"),
        c("route_name").alias("routeShortName"), "headsign",
    )
    offset = (c("request_id") * 7 + c("itinerary") * 3) % 5 * 60 - 120
    start = c("requested_s") + offset - F.when(c("arrive_by"), 1800).otherwise(0)
    end = start + F.when(c("arrive_by"), 1800).otherwise(c("total_s").cast("long"))
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    trips = _grouped(t, leg).withColumns(
        {"startTime": F.date_format(F.timestamp_seconds(start), iso), "endTime": F.date_format(F.timestamp_seconds(end), iso)}
    )
    ordered = F.array_sort(F.collect_list(F.struct("itinerary", F.struct("startTime", "endTime", "legs").alias("_i"))))
    payloads = trips.groupBy("request_id", "arrive_by", "requested_s").agg(
        F.to_json(F.struct(F.transform(ordered, lambda s: s["_i"]).alias("itineraries"))).alias("payload")
    )
    full = c("request_id") % 3 == 1
    asked = payloads.withColumns(
        {
            "mode": F.lit("bike_transit"), "kind": F.when(full, "full_size_bike").otherwise("none"), "can_fold": F.lit(False),
            "preference": F.when(c("request_id") % 4 == 0, "fewer_transfers").otherwise("fastest"),
        }
    )
    found = itineraries.transit_itineraries(itineraries.transit_legs(asked, "request_id"), "request_id")
    return found.select(
        "request_id", c("itinerary").cast("long").alias("itinerary"), "legs", "transit_legs", F.round("distance_m", 3).alias("distance_m"),
        "departure_s", "arrival_s",
    )


@query(
    "S10",
    f"""SELECT request_id, itinerary, count(*) AS legs, sum(distance_m) AS distance_m, requested_s * 1000000 + 250000 AS departure_us FROM ({_ITEMS}) i
        GROUP BY request_id, itinerary, requested_s HAVING NOT bool_or(mode IN ('transit') AND request_id % 3 = 1 AND bike_rule <> 1)""",
)
def s10(t: Tables) -> DataFrame:
    rule = F.when(c("bike_rule") == 0, "UNKNOWN").when(c("bike_rule") == 1, "ALLOWED")
    leg = F.struct(
        F.when(c("mode") == "transit", "RAIL").otherwise(F.upper("mode")).alias("mode"), rule.alias("bikesAllowed"),
        c("distance_m").alias("distance"), c("duration_s").alias("duration"), F.struct(F.lit(SHAPE).alias("points")).alias("legGeometry"),
    )
    start = (c("requested_s") * 1000 + 250).alias("startTime")
    trips = _grouped(t, leg).withColumns({"startTime": start, "endTime": start + (c("total_s") * 1000).cast("long")})
    ordered = F.array_sort(F.collect_list(F.struct("itinerary", F.struct("startTime", "endTime", "legs").alias("_i"))))
    payloads = trips.groupBy("request_id").agg(
        F.to_json(F.struct(F.struct(F.transform(ordered, lambda s: s["_i"]).alias("itineraries")).alias("plan"))).alias("payload")
    )
    asked = payloads.withColumn("kind", F.when(c("request_id") % 3 == 1, "full_size_bike").otherwise("folding_bike"))
    found = itineraries.planner_itineraries(itineraries.planner_legs(asked, "request_id"), "request_id")
    return found.select(
        "request_id", c("itinerary").cast("long").alias("itinerary"), "legs", "distance_m", F.unix_micros("departure_at").alias("departure_us")
    )


# -- map extracts -----------------------------------------------------------------------------------------------
def osm_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Node and way tables: four corner nodes per part; some ways are open, some refer to a node nobody has."""
    base = t.sql(M.BUILDINGS)
    corners = [(-1, -1), (-1, 1), (1, 1), (1, -1)]
    spots = F.array(
        *[
            F.struct((c("osm_id") * 4 + i).alias("node_id"), (c("lat0") + dy * c("half_deg")).alias("lat"), (c("lon0") + dx * c("half_deg")).alias("lon"))
            for i, (dy, dx) in enumerate(corners)
        ]
    )
    tags = F.when(c("osm_id") % 6 == 0, F.create_map(F.lit("highway"), F.lit("traffic_signals"))).otherwise(F.create_map().cast("map<string,string>"))
    nodes = base.select(tags.alias("tags"), F.inline(spots))
    first = c("osm_id") * 4
    last = F.when(c("osm_id") % 10 == 0, first + 1).when(c("osm_id") % 13 == 0, F.lit(-1)).otherwise(first)
    ways = base.select(
        c("osm_id").alias("way_id"), F.array(first, first + 1, first + 2, first + 3, last).alias("node_refs"),
        F.map_filter(
            F.create_map(F.lit("building"), F.lit("yes"), F.lit("height"), c("height_tag"), F.lit("building:levels"), c("levels_tag")),
            lambda _, v: v.isNotNull(),
        ).alias("tags"),
    )
    return nodes, ways


_EXTRACT_BOX = (34.75, 32.05, 34.765, 32.065)


_FEATURES_SQL = f"""SELECT osm_id, round(lat0 - half_deg, 6) AS min_lat, round(lon0 + half_deg, 6) AS max_lon, round(CASE WHEN h BETWEEN 1 AND 300 THEN h WHEN l BETWEEN 1 AND 80 THEN l * 3.2 ELSE 10.0 END, 4) AS height_m
        FROM (SELECT *, TRY_CAST(replace(height_tag, ' m', '') AS DOUBLE) AS h, TRY_CAST(levels_tag AS DOUBLE) AS l FROM ({M.BUILDINGS}) b) x
        WHERE osm_id % 10 <> 0 AND osm_id % 13 <> 0 AND lon0 + half_deg >= 34.75 AND lon0 - half_deg <= 34.765 AND lat0 + half_deg >= 32.05 AND lat0 - half_deg <= 32.065
        UNION ALL SELECT osm_id * 4 + k, round(lat0 + dy * half_deg, 6), round(lon0 + dx * half_deg, 6), 0.0 FROM ({M.BUILDINGS}) b CROSS JOIN (VALUES (0, -1, -1), (1, -1, 1), (2, 1, 1), (3, 1, -1)) AS v(k, dy, dx)
        WHERE osm_id % 6 = 0 AND lat0 + dy * half_deg BETWEEN 32.05 AND 32.065 AND lon0 + dx * half_deg BETWEEN 34.75 AND 34.765"""


@query("S11", _FEATURES_SQL)
def s11(t: Tables) -> DataFrame:
    nodes, ways = osm_tables(t)
    return _features(osm.extract_buildings(ways, nodes, _EXTRACT_BOX), osm.extract_signals(nodes, _EXTRACT_BOX))


def _features(buildings: DataFrame, signals: DataFrame) -> DataFrame:
    built = buildings.select(
        "osm_id", F.round("min_lat", 6).alias("min_lat"), F.round("max_lon", 6).alias("max_lon"), F.round("height_m", 4).alias("height_m")
    )
    signals = signals.select(
        "osm_id", F.round("lat", 6).alias("min_lat"), F.round("lon", 6).alias("max_lon"), F.lit(0.0).alias("height_m")
    )
    return built.unionByName(signals)


@query(
    "J8",
    f"""SELECT osm_id AS way_id, CAST(round(lon0 * 1e6 - half_deg * 1e6) AS BIGINT) AS first_lon, 5::INTEGER AS vertices FROM ({M.BUILDINGS}) b WHERE NOT (osm_id % 13 = 0 AND osm_id % 10 <> 0)""",
)
def j8(t: Tables) -> DataFrame:
    nodes, ways = osm_tables(t)
    rings = osm.locate_ways(ways, nodes)
    return rings.select(
        "way_id", F.round(F.element_at("ring", 1)["lon"] * 1e6).cast("long").alias("first_lon"), F.size("ring").alias("vertices")
    )


@query("S12", _FEATURES_SQL)
def s12(t: Tables) -> DataFrame:
    """The store is written with all features, and those of a box are read back from the files that touch it."""
    nodes, ways = osm_tables(t)
    path = f"{ensure_checkpoint_dir(t.spark)}/store-{uuid.uuid4().hex}"
    osm.write_store(osm.extract_buildings(ways, nodes), osm.extract_signals(nodes), path, "tables")
    west, south, east, north = _EXTRACT_BOX
    return _features(*(osm.read_store(t.spark, path, table, south, west, north, east) for table in ("buildings", "signals")))


@query(
    "S15",
    f"""SELECT place_id, name, CASE WHEN place_id % 5 = 0 THEN 'כיכר ' || name ELSE '-' END AS name_he, lower(category) AS category FROM ({M.PLACES}) p""",
)
def s15(t: Tables) -> DataFrame:
    """Bilingual place reference table, written once and read back."""
    places = t.sql(M.PLACES).select(
        "place_id", "name", F.when(c("place_id") % 5 == 0, F.concat(F.lit("כיכר "), c("name"))).otherwise("-").alias("name_he"),
        F.lower("category").alias("category"), "lat", "lon", F.lit("high").alias("confidence"),
    )
    path = f"{ensure_checkpoint_dir(t.spark)}/places-{uuid.uuid4().hex}"
    places.write.parquet(path)
    return t.spark.read.schema(places.schema).parquet(path).select("place_id", "name", "name_he", "category")
