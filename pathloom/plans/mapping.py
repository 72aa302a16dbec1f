"""Views of the driver's tables as this engine's inputs, in SQL that Spark and DuckDB both accept."""

AS_OF = "2024-02-15 00:00:00"

PLACES = """
SELECT c_custkey AS place_id, c_name AS name, c_mktsegment AS category,
       CAST(32.0 AS DOUBLE) + ((c_custkey * 7919) % 20000) / 1e5 AS lat,
       CAST(34.69 AS DOUBLE) + ((c_custkey * 104729) % 24000) / 1e5 AS lon
FROM customer"""

POINTS = """
SELECT event_id AS point_id, user_id,
       CAST(31.98 AS DOUBLE) + ((event_id * 6131) % 24000) / 1e5 AS lat,
       CAST(34.67 AS DOUBLE) + ((event_id * 7321) % 28000) / 1e5 AS lon
FROM events"""

# pairs of coordinates
HOPS = """
SELECT event_id, user_id,
       CAST(31.98 AS DOUBLE) + ((event_id * 6131) % 24000) / 1e5 AS lat1,
       CAST(34.67 AS DOUBLE) + ((event_id * 7321) % 28000) / 1e5 AS lon1,
       CAST(32.0 AS DOUBLE) + ((event_id * 911) % 20000) / 1e5 AS lat2,
       CAST(34.69 AS DOUBLE) + ((event_id * 1277) % 24000) / 1e5 AS lon2
FROM events"""

# a random walk of short steps per user: route geometry with real turns
WALKS = """
SELECT user_id AS route_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
       CAST(32.05 AS DOUBLE) + ((event_id * 6131) % 3000) / 1e5 AS lat,
       CAST(34.75 AS DOUBLE) + ((event_id * 7321) % 3000) / 1e5 AS lon
FROM events"""

NODES = """
SELECT s_suppkey AS node_id,
       CAST(32.05 AS DOUBLE) + CAST(floor(s_suppkey / 1e1) AS BIGINT) * 200 / 1e5 AS lat,
       CAST(34.75 AS DOUBLE) + (s_suppkey % 10) * 200 / 1e5 AS lon
FROM supplier"""

# one row per street; the reverse direction comes from the graph builder
STREETS = """
SELECT a.s_suppkey AS source, b.s_suppkey AS target,
       ((a.s_suppkey * 37 + b.s_suppkey) % 100) / 1e2 AS shade,
       ((a.s_suppkey * 53 + b.s_suppkey) % 100) / 1e2 AS comfort,
       CASE WHEN (a.s_suppkey + b.s_suppkey) % 3 = 0 THEN a.s_suppkey END AS signal_id,
       CASE WHEN a.s_suppkey % 4 = 0 THEN 'marked' END AS crossing_kind,
       CASE WHEN a.s_suppkey % 8 = 0 THEN 'low' ELSE 'high' END AS crossing_confidence,
       CASE WHEN a.s_suppkey % 5 = 0 THEN 'right' END AS side
FROM supplier a JOIN supplier b
  ON (b.s_suppkey = a.s_suppkey + 1 AND a.s_suppkey % 10 < 9) OR b.s_suppkey = a.s_suppkey + 10"""

# the same rows by one equality each: an OR of equalities would be tried on every pair of nodes
_STREET = STREETS.split("FROM supplier a")[0]
STREETS_BY_KEY = f"""{_STREET}FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 10 < 9
UNION ALL {_STREET}FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 10"""


def by_key(text: str) -> str:
    """A query over STREETS for Spark, with the streets found by equality."""
    return text.replace(STREETS, STREETS_BY_KEY)


STOP_TIMES = """
SELECT CAST(l_orderkey AS VARCHAR(20)) AS trip_id,
       CASE WHEN l_suppkey = 13 THEN 'missing' ELSE CAST(l_suppkey AS VARCHAR(20)) END AS stop_id,
       CASE WHEN l_partkey % 97 = 0 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR(20)) END AS stop_sequence,
       CAST(l_orderkey * 1000000
            + row_number() OVER (PARTITION BY l_orderkey
                                 ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice)
            + 1 AS BIGINT) AS row_number
FROM lineitem"""

ALTERNATIVES = """
SELECT l_orderkey AS request_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_quantity, l_extendedprice, l_partkey, l_suppkey, l_linenumber) AS BIGINT) AS pos,
       l_quantity * 60 AS duration_s, l_quantity * 80 + l_partkey % 50 AS distance_m,
       l_quantity * (1 - (l_partkey % 10) / 1e1) AS sun_min,
       CAST(l_linenumber AS BIGINT) AS signals, l_suppkey % 3 AS transfers, l_partkey % 5 AS polyline_key
FROM lineitem"""

# what each request of ALTERNATIVES asks for
ROUTE_REQUESTS = """
SELECT o_orderkey AS request_id,
       CASE CAST(o_orderkey % 3 AS INTEGER) WHEN 0 THEN 'fastest' WHEN 1 THEN 'balanced_shade'
            ELSE 'maximum_shade' END AS walk_preference,
       CASE WHEN o_orderkey % 2 = 0 THEN 'fewer_lights' ELSE 'fastest' END AS road_preference,
       CASE WHEN o_orderkey % 2 = 0 THEN 'fewer_transfers' ELSE 'fastest' END AS transit_preference,
       CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 5 AS DOUBLE) * 20 END AS time_cap,
       CASE WHEN o_orderkey % 8 = 0 THEN CAST(o_orderkey % 5 AS DOUBLE) * 25 END AS distance_cap,
       o_orderkey % 11 <> 0 AS context_complete,
       o_orderkey % 13 = 0 AS rental_fallback
FROM orders"""

ROUTE_VERTICES = """
SELECT u.trip_id, CAST(v.idx AS BIGINT) AS idx, CAST(32.05 AS DOUBLE) + v.idx * 100 / 1e5 AS lat,
       CAST(34.75 AS DOUBLE) + (u.trip_id % 50) * 100 / 1e5 AS lon
FROM (SELECT DISTINCT user_id AS trip_id FROM events) u
CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15),(16),(17),(18),(19)) AS v(idx)"""

FIXES = """
SELECT user_id AS trip_id, event_id, ts, CAST(5 + event_id % 20 AS DOUBLE) AS accuracy_m, event_type,
       CAST(32.05 AS DOUBLE) + least(k - 1, 19) * 100 / 1e5 AS lat,
       CAST(34.75 AS DOUBLE) + ((user_id % 50) * 100 + CASE WHEN event_type = 'error' THEN 1000 ELSE 0 END) / 1e5 AS lon
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) e"""

VEHICLES = """
SELECT user_id % 3 AS provider, user_id AS vehicle_id, event_id, ts AS observed_at, value AS battery,
       event_type = 'error' AS is_disabled, event_type = 'purchase' AS is_reserved,
       CAST(32.0 AS DOUBLE) + ((event_id * 911) % 20000) / 1e5 AS lat,
       CAST(34.69 AS DOUBLE) + ((event_id * 1277) % 24000) / 1e5 AS lon
FROM events"""

BUILDINGS = """
SELECT p_partkey AS osm_id,
       CAST(32.05 AS DOUBLE) + ((p_partkey * 7919) % 2000) / 1e5 AS lat0,
       CAST(34.75 AS DOUBLE) + ((p_partkey * 104729) % 2000) / 1e5 AS lon0,
       (10 + p_size % 20) / 1e5 AS half_deg,
       CASE WHEN p_size % 3 = 0 THEN concat(CAST(p_size AS VARCHAR(10)), ' m') END AS height_tag,
       CASE WHEN p_size % 3 = 1 THEN CAST(p_size AS VARCHAR(10)) END AS levels_tag
FROM part"""

SIGNALS = """
SELECT s_suppkey AS osm_id,
       CAST(32.05 AS DOUBLE) + (CAST(floor(s_suppkey / 1e1) AS BIGINT) * 200 + (s_suppkey % 7) * 5) / 1e5 AS lat,
       CAST(34.75 AS DOUBLE) + ((s_suppkey % 10) * 200 + (s_suppkey % 7) * 5) / 1e5 AS lon
FROM supplier"""

ITINERARY_LEGS = """
SELECT l_orderkey AS itinerary_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS leg_index,
       CASE CAST(l_suppkey % 4 AS INTEGER) WHEN 0 THEN 'walk' WHEN 1 THEN 'bike' WHEN 2 THEN 'scooter' ELSE 'transit' END AS mode,
       l_quantity * 100 AS distance_m, l_quantity * 60 AS duration_s,
       concat('Line ', CAST(l_partkey % 90 AS VARCHAR(10))) AS route_name,
       CASE WHEN l_partkey % 4 = 0 THEN '' ELSE concat('Stop_', CAST(l_suppkey AS VARCHAR(10)), '_ North') END AS headsign,
       concat('Stop ', CAST(l_suppkey AS VARCHAR(10))) AS to_name,
       l_partkey % 3 AS bike_rule, l_partkey % 20 AS maneuver_code, l_suppkey % 8 AS instruction_no
FROM lineitem"""

REQUESTS = """
SELECT c_custkey AS request_id, c_custkey % n AS origin, (c_custkey * 7 + 3) % n AS destination,
       CASE CAST(c_custkey % 6 AS INTEGER) WHEN 0 THEN 'walk' WHEN 1 THEN 'bike' WHEN 2 THEN 'scooter' WHEN 3 THEN 'car'
            WHEN 4 THEN 'motorcycle' ELSE 'truck' END AS mode
FROM customer CROSS JOIN (SELECT count(*) AS n FROM supplier) s"""


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(CASE WHEN {lat1} IS NULL OR {lat2} IS NULL THEN NULL ELSE 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))) END)"
    )


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"((degrees(atan2(sin(radians({lon2} - {lon1})) * cos(radians({lat2})),"
        f" cos(radians({lat1})) * sin(radians({lat2}))"
        f" - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1})))) + 360) % 360)"
    )


def turn(previous: str, current: str) -> str:
    return f"((({current}) - ({previous}) + 540) % 360 - 180)"


def turn_class(delta: str) -> str:
    return (
        f"CASE WHEN abs({delta}) < 20 THEN 'straight'"
        f" WHEN abs({delta}) < 55 THEN CASE WHEN {delta} > 0 THEN 'slight_right' ELSE 'slight_left' END"
        f" WHEN abs({delta}) < 135 THEN CASE WHEN {delta} > 0 THEN 'right' ELSE 'left' END ELSE 'uturn' END"
    )
