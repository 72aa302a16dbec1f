"""Data-quality queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom import constants as K
from pathloom.operators import quality as Q
from pathloom.plans import mapping as M
from pathloom.plans.registry import Tables, query
from pathloom.session import ensure_checkpoint_dir
from pathloom.sources import gtfs, manifest

c = F.col

_STOPS = """SELECT s_suppkey + 2 AS row_number, CASE WHEN s_suppkey % 50 = 7 THEN CAST(s_suppkey - 1 AS VARCHAR(20)) WHEN s_suppkey % 50 = 9 THEN ' ' ELSE CAST(s_suppkey AS VARCHAR(20)) END AS stop_id,
  CASE WHEN s_suppkey % 29 = 3 THEN 'north' WHEN s_suppkey % 31 = 5 THEN '50.0' ELSE '32.05' END AS stop_lat, '34.75' AS stop_lon FROM supplier"""
_ROUTES = "SELECT CAST(n_nationkey + 2 AS BIGINT) AS row_number, CAST(n_nationkey AS VARCHAR(20)) AS route_id FROM nation"
_TRIPS = """SELECT o_orderkey + 2 AS row_number, CASE WHEN o_orderkey % 100 = 3 THEN CAST(o_orderkey - 1 AS VARCHAR(20)) ELSE CAST(o_orderkey AS VARCHAR(20)) END AS trip_id,
  CAST(o_custkey % 26 AS VARCHAR(20)) AS route_id FROM orders"""


def _feed(t: Tables) -> dict[str, DataFrame]:
    return {
        "stops.txt": t.sql(_STOPS), "routes.txt": t.sql(_ROUTES), "trips.txt": t.sql(_TRIPS), "stop_times.txt": t.sql(M.STOP_TIMES),
    }


def _unique_sql(table: str, key: str, file: str) -> str:
    return f"""SELECT '{file}' AS file, row_number AS row, 'error' AS severity, CASE WHEN k = '' THEN 'empty_key' ELSE 'duplicate_key' END AS rule,
      '{file}:' || row_number || CASE WHEN k = '' THEN ' has an empty {key}' ELSE ' duplicates {key}=' || k END AS message
      FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_number) AS nth FROM (SELECT row_number, trim({key}) AS k FROM ({table}) x) y) z WHERE k = '' OR nth > 1"""


def _reference_sql(table: str, key: str, target: str, file: str, target_file: str) -> str:
    return f"""SELECT '{file}' AS file, row_number AS row, 'error' AS severity, 'missing_reference' AS rule,
      '{file}:' || row_number || ' references missing {key}=' || trim({key}) || ' in {target_file}' AS message FROM ({table}) x WHERE trim({key}) NOT IN (SELECT {key} FROM ({target}) y)"""


_COORD_SQL = f"""SELECT 'stops.txt' AS file, row_number AS row, 'error' AS severity, CASE WHEN la IS NULL THEN 'invalid_coordinate' ELSE 'implausible_coordinate' END AS rule,
  'stops.txt:' || row_number || CASE WHEN la IS NULL THEN ' has an invalid coordinate' ELSE ' is outside plausible Israel bounds' END AS message
  FROM (SELECT *, TRY_CAST(stop_lat AS DOUBLE) AS la, TRY_CAST(stop_lon AS DOUBLE) AS lo FROM ({_STOPS}) x) y WHERE la IS NULL OR NOT (la BETWEEN 29 AND 34 AND lo BETWEEN 33 AND 36)"""
_SEQUENCE_SQL = f"""SELECT 'stop_times.txt' AS file, row_number AS row, 'error' AS severity, 'invalid_sequence' AS rule, 'stop_times.txt:' || row_number || ' has an invalid stop_sequence' AS message
  FROM ({M.STOP_TIMES}) x WHERE TRY_CAST(stop_sequence AS BIGINT) IS NULL
  UNION ALL SELECT 'stop_times.txt', row_number, 'error', 'sequence_not_increasing', 'stop_times.txt:' || row_number || ' stop_sequence is not increasing'
  FROM (SELECT row_number, s, lag(s) OVER (PARTITION BY trip_id ORDER BY row_number) AS p FROM (SELECT *, TRY_CAST(stop_sequence AS BIGINT) AS s FROM ({M.STOP_TIMES}) x2) y WHERE s IS NOT NULL) z WHERE s <= coalesce(p, -1)"""
_Q1_SQL = " UNION ALL ".join([
    "SELECT CAST(NULL AS VARCHAR) AS file, -1::BIGINT AS row, 'error' AS severity, 'no_calendar' AS rule, 'GTFS has neither calendar.txt nor calendar_dates.txt' AS message",
    "SELECT NULL, -1, 'warning', 'no_feed_info', 'feed_info.txt is missing; publisher/version metadata is unavailable'",
    _unique_sql(_STOPS, "stop_id", "stops.txt"), _unique_sql(_ROUTES, "route_id", "routes.txt"), _unique_sql(_TRIPS, "trip_id", "trips.txt"),
    _reference_sql(_TRIPS, "route_id", _ROUTES, "trips.txt", "routes.txt"),
    _reference_sql(M.STOP_TIMES, "trip_id", _TRIPS, "stop_times.txt", "trips.txt"),
    _reference_sql(M.STOP_TIMES, "stop_id", _STOPS, "stop_times.txt", "stops.txt"),
    _COORD_SQL, _SEQUENCE_SQL,
])


@query("Q1", _Q1_SQL)
def q1(t: Tables) -> DataFrame:
    findings = gtfs.validate(t.spark, _feed(t), K.GTFS_REQUIRED)
    return findings.withColumn("row", F.coalesce("row", F.lit(-1)))


@query("W5", _unique_sql(_STOPS, "stop_id", "stops.txt") + " UNION ALL " + _unique_sql(_TRIPS, "trip_id", "trips.txt"))
def w5(t: Tables) -> DataFrame:
    return gtfs.unique_key(t.sql(_STOPS), "stop_id", "stops.txt").unionByName(
        gtfs.unique_key(t.sql(_TRIPS), "trip_id", "trips.txt")
    )


@query("J7", _reference_sql(M.STOP_TIMES, "stop_id", _STOPS, "stop_times.txt", "stops.txt"))
def j7(t: Tables) -> DataFrame:
    return gtfs.references(t.sql(M.STOP_TIMES), "stop_id", t.sql(_STOPS), "stop_times.txt", "stops.txt")


@query("W4", _SEQUENCE_SQL)
def w4(t: Tables) -> DataFrame:
    return gtfs.stop_sequences(t.sql(M.STOP_TIMES))


@query(
    "A6",
    """SELECT 'stops.txt' AS table_name, count(*) AS rows FROM supplier UNION ALL SELECT 'routes.txt', count(*) FROM nation
       UNION ALL SELECT 'trips.txt', count(*) FROM orders UNION ALL SELECT 'stop_times.txt', count(*) FROM lineitem""",
)
def a6(t: Tables) -> DataFrame:
    return gtfs.table_counts(_feed(t))


@query("S1", f"SELECT trip_id, stop_id, stop_sequence FROM ({M.STOP_TIMES}) x")
def s1(t: Tables) -> DataFrame:
    path = f"{ensure_checkpoint_dir(t.spark)}/feed-{uuid.uuid4().hex}/stop_times.txt"
    t.sql(M.STOP_TIMES).select("trip_id", "stop_id", "stop_sequence").write.option("header", True).csv(path)
    return gtfs.scan_table(t.spark, path).filter(c("row_number") >= 2).select("trip_id", "stop_id", "stop_sequence")


# files each feed (a customer's orders) delivers
_PRESENT = """SELECT DISTINCT o_custkey AS feed_id, CASE CAST(o_orderkey % 6 AS INTEGER) WHEN 0 THEN 'stops.txt' WHEN 1 THEN 'routes.txt' WHEN 2 THEN 'trips.txt'
  WHEN 3 THEN 'stop_times.txt' WHEN 4 THEN 'calendar.txt' ELSE 'feed_info.txt' END AS file FROM orders"""


@query(
    "U1",
    f"""WITH p AS ({_PRESENT}) SELECT f.feed_id, r.file FROM (SELECT DISTINCT feed_id FROM p) f
        CROSS JOIN (VALUES ('stops.txt'), ('routes.txt'), ('trips.txt'), ('stop_times.txt')) AS r(file) EXCEPT SELECT feed_id, file FROM p""",
)
def u1(t: Tables) -> DataFrame:
    return missing_files(t.sql(_PRESENT), "feed_id", K.GTFS_REQUIRED)


def missing_files(present: DataFrame, key: str, required: tuple[str, ...]) -> DataFrame:
    """Required files each feed lacks."""
    have = present.groupBy(key).agg(F.collect_set(F.when(c("file").isin(*required), c("file"))).alias("_have"))
    lacking = F.array_except(F.array(*[F.lit(r) for r in required]), c("_have"))
    return have.select(key, F.explode(lacking).alias("file"))


@query("U2", f"SELECT feed_id FROM ({_PRESENT}) p GROUP BY feed_id HAVING NOT bool_or(file IN ('calendar.txt', 'calendar_dates.txt'))")
def u2(t: Tables) -> DataFrame:
    return t.sql(_PRESENT).groupBy("feed_id").agg(F.bool_or(c("file").isin(*K.GTFS_CALENDARS)).alias("has")).filter(~c("has")).select("feed_id")


_EDGE_MODES = f"""SELECT source, target, CASE WHEN (source + target) % 4 = 0 THEN 'walk,bike' WHEN source % 3 = 0 THEN 'car' ELSE 'truck' END AS mode_list FROM ({M.STREETS}) s"""


@query(
    "U4",
    f"""SELECT source AS node_id FROM ({_EDGE_MODES}) e WHERE list_contains(string_split(mode_list, ','), 'walk')
        UNION SELECT target FROM ({_EDGE_MODES}) e WHERE list_contains(string_split(mode_list, ','), 'walk')""",
)
def u4(t: Tables) -> DataFrame:
    return Q.eligible_nodes(t.sql(M.by_key(_EDGE_MODES)).withColumn("modes", F.split("mode_list", ",")), F.lit("walk"))


_LOOSE_EDGES = """SELECT s_suppkey AS source, s_suppkey + 1 AS target FROM supplier UNION ALL SELECT s_suppkey - 3, s_suppkey + 7 FROM supplier"""


@query(
    "Q4",
    f"""SELECT source, target FROM ({_LOOSE_EDGES}) e WHERE source NOT IN (SELECT s_suppkey FROM supplier) OR target NOT IN (SELECT s_suppkey FROM supplier)""",
)
def q4(t: Tables) -> DataFrame:
    return Q.dangling_edges(t.sql(_LOOSE_EDGES), t.sql(M.NODES)).select("source", "target")


_RAW_REQUESTS = """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN ts END AS depart_at, CASE WHEN event_id % 5 < 2 THEN ts END AS arrive_by,
  CASE CAST(event_id % 11 AS INTEGER) WHEN 0 THEN 'walk' WHEN 1 THEN 'bike' WHEN 2 THEN 'scooter' WHEN 3 THEN 'car' WHEN 4 THEN 'motorcycle' WHEN 5 THEN 'truck'
    WHEN 6 THEN 'transit' WHEN 7 THEN 'bike_transit' WHEN 8 THEN 'scooter_transit' WHEN 9 THEN 'rental_transit' ELSE 'horse' END AS mode,
  CASE CAST(event_id % 7 AS INTEGER) WHEN 0 THEN 'fastest' WHEN 1 THEN 'balanced_shade' WHEN 2 THEN 'maximum_shade' WHEN 3 THEN 'fewer_lights' WHEN 4 THEN 'safer_streets'
    WHEN 5 THEN 'fewer_transfers' ELSE 'scenic' END AS preference,
  CAST(event_id % 200 - 100 AS DOUBLE) AS origin_lat, CAST(event_id % 400 - 200 AS DOUBLE) AS origin_lon, CAST(event_id % 190 - 95 AS DOUBLE) AS destination_lat, CAST(34 AS DOUBLE) AS destination_lon,
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 13 AS DOUBLE) END AS height_m, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 7 AS DOUBLE) END AS width_m,
  CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 120 AS DOUBLE) END AS weight_t, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 130 - 10 AS DOUBLE) END AS time_cap,
  CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 126 - 12 AS DOUBLE) END AS distance_cap, CAST(event_id % 12000 AS BIGINT) AS carry_m FROM events"""


@query(
    "Q3",
    f"""SELECT event_id, concat_ws(',', CASE WHEN depart_at IS NOT NULL AND arrive_by IS NOT NULL THEN 'both_times' END,
          CASE WHEN mode = 'walk' AND preference NOT IN ('fastest', 'balanced_shade', 'maximum_shade') THEN 'walking_preference' END,
          CASE WHEN mode IN ('car', 'motorcycle', 'truck') AND preference NOT IN ('fastest', 'fewer_lights') THEN 'road_preference' END,
          CASE WHEN mode = 'horse' THEN 'unknown_mode' END, CASE WHEN preference = 'scenic' THEN 'unknown_preference' END,
          CASE WHEN origin_lat NOT BETWEEN -90 AND 90 OR origin_lon NOT BETWEEN -180 AND 180 THEN 'origin' END,
          CASE WHEN destination_lat NOT BETWEEN -90 AND 90 OR destination_lon NOT BETWEEN -180 AND 180 THEN 'destination' END,
          CASE WHEN height_m <= 0 OR height_m > 10 THEN 'height_m' END, CASE WHEN width_m <= 0 OR width_m > 5 THEN 'width_m' END,
          CASE WHEN weight_t <= 0 OR weight_t > 100 THEN 'weight_t' END, CASE WHEN time_cap NOT BETWEEN 0 AND 100 THEN 'time_detour' END,
          CASE WHEN distance_cap NOT BETWEEN 0 AND 100 THEN 'distance_detour' END, CASE WHEN carry_m NOT BETWEEN 0 AND 10000 THEN 'carry_distance' END) AS errors
        FROM ({_RAW_REQUESTS}) r""",
)
def q3(t: Tables) -> DataFrame:
    return t.sql(_RAW_REQUESTS).select("event_id", F.array_join(Q.request_errors(), ",").alias("errors"))


# -- bundles: the files of the data directory are the bundle ---------------------------------------------------------
@query("S3")
def s3(t: Tables) -> DataFrame:
    return manifest.scan_files(t.spark, t.directory)


def _bundle(t: Tables) -> DataFrame:
    files = manifest.scan_files(t.spark, t.directory)
    named = files.withColumn("logical_name", F.regexp_replace("path", "\\.parquet$", "")).withColumn(
        "media_type", F.lit("application/vnd.apache.parquet")
    )
    return manifest.build_manifest(
        named, "tables", "Tel Aviv", {"tables": "seed-42"}, ["driver tables", "driver tables"], M.AS_OF
    )


@query("S4")
def s4(t: Tables) -> DataFrame:
    return manifest.manifest_json(_bundle(t))


@query("S2")
def s2(t: Tables) -> DataFrame:
    path = f"{ensure_checkpoint_dir(t.spark)}/manifest-{uuid.uuid4().hex}"
    manifest.write_manifest(_bundle(t), path)
    return manifest.manifest_files(manifest.read_manifest(t.spark, path))


def _damaged(t: Tables) -> DataFrame:
    """The manifest with a wrong size, a wrong checksum, a missing file and an escaping path."""
    def damage(f):
        return F.struct(
            f["logical_name"].alias("logical_name"),
            F.when(f["logical_name"] == "region", "../region.parquet").when(f["logical_name"] == "nation", "gone.parquet").otherwise(f["path"]).alias("path"),
            F.when(f["logical_name"] == "orders", F.lit("0" * 64)).otherwise(f["sha256"]).alias("sha256"),
            F.when(f["logical_name"] == "part", f["size_bytes"] + 1).otherwise(f["size_bytes"]).alias("size_bytes"),
            f["media_type"].alias("media_type"),
        )

    return _bundle(t).withColumn("files", F.transform("files", damage))


@query(
    "J12",
    """SELECT * FROM (VALUES ('error', 'Missing bundle file: gone.parquet'), ('error', 'Checksum mismatch: orders.parquet'), ('error', 'Size mismatch: part.parquet')) AS v(severity, message)""",
)
def j12(t: Tables) -> DataFrame:
    found = manifest.validate_bundle(_damaged(t), manifest.scan_files(t.spark, t.directory))
    return found.filter(c("message").rlike("^(Missing bundle|Checksum|Size)")).select("severity", "message")


@query(
    "Q2",
    """SELECT * FROM (VALUES ('tables', 'error', 'Missing required logical files: places, shade_profiles, street_graph, transit'), ('tables', 'error', 'Bundle path escapes its root: ../region.parquet'),
       ('tables', 'error', 'Missing bundle file: gone.parquet'), ('tables', 'error', 'Checksum mismatch: orders.parquet'), ('tables', 'error', 'Size mismatch: part.parquet')) AS v(bundle_id, severity, message)""",
)
def q2(t: Tables) -> DataFrame:
    return manifest.validate_bundle(_damaged(t), manifest.scan_files(t.spark, t.directory))
