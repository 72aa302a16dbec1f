"""Column-function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom import constants as K
from pathloom.functions import geo, profile, rules, solar, text
from pathloom.plans import mapping as M
from pathloom.plans.registry import Tables, query

c = F.col


@query("C1", f"SELECT event_id, round({M.haversine('lat1', 'lon1', 'lat2', 'lon2')}, 4) AS distance_m FROM ({M.HOPS}) h")
def c1(t: Tables) -> DataFrame:
    return t.sql(M.HOPS).select(
        "event_id", F.round(geo.haversine_m(c("lat1"), c("lon1"), c("lat2"), c("lon2")), 4).alias("distance_m")
    )


@query("C2", f"SELECT event_id, round({M.bearing('lat1', 'lon1', 'lat2', 'lon2')}, 5) AS bearing FROM ({M.HOPS}) h")
def c2(t: Tables) -> DataFrame:
    return t.sql(M.HOPS).select(
        "event_id", F.round(geo.bearing_degrees(c("lat1"), c("lon1"), c("lat2"), c("lon2")), 5).alias("bearing")
    )


_HEADINGS = "SELECT event_id, (event_id * 37) % 360 AS h1, (event_id * 101) % 360 AS h2 FROM events"


@query(
    "C3",
    f"SELECT event_id, CAST((h2 - h1 + 540) % 360 - 180 AS DOUBLE) AS signed_turn,"
    f" CAST(abs((h1 - h2 + 540) % 360 - 180) AS DOUBLE) AS difference FROM ({_HEADINGS}) x",
)
def c3(t: Tables) -> DataFrame:
    h1, h2 = c("h1").cast("double"), c("h2").cast("double")
    return t.sql(_HEADINGS).select(
        "event_id", geo.signed_turn(h1, h2).alias("signed_turn"), geo.angle_difference(h1, h2).alias("difference")
    )


@query("C4", f"SELECT event_id, {M.turn_class(M.turn('h1', 'h2'))} AS modifier FROM ({_HEADINGS}) x")
def c4(t: Tables) -> DataFrame:
    return t.sql(_HEADINGS).select("event_id", geo.turn_modifier(c("h1"), c("h2")).alias("modifier"))


@query(
    "C5",
    f"SELECT user_id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north"
    f" FROM ({M.POINTS}) p GROUP BY user_id",
)
def c5(t: Tables) -> DataFrame:
    return t.sql(M.POINTS).groupBy("user_id").agg(
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north")
    )


@query(
    "C9",
    """SELECT event_id, round(greatest(0.0, least(1.0, v[l + 1] * (1 - (p - floor(p))) + v[(l + 1) % 24 + 1] * (p - floor(p)))), 6) AS shade
       FROM (SELECT *, CAST(floor(p) AS BIGINT) % 24 AS l FROM (
         SELECT event_id, list_transform(range(24), lambda h: ((user_id * 37 + h * 13) % 100) / 1e2) AS v,
                (epoch_us(ts + INTERVAL 2 HOUR) % 86400000000) / 1e6 / 86400.0 * 24 AS p FROM events) a) b""",
)
def c9(t: Tables) -> DataFrame:
    bins = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.pmod(c("user_id") * 37 + h * 13, F.lit(100)) / 100.0)
    return t["events"].select(
        "event_id",
        F.round(profile.daily_value(bins, profile.local_seconds(c("ts").cast("timestamp"))), 6).alias("shade"),
    )


@query(
    "C10",
    """SELECT event_id, round(o, 6) AS obstruction, elevation > 0 AND elevation > o AS visible FROM (
         SELECT *, v[l + 1] * (1 - (p - floor(p))) + v[(l + 1) % 16 + 1] * (p - floor(p)) AS o FROM (
           SELECT *, CAST(floor(p) AS BIGINT) % 16 AS l FROM (
             SELECT event_id, list_transform(range(16), lambda h: CAST((user_id * 7 + h * 11) % 60 AS DOUBLE)) AS v,
                    ((event_id * 37) % 720) % 360 / 360.0 * 16 AS p, (event_id * 13) % 80 - 10 AS elevation FROM events) a) b) d""",
)
def c10(t: Tables) -> DataFrame:
    horizon = F.transform(
        F.sequence(F.lit(0), F.lit(15)), lambda h: F.pmod(c("user_id") * 7 + h * 11, F.lit(60)).cast("double")
    )
    azimuth = F.pmod(c("event_id") * 37, F.lit(720)).cast("double")
    elevation = (F.pmod(c("event_id") * 13, F.lit(80)) - 10).cast("double")
    return t["events"].select(
        "event_id",
        F.round(profile.obstruction_at(horizon, azimuth), 6).alias("obstruction"),
        profile.sun_visible(horizon, azimuth, elevation).alias("visible"),
    )


_SOLAR = f"""
WITH a AS (SELECT event_id, lat1 AS lat, lon1 AS lon, epoch_us(ts) / 1e6 / 86400.0 AS d,
                  (epoch_us(ts) / 1e6 / 86400.0 + 2440587.5 - 2451545.0) / 36525.0 AS t
           FROM ({M.HOPS}) h JOIN (SELECT event_id, ts FROM events) e USING (event_id)),
b AS (SELECT *, (280.46646 + t * (36000.76983 + t * 0.0003032)) % 360 AS l0,
             radians(357.52911 + t * (35999.05029 - 0.0001537 * t)) AS m,
             0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS e,
             radians(125.04 - 1934.136 * t) AS om FROM a),
g AS (SELECT *, radians(l0 + sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t)
                + sin(3 * m) * 0.000289 - 0.00569 - 0.00478 * sin(om)) AS lam,
             radians(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * cos(om)) AS eps FROM b),
k AS (SELECT *, asin(sin(eps) * sin(lam)) AS dec, pow(tan(eps / 2), 2) AS y, radians(l0) AS l FROM g),
q AS (SELECT *, radians((((d - floor(d)) * 1440 + 4 * lon + 4 * degrees(y * sin(2 * l) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * l)
             - 0.5 * y * y * sin(4 * l) - 1.25 * e * e * sin(2 * m))) % 1440) / 4 - 180) AS ha, radians(lat) AS phi FROM k),
r AS (SELECT *, 90 - degrees(acos(greatest(-1.0, least(1.0, sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(ha))))) AS h,
             (degrees(atan2(sin(ha), cos(ha) * sin(phi) - tan(dec) * cos(phi))) + 180) % 360 AS azimuth FROM q)
SELECT event_id, round(azimuth, 4) AS azimuth,
       round(h + CASE WHEN h > 85 THEN 0.0
                      WHEN h > 5 THEN 58.1 / tan(radians(h)) - 0.07 / pow(tan(radians(h)), 3) + 0.000086 / pow(tan(radians(h)), 5)
                      WHEN h > -0.575 THEN 1735.0 + h * (-518.2 + h * (103.4 + h * (-12.79 + h * 0.711)))
                      ELSE -20.774 / tan(radians(h)) END / 3600, 4) AS elevation FROM r"""


@query("C11", _SOLAR)
def c11(t: Tables) -> DataFrame:
    hops = t.sql(M.HOPS.replace("FROM events", ", ts FROM events"))
    placed = solar.with_solar_position(hops, F.unix_micros(c("ts").cast("timestamp")) / 1e6, c("lat1"), c("lon1"))
    return placed.select("event_id", F.round("azimuth", 4).alias("azimuth"), F.round("elevation", 4).alias("elevation"))


def grid_sql(source: str, keys: str, lat: str = "lat", lon: str = "lon") -> str:
    """Transverse-Mercator series over a source relation, adding x and y."""
    e2 = geo._E2
    return f"""
SELECT {keys},
  {K.GRID_SCALE} * nu * (a + (1 - tt + cc) * a ** 3 / 6 + (5 - 18 * tt + tt * tt + 72 * cc - 58 * {geo._EP2}) * a ** 5 / 120)
    + {K.GRID_FALSE_EASTING_M} AS x,
  {K.GRID_SCALE} * (arc - {geo.GRID_ARC_ORIGIN!r} + nu * tan(phi) * (a * a / 2 + (5 - tt + 9 * cc + 4 * cc * cc) * a ** 4 / 24
    + (61 - 58 * tt + tt * tt + 600 * cc - 330 * {geo._EP2}) * a ** 6 / 720)) + {K.GRID_FALSE_NORTHING_M} AS y
FROM (SELECT *, {K.GRID_SEMI_MAJOR_M} / sqrt(1 - {e2!r} * sin(phi) * sin(phi)) AS nu, tan(phi) * tan(phi) AS tt,
             {geo._EP2!r} * cos(phi) * cos(phi) AS cc, radians({lon} - {K.GRID_ORIGIN_LON}) * cos(phi) AS a,
             {K.GRID_SEMI_MAJOR_M} * ({geo._M0!r} * phi - {geo._M2!r} * sin(2 * phi) + {geo._M4!r} * sin(4 * phi)
               - {geo._M6!r} * sin(6 * phi)) AS arc
      FROM (SELECT *, CAST(radians({lat}) AS DOUBLE) AS phi FROM {source}) g1) g2"""


@query("C12", f"SELECT point_id, round(x, 3) AS x, round(y, 3) AS y FROM ({grid_sql(f'({M.POINTS}) p', 'point_id')}) z")
def c12(t: Tables) -> DataFrame:
    x, y = geo.to_grid(c("lat"), c("lon"))
    return t.sql(M.POINTS).select("point_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_SEGMENT = f"""SELECT event_id, lat1, lon1, lat2, lon2,
  CAST(32.0 AS DOUBLE) + ((event_id * 3571) % 20000) / 1e5 AS lat,
  CAST(34.69 AS DOUBLE) + ((event_id * 2741) % 24000) / 1e5 AS lon FROM ({M.HOPS}) h"""


@query(
    "C13",
    f"""SELECT event_id, round(f, 6) AS fraction, round(sqrt(pow(px - f * bx, 2) + pow(py - f * by_, 2)), 4) AS distance_m FROM (
          SELECT *, CASE WHEN bx * bx + by_ * by_ > 0 THEN greatest(0.0, least(1.0, (px * bx + py * by_) / (bx * bx + by_ * by_))) ELSE 0.0 END AS f FROM (
            SELECT event_id, (lon2 - lon1) * 111320 * cos(radians(lat)) AS bx, (lat2 - lat1) * 111320 AS by_,
                   (lon - lon1) * 111320 * cos(radians(lat)) AS px, (lat - lat1) * 111320 AS py FROM ({_SEGMENT}) s) a) b""",
)
def c13(t: Tables) -> DataFrame:
    fraction, distance = geo.project_to_segment(c("lat"), c("lon"), c("lat1"), c("lon1"), c("lat2"), c("lon2"))
    return t.sql(_SEGMENT).select(
        "event_id", F.round(fraction, 6).alias("fraction"), F.round(distance, 4).alias("distance_m")
    )


@query(
    "C14",
    f"""SELECT osm_id, round(CASE WHEN h BETWEEN 1 AND 300 THEN h WHEN l BETWEEN 1 AND 80 THEN l * 3.2 ELSE 10.0 END, 4) AS height_m,
               CASE WHEN h BETWEEN 1 AND 300 THEN 'high' WHEN l BETWEEN 1 AND 80 THEN 'medium' ELSE 'low' END AS confidence
        FROM (SELECT osm_id, TRY_CAST(replace(height_tag, ' m', '') AS DOUBLE) AS h, TRY_CAST(levels_tag AS DOUBLE) AS l
              FROM ({M.BUILDINGS}) b) x""",
)
def c14(t: Tables) -> DataFrame:
    height, confidence = rules.building_height(c("height_tag"), c("levels_tag"))
    return t.sql(M.BUILDINGS).select("osm_id", F.round(height, 4).alias("height_m"), confidence.alias("confidence"))


@query(
    "C15",
    "SELECT doc_id, sha256(replace(lower(strip_accents(text)), 'ß', 'ss')) AS folded FROM documents",
)
def c15(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", F.sha2(text.fold_text(c("text")), 256).alias("folded"))


_LABELS = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('כיכר ', CAST(event_id AS VARCHAR(20)))
                    WHEN event_id % 3 = 1 THEN concat('  Square ', CAST(event_id AS VARCHAR(20))) ELSE '   ' END AS name,
                    CASE WHEN event_id % 5 < 2 THEN concat(event_type, ' street') END AS street,
                    CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 90 AS VARCHAR(20)) END AS house_number,
                    concat(event_type, '_ stop __', CAST(event_id % 9 AS VARCHAR(20))) AS raw,
                    CASE WHEN event_id % 6 = 0 THEN ' _ _' ELSE concat('_', event_type, '_') END AS sparse
             FROM events"""


@query(
    "C16",
    f"SELECT event_id, coalesce(regexp_matches(name, '[\\x{{0590}}-\\x{{05FF}}]'), false) AS hebrew FROM ({_LABELS}) l",
)
def c16(t: Tables) -> DataFrame:
    return t.sql(_LABELS).select("event_id", text.contains_hebrew(c("name")).alias("hebrew"))


@query(
    "C17",
    f"""SELECT event_id, CASE WHEN f IS NULL THEN coalesce(house_number, '') WHEN house_number IS NULL THEN f
               ELSE f || ' ' || house_number END AS display
        FROM (SELECT *, coalesce(nullif(trim(name), ''), nullif(trim(street), '')) AS f FROM ({_LABELS}) l) x""",
)
def c17(t: Tables) -> DataFrame:
    name = text.first_text(c("name"), c("street"))
    return t.sql(_LABELS).select("event_id", text.display_name(name, c("house_number")).alias("display"))


@query(
    "C18",
    f"""SELECT event_id, event_type || ' · stop · ' || CAST(event_id % 9 AS VARCHAR) AS display,
               CASE WHEN event_id % 6 = 0 THEN 'Origin' ELSE event_type END AS sparse_display
        FROM ({_LABELS}) l JOIN (SELECT event_id, event_type FROM events) e USING (event_id)""",
)
def c18(t: Tables) -> DataFrame:
    return t.sql(_LABELS).select(
        "event_id",
        text.display_text(c("raw")).alias("display"),
        text.display_text(c("sparse"), "Origin").alias("sparse_display"),
    )


_INSTRUCTIONS = f"""SELECT itinerary_id, leg_index, maneuver_code, instruction_no,
  CASE CAST(instruction_no AS INTEGER) WHEN 0 THEN 'Arrive at your Destination on the left' WHEN 1 THEN 'Make a U-turn' WHEN 2 THEN 'Bear LEFT onto Main'
       WHEN 3 THEN 'Slight right' WHEN 4 THEN 'Turn left' WHEN 5 THEN 'Keep right at the fork' WHEN 6 THEN '' ELSE 'Continue' END AS instruction
  FROM ({M.ITINERARY_LEGS}) g"""


@query(
    "C19",
    f"""SELECT itinerary_id, leg_index, CASE
          WHEN maneuver_code IN (4, 5, 6) THEN 'arrive' WHEN maneuver_code = 9 THEN 'slight_right'
          WHEN maneuver_code IN (10, 11) THEN 'right' WHEN maneuver_code IN (12, 13) THEN 'uturn'
          WHEN maneuver_code IN (14, 15) THEN 'left' WHEN maneuver_code = 16 THEN 'slight_left'
          WHEN instruction_no = 0 THEN 'arrive' WHEN instruction_no = 1 THEN 'uturn' WHEN instruction_no = 2 THEN 'slight_left'
          WHEN instruction_no = 3 THEN 'slight_right' WHEN instruction_no = 4 THEN 'left' WHEN instruction_no = 5 THEN 'right'
          ELSE 'straight' END AS modifier FROM ({_INSTRUCTIONS}) i""",
)
def c19(t: Tables) -> DataFrame:
    return t.sql(_INSTRUCTIONS).select(
        "itinerary_id", "leg_index", rules.maneuver_modifier(c("instruction"), c("maneuver_code")).alias("modifier")
    )


_PROVIDER_MODES = """SELECT event_id, CASE CAST(event_id % 9 AS INTEGER) WHEN 0 THEN 'walk' WHEN 1 THEN 'Bicycle' WHEN 2 THEN 'SCOOTER' WHEN 3 THEN 'car'
  WHEN 4 THEN 'tram' WHEN 5 THEN 'BIKE_SHARING' WHEN 6 THEN 'funicular' WHEN 7 THEN 'bike' ELSE '' END AS raw_mode FROM events"""


@query(
    "C20",
    f"""SELECT event_id, CASE upper(raw_mode) WHEN 'WALK' THEN 'walk' WHEN 'BICYCLE' THEN 'bike' WHEN 'BIKE' THEN 'bike'
               WHEN 'BIKE_SHARING' THEN 'bike' WHEN 'SCOOTER' THEN 'scooter' WHEN 'CAR' THEN 'car' ELSE 'transit' END AS mode
        FROM ({_PROVIDER_MODES}) p""",
)
def c20(t: Tables) -> DataFrame:
    return t.sql(_PROVIDER_MODES).select("event_id", rules.provider_mode(c("raw_mode")).alias("mode"))


_VEHICLE_REQUESTS = """SELECT event_id, CASE CAST(event_id % 3 AS INTEGER) WHEN 0 THEN 'bike_transit' WHEN 1 THEN 'scooter_transit' ELSE 'transit' END AS mode,
  CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN 'none' WHEN 1 THEN 'full_size_bike' WHEN 2 THEN 'folding_bike' ELSE 'personal_scooter' END AS kind,
  event_id % 10 = 0 AS flag FROM events"""


@query(
    "C21",
    f"""SELECT event_id, live_kind, compact_kind, flag OR live_kind IN ('folding_bike', 'personal_scooter') AS live_folds FROM (
          SELECT *, CASE WHEN kind <> 'none' THEN kind WHEN mode = 'bike_transit' THEN 'folding_bike'
                         WHEN mode = 'scooter_transit' THEN 'personal_scooter' ELSE 'none' END AS live_kind,
                    CASE WHEN kind <> 'none' THEN kind WHEN mode = 'bike_transit' THEN 'full_size_bike'
                         WHEN mode = 'scooter_transit' THEN 'personal_scooter' ELSE 'none' END AS compact_kind
          FROM ({_VEHICLE_REQUESTS}) v) x""",
)
def c21(t: Tables) -> DataFrame:
    live = rules.effective_vehicle(c("mode"), c("kind"))
    return t.sql(_VEHICLE_REQUESTS).select(
        "event_id",
        live.alias("live_kind"),
        rules.effective_vehicle(c("mode"), c("kind"), "full_size_bike").alias("compact_kind"),
        rules.can_fold(c("flag"), live).alias("live_folds"),
    )


@query(
    "C22",
    f"""SELECT request_id, pos, CASE WHEN distance_m - 800 <= 0 THEN 0.0
          ELSE round_even(greatest(0.0, (duration_s / (distance_m - 800) - 1) * 100) * 100, 0) / 100 END AS detour FROM ({M.ALTERNATIVES}) a""",
)
def c22(t: Tables) -> DataFrame:
    return t.sql(M.ALTERNATIVES).select(
        "request_id", "pos", rules.detour_percent(c("duration_s"), c("distance_m") - 800).alias("detour")
    )


@query("C23", "SELECT event_id, epoch_us(ts - INTERVAL 2 HOUR) AS instant_us FROM events")
def c23(t: Tables) -> DataFrame:
    return t["events"].select(
        "event_id", F.unix_micros(rules.local_to_instant(c("ts").cast("timestamp"))).alias("instant_us")
    )


@query(
    "C24",
    f"""SELECT request_id, pos, substring(sha256('v1|walk|route.fastest|' || CAST(polyline_key AS VARCHAR)), 1, 20) AS route_id
        FROM ({M.ALTERNATIVES}) a""",
)
def c24(t: Tables) -> DataFrame:
    return t.sql(M.ALTERNATIVES).select(
        "request_id",
        "pos",
        rules.route_id(F.lit("v1"), F.lit("walk"), F.lit("route.fastest"), c("polyline_key").cast("string")).alias("route_id"),
    )


_TIMES = """SELECT event_id, CASE CAST(event_id % 3 AS INTEGER) WHEN 0 THEN CAST(1704067200 + event_id AS VARCHAR(20)) WHEN 1 THEN 'soon' END AS seconds_text,
  concat('2024-01-', lpad(CAST(event_id % 28 + 1 AS VARCHAR(20)), 2, '0'), 'T', lpad(CAST(event_id % 24 AS VARCHAR(20)), 2, '0'), ':15:00',
         CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '' ELSE ' o clock' END) AS iso,
  (1704067200 + event_id) * 1000 + event_id % 1000 AS millis FROM events"""


@query(
    "C25",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1704067200 + event_id ELSE 1706659200 END AS observed_s,
              CASE CAST(event_id % 4 AS INTEGER) WHEN 3 THEN -1 ELSE 1704067200 + (event_id % 28) * 86400 + (event_id % 24) * 3600 + 900
                - CASE WHEN event_id % 4 = 1 THEN 7200 ELSE 0 END END AS iso_s,
              ((1704067200 + event_id) * 1000 + event_id % 1000) * 1000 AS millis_us FROM events""",
)
def c25(t: Tables) -> DataFrame:
    fallback = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return t.sql(_TIMES).select(
        "event_id",
        F.unix_seconds(rules.epoch_or(c("seconds_text"), fallback)).alias("observed_s"),
        F.coalesce(F.unix_seconds(rules.parse_instant(c("iso"))), F.lit(-1)).cast("long").alias("iso_s"),
        F.unix_micros(F.timestamp_millis(c("millis"))).alias("millis_us"),
    )


_TOKENS = """SELECT event_id, CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN CAST(event_id % 101 AS VARCHAR(20)) WHEN 1 THEN '1.0' WHEN 2 THEN '1'
  ELSE concat('0.', lpad(CAST(event_id % 100 AS VARCHAR(20)), 2, '0')) END AS token FROM events"""


@query(
    "C26",
    """SELECT event_id, CAST(CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN event_id % 101 WHEN 1 THEN 100 WHEN 2 THEN 1
              ELSE event_id % 100 END AS INTEGER) AS battery FROM events""",
)
def c26(t: Tables) -> DataFrame:
    return t.sql(_TOKENS).select("event_id", rules.battery_percent(c("token")).alias("battery"))


_SHORT = """SELECT event_id, CAST(32.05 AS DOUBLE) + ((event_id * 6131) % 3000) / 1e5 AS lat1, CAST(34.75 AS DOUBLE) + ((event_id * 7321) % 3000) / 1e5 AS lon1,
  CAST(32.05 AS DOUBLE) + ((event_id * 6131) % 3000 + (event_id % 13) * 4) / 1e5 AS lat2,
  CAST(34.75 AS DOUBLE) + ((event_id * 7321) % 3000 + (event_id % 7) * 3) / 1e5 AS lon2 FROM events"""


@query(
    "C27",
    f"""SELECT event_id, CAST(i AS BIGINT) AS sample, round(lat1 + (lat2 - lat1) * i / n, 10) AS lat, round(lon1 + (lon2 - lon1) * i / n, 10) AS lon
        FROM (SELECT *, unnest(range(n + 1)) AS i FROM (
          SELECT *, greatest(1, CAST(ceil({M.haversine('lat1', 'lon1', 'lat2', 'lon2')} / 5) AS BIGINT)) AS n FROM ({_SHORT}) s) a) b""",
)
def c27(t: Tables) -> DataFrame:
    steps = geo.segment_steps(geo.haversine_m(c("lat1"), c("lon1"), c("lat2"), c("lon2")))
    sampled = t.sql(_SHORT).withColumn("n", steps).withColumn("i", F.explode(F.sequence(F.lit(0), c("n"))))
    return sampled.select(
        "event_id",
        c("i").cast("long").alias("sample"),
        F.round(c("lat1") + (c("lat2") - c("lat1")) * c("i") / c("n"), 10).alias("lat"),
        F.round(c("lon1") + (c("lon2") - c("lon1")) * c("i") / c("n"), 10).alias("lon"),
    )


@query(
    "C28",
    f"""SELECT itinerary_id, leg_index,
          CASE WHEN maneuver_code IN (4, 5, 6) THEN 'navigation.arrive' WHEN leg_index = 0 THEN 'navigation.depart' ELSE 'navigation.turn' END AS engine_key,
          CASE WHEN mode = 'transit' THEN 'navigation.board' ELSE 'navigation.depart' END AS handoff_key,
          CASE WHEN mode = 'transit' THEN 'board' ELSE 'depart' END AS handoff_modifier,
          CASE WHEN mode <> 'transit' THEN to_name WHEN headsign = '' THEN route_name ELSE route_name || ' ' || headsign END AS street_name
        FROM ({M.ITINERARY_LEGS}) g""",
)
def c28(t: Tables) -> DataFrame:
    key, modifier = rules.handoff_key(c("mode"))
    typed = F.when(c("maneuver_code").isin(4, 5, 6), "arrive").otherwise("straight")
    return t.sql(M.ITINERARY_LEGS).select(
        "itinerary_id",
        "leg_index",
        rules.instruction_key(typed, c("leg_index"), F.lit(0)).alias("engine_key"),
        key.alias("handoff_key"),
        modifier.alias("handoff_modifier"),
        F.when(c("mode") == "transit", rules.service_name(c("route_name"), c("headsign"), c("to_name")))
        .otherwise(c("to_name"))
        .alias("street_name"),
    )


@query(
    "C29",
    f"""SELECT request_id, pos, CASE WHEN sun_min / (duration_s / 60) >= 0.75 THEN 'shade' WHEN sun_min / (duration_s / 60) >= 0.25 THEN 'mixed' ELSE 'sun' END AS classification
        FROM ({M.ALTERNATIVES}) a""",
)
def c29(t: Tables) -> DataFrame:
    return t.sql(M.ALTERNATIVES).select(
        "request_id", "pos", profile.exposure_class(c("sun_min") / (c("duration_s") / 60)).alias("classification")
    )


_REROUTES = f"""SELECT event_id AS reroute_id, trip_id, lat AS current_lat, lon AS current_lon, CAST(32.069 AS DOUBLE) AS destination_lat,
  lon AS destination_lon, accuracy_m, ts AS depart_at, 'walk' AS mode, 'fastest' AS preference FROM ({M.FIXES}) f WHERE event_type = 'error'"""


@query(
    "C30",
    f"""SELECT reroute_id AS request_id, current_lat AS origin_lat, current_lon AS origin_lon, destination_lat, destination_lon,
               epoch_us(depart_at) AS depart_us, mode, preference, false AS include_comparisons, true AS arrive_by_missing FROM ({_REROUTES}) r""",
)
def c30(t: Tables) -> DataFrame:
    return reroute_requests(t.sql(_REROUTES)).select(
        "request_id", "origin_lat", "origin_lon", "destination_lat", "destination_lon",
        F.unix_micros("depart_at").alias("depart_us"), "mode", "preference", "include_comparisons",
        c("arrive_by").isNull().alias("arrive_by_missing"),
    )


def reroute_requests(reroutes: DataFrame) -> DataFrame:
    """Reroute events as plan requests: the current position is the origin, comparisons off, no arrival target."""
    return reroutes.select(
        c("reroute_id").alias("request_id"),
        c("current_lat").alias("origin_lat"),
        c("current_lon").alias("origin_lon"),
        "destination_lat",
        "destination_lon",
        c("depart_at").cast("timestamp").alias("depart_at"),
        F.lit(None).cast("timestamp").alias("arrive_by"),
        "mode",
        "preference",
        F.lit(False).alias("include_comparisons"),
    )
