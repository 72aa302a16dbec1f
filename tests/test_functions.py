"""Column functions against pinned values and plain-Python brute force."""

import math
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.functions import geo, profile, rules, solar, text
from pathloom.operators import polyline as P

c = F.col


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_horizon_interpolates_azimuth(spark):
    horizon = F.array(*[F.lit(float(v)) for v in (10, 20, 30, 40)])
    row = one(
        spark, profile.obstruction_at(horizon, F.lit(45.0)), *[profile.sun_visible(horizon, F.lit(45.0), F.lit(e)) for e in (16.0, 14.0, -1.0)]
    )
    assert row[0] == pytest.approx(15)
    assert list(row[1:]) == [True, False, False]


def test_daily_profile_halfway_between_bins_and_empty(spark):
    bins = F.transform(F.sequence(F.lit(0), F.lit(287)), lambda i: F.when(i == 144, 1.0).otherwise(0.0))
    at = F.lit(12 * 3600 + 2 * 60 + 30.0)
    row = one(spark, profile.daily_value(bins, at), profile.daily_value(F.array().cast("array<double>"), at))
    assert row[0] == pytest.approx(0.5)
    assert row[1] == 0.0


def test_local_seconds_follow_the_zone(spark):
    summer = F.lit("2026-08-02 09:02:30").cast("timestamp")
    winter = F.lit("2024-01-01 09:00:00").cast("timestamp")
    row = one(spark, profile.local_seconds(summer), profile.local_seconds(winter))
    assert row[0] == 12 * 3600 + 150 and row[1] == 11 * 3600


def test_missing_coordinate_gives_missing_distance(spark):
    assert one(spark, geo.haversine_m(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0)))[0] is None


def test_grid_distances_are_metric(spark):
    a = geo.to_grid(F.lit(32.07), F.lit(34.78))
    b = geo.to_grid(F.lit(32.08), F.lit(34.79))
    row = one(spark, F.hypot(a[0] - b[0], a[1] - b[1]), geo.haversine_m(32.07, 34.78, 32.08, 34.79))
    assert row[0] == pytest.approx(row[1], rel=3e-3)


def test_sun_over_tel_aviv_at_noon(spark):
    frame = spark.createDataFrame([(1780909200.0, 32.0853, 34.7818)], "t double, lat double, lon double")
    row = solar.with_solar_position(frame, c("t"), c("lat"), c("lon")).first()
    assert 0 <= row.azimuth <= 360 and 70 < row.elevation < 85


def test_text_folding_matches_python(spark):
    words = ["Café Ünter", "STRASSE ß", "כִּיכָּר", "ﬁne", "plain", ""]
    frame = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.fold_text("w").alias("f"))
    for row in frame.collect():
        folded = unicodedata.normalize("NFKD", row.w).casefold()
        assert row.f == "".join(ch for ch in folded if not unicodedata.combining(ch))


def test_display_text_and_battery(spark):
    row = one(
        spark, text.display_text(F.lit("a_b")), text.display_text(F.lit(" _ "), "Origin"),
        *[rules.battery_percent(F.lit(v)) for v in ("1", "1.0", "0.5", "83", "83.7")],
    )
    assert list(row) == ["a · b", "Origin", 1, 100, 50, 83, 83]


def test_next_departure_rules(spark):
    first, headway = F.lit(19800), F.lit(600)
    row = one(spark, *[rules.next_departure(F.lit(a), first, headway) for a in (0, 19800, 19801, 84600, 84601)])
    assert list(row) == [19800.0, 19800.0, 20400.0, 84600.0, None]


def test_dimension_limits(spark):
    def allowed(vehicle, limit):
        return rules.dimension_allowed(F.lit(vehicle).cast("double"), F.lit(limit).cast("double"))

    assert list(one(spark, allowed(3, 2), allowed(2, 3), allowed(None, 1), allowed(3, None), allowed(3, 0))) == [False, True, True, True, True]


def encode(points, precision=6):
    """Plain-Python reference of the published algorithm."""
    out, before = "", (0, 0)
    for point in points:
        now = tuple(round(v * 10**precision) for v in point)
        for d in (now[0] - before[0], now[1] - before[1]):
            z = 2 * d if d >= 0 else -2 * d - 1
            while z > 31:
                out += chr((z % 32) + 95)
                z //= 32
            out += chr(z + 63)
        before = now
    return out


points = st.lists(st.tuples(st.floats(-90, 90), st.floats(-180, 180)), min_size=1, max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(points, min_size=1, max_size=12))
def test_polylines_round_trip(spark, routes):
    rows = [(r, i, *p) for r, route in enumerate(routes) for i, p in enumerate(route)]
    vertices = spark.createDataFrame(rows, "route long, idx long, lat double, lon double")
    encoded = P.encode_polylines(vertices, ["route"])
    assert {r.route: r.polyline for r in encoded.collect()} == {r: encode(route) for r, route in enumerate(routes)}
    back = {(r.route, r.idx): (r.lat, r.lon) for r in P.decode_polylines(encoded, ["route"]).collect()}
    assert len(back) == len(rows)
    for r, i, lat, lon in rows:
        assert abs(back[r, i][0] - lat) <= 5.1e-7 and abs(back[r, i][1] - lon) <= 5.1e-7


def test_known_polyline(spark):
    frame = spark.createDataFrame([(1, "_p~iF~ps|U_ulLnnqC_mqNvxq`@")], "id long, polyline string")
    found = sorted((r.idx, r.lat, r.lon) for r in P.decode_polylines(frame, ["id"], precision=5).collect())
    assert found == [(0, 38.5, -120.2), (1, 40.7, -120.95), (2, 43.252, -126.453)]


def test_long_routes_cross_chunk_borders(spark):
    """Neighbours and prefix sums must not notice the chunks a route is cut into."""
    n = 10_000
    frame = spark.range(n).select(F.lit(1).alias("route"), c("id").alias("idx"), (c("id") * 1e-5).alias("lat"), F.lit(34.0).alias("lon"))
    along = P.cumulative_distances(frame, ["route"])
    last = along.filter(c("idx") == n - 1).first().along_m
    assert last == pytest.approx(math.radians((n - 1) * 1e-5) * 6_371_008.8, rel=1e-6)
    assert along.count() == n
