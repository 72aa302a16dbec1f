"""What let queries grow faster than their tables: results and plans on small tables of the awkward kind."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.operators import components, spatial as J
from pathloom.operators.rounds import dealt
from pathloom.plans import filters, mapping as M, paths, quality, spatial, transit
from pathloom.plans.registry import Tables
from pathloom.sources import gbfs
from pathloom.streaming import trackers

c = F.col
SMALL = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString() + frame._jdf.queryExecution().executedPlan().toString()


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def tables(spark, folder, **given):
    """A folder with some tables given as rows."""
    for name, frame in given.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, str(folder))


def suppliers(spark, n):
    return spark.range(n).select(c("id").alias("s_suppkey"))


@pytest.mark.parametrize("one", [filters.f5, filters.f7, filters.f11])
def test_streets_are_found_by_equality(spark, one):
    """F14 (F5) and the other queries over streets: no pair of nodes is tried that is not a street."""
    assert "NestedLoop" not in plan_of(one(Tables(spark, SMALL)).select("source"))


def test_streets_by_key_are_the_streets(spark, tmp_path):
    t = tables(spark, tmp_path, supplier=suppliers(spark, 57).filter("s_suppkey <> 31"))
    assert rows(t.sql(M.STREETS_BY_KEY)) == rows(t.sql(M.STREETS))


def test_eligible_nodes_by_equality(spark):
    """F17 (U4): the streets' ends without a nested loop."""
    assert "NestedLoop" not in plan_of(quality.u4(Tables(spark, SMALL)))


def test_vehicles_are_counted_by_spot(spark):
    """F4 (F2): copies of spots on both sides give the counts of all pairs, and no pair of copies is made."""
    centres = spark.createDataFrame([(i, 32.0 + i % 3 / 200, 34.7) for i in range(40)], "centre_id long, lat double, lon double")
    seen = [(i, 32.0 + i % 5 / 250, 34.7 + i % 2 / 100, i % 7 > 0, i % 11 == 0) for i in range(90)]
    vehicles = spark.createDataFrame(seen, "observation_id long, lat double, lon double, available boolean, stale boolean")
    pairs = filters.nearby_vehicles(centres, vehicles)
    assert rows(filters.vehicles_around(centres, vehicles)) == rows(pairs.groupBy("centre_id").agg(F.count("*"), F.sum("observation_id")))
    assert plan_of(filters.vehicles_around(centres, vehicles)).count("Aggregate") > 2


def test_features_are_counted_by_outline(spark):
    """F15 (J3): equal boxes and equal outlines give the counts of all pairs."""
    boxes = spark.createDataFrame([(i, i % 4 / 100, 0.0, i % 4 / 100 + 0.012, 0.01) for i in range(30)], "trip_id long, south double, west double, north double, east double")
    outlines = spark.createDataFrame(
        [(i, i % 6 / 125, 0.001, i % 6 / 125 + 0.004, 0.002) for i in range(50)], "osm_id long, r_south double, r_west double, r_north double, r_east double"
    )
    pairs = J.box_pairs(boxes, outlines, 0.005).groupBy("trip_id").agg(F.count("*"), F.sum("osm_id"))
    assert rows(spatial.features_around(boxes, outlines, 0.005)) == rows(pairs)


def test_feeds_are_judged_by_their_own_instant(spark):
    """F16 (S7): staleness is judged at the instant a document was read, which differs from document to document."""
    body = '{"last_updated":%d,"data":{"bikes":[{"bike_id":"1","lat":"1","lon":"2"}]}}'
    read = spark.createDataFrame([(i, body % (1000 + i * 5000), 1000 + i * 5000 + (60 if i % 2 else 300)) for i in range(4)], "feed long, payload string, read_s long")
    read = read.withColumn("as_of", F.timestamp_seconds("read_s"))
    types = spark.createDataFrame([], "feed long, vehicle_type_id string, kind string")
    found = gbfs.parse_status(read, "feed", "payload", types, c("as_of"))
    assert rows(found.select("feed", "stale")) == [(0, True), (1, False), (2, True), (3, False)]


def test_a_task_is_dealt_a_bounded_share(spark):
    """partitions follow the rows, and grouping by the key shuffles no further."""
    frame = spark.range(1000).withColumnRenamed("id", "k")
    parts = dealt(frame, "k", rows=50)
    assert parts.rdd.getNumPartitions() == 21
    assert plan_of(parts.groupBy("k").count()).count("Exchange hashpartitioning") == 1
    assert dealt(frame, "k").rdd.getNumPartitions() == 4


def test_profiles_are_built_by_several_tasks(spark, monkeypatch):
    """F21 (G14): places of one partition are dealt out before they become a row per bin."""
    monkeypatch.setattr(paths, "PLACES_PER_TASK", 3)
    places = spark.range(30).coalesce(1).select(c("id").alias("street_id"), F.lit(32.0).alias("lat"), F.lit(34.7).alias("lon"), F.array(F.lit(10.0)).alias("horizon"))
    built = paths.shade_profiles(places, 1718917200)
    assert "REPARTITION_BY_NUM" in plan_of(built) and "hashpartitioning(street_id" in plan_of(built)
    assert {tuple(r.shade_profile) for r in built.collect()} == {tuple(paths.shade_profiles(places.limit(1), 1718917200).first().shade_profile)}


def routes(spark, n):
    """Routes over three lines."""
    cells = [(trip, i, 32.05 + i / 1000, 34.75 + trip % 3 / 1000) for trip in range(n) for i in range(5)]
    return spark.createDataFrame(cells, "trip_id long, idx long, lat double, lon double")


def test_routes_of_one_line_are_looked_up_once(spark):
    """F13 (J4): a line with copies gives the buildings of all its routes."""
    vertices, built = routes(spark, 30), spatial.buildings(Tables(spark, SMALL))
    one = rows(J.twins(vertices, "trip_id"))
    assert one == sorted(((t, t % 3) for t in range(30)), key=repr)
    pairs = J.buildings_in_corridor(vertices, built, "trip_id").groupBy("trip_id").agg(F.count("*"), F.sum("osm_id"))
    assert rows(spatial.buildings_along(vertices, built)) == rows(pairs)


def test_equal_routes_are_sampled_once(spark, monkeypatch):
    """F25 (J6): the shade of a route is that of its line at its time of day; three lines at four times are sampled."""
    vertices, built = routes(spark, 48), spatial.buildings(Tables(spark, SMALL))
    whole = J.route_shade(J.segment_shade(spatial.shade_of_routes(vertices, built)[0], ["trip_id"]), ["trip_id"])
    whole = whole.select("trip_id", F.round("shade_fraction", 6), F.round("high_fraction", 6))
    sampled = []
    plain = spatial.shade_of_routes
    monkeypatch.setattr(spatial, "shade_of_routes", lambda v, b: (sampled.append(v.select("trip_id").distinct().count()), plain(v, b))[1])
    assert rows(spatial.shade_along(vertices, built)) == rows(whole)
    assert sampled == [12]


def test_walks_to_stops_carry_no_profiles(spark, monkeypatch):
    """F1 (F12): the searches' edges hold no daily profile."""
    seen = []

    class Stop(Exception):
        pass

    def search(searches, edges, cost):
        seen.append(edges.agg(F.max(F.size("shade_profile"))).first()[0])
        raise Stop

    monkeypatch.setattr(paths.P, "least_cost_labels", search)
    with pytest.raises(Stop):
        transit.access_walks(Tables(spark, SMALL))
    assert seen == [0]


def test_places_are_projected_once(spark, monkeypatch):
    """F22 (G13): copies of a place are clustered as one, and every copy is a member."""
    seen, plain = [], components.connected_components

    def watched(nodes, links):
        seen.append((nodes.count(), plan_of(nodes).count("atan")))
        return plain(nodes, links)

    monkeypatch.setattr(components, "connected_components", watched)
    signals = spark.createDataFrame([(i, 32.0 + i % 4 * 0.0001, 34.7 + i % 2 * 0.01) for i in range(40)], "osm_id long, lat double, lon double")
    members = components.cluster_signals(signals)
    assert rows(members.select("osm_id", "cluster")) == sorted(((i, i % 2) for i in range(40)), key=repr)
    assert members.select("x", "y").distinct().count() == 4
    # the nodes come from a kept table: nothing projects the signals again
    assert seen == [(4, 0)]
    assert "SIN(" not in plan_of(members)


def test_trips_are_matched_together():
    """F20 (T2): the fixes of a batch's trips are matched step by step for all trips at once, with each trip's own results."""
    rng = random.Random(4)
    batches, trips = [], {}
    cells = []
    for trip in range(40):
        n = rng.choice([1, 2, 5, 20, 33])
        route = [(32.05 + i * 0.001 + rng.gauss(0, 1e-4), 34.75 + rng.gauss(0, 1e-4)) for i in range(n)]
        fixes = [
            (*((math.nan, math.nan) if rng.random() < 0.05 else (32.05 + k * 0.0007, 34.75 + rng.choice([0, 0, 0.01]))),
             rng.choice([3.0, 25.0, math.nan]), rng.choice([math.nan, 10.0, 350.0]), rng.choice([math.nan, 1.4, -1.0]))
            for k in range(rng.choice([0, 1, 4, 30]))
        ]
        trips[trip] = (route, fixes)
        cells += [(trip, 0, -1, *p, math.nan, math.nan, math.nan) for p in route]
        cells += [(trip, 1, 100 * trip + k, *f) for k, f in enumerate(fixes)]
    names = ["trip_id", "is_fix", "fix_id", "lat", "lon", "accuracy_m", "heading", "speed"]
    while cells:
        n = rng.choice([1, 3, 17, 90])
        batches.append(pd.DataFrame(cells[:n], columns=names))
        cells = cells[n:]
    want = []
    for trip, (route, fixes) in trips.items():
        if len(route) > 1:
            alone = trackers.Matcher(trackers.Route(*np.array(route).T))
            want += [(trip, 100 * trip + k, *alone.update((*f[:3], trackers._number(f[3]), trackers._number(f[4])))) for k, f in enumerate(fixes)]
    got = [tuple(r) for out in trackers._follow("matcher")(iter(batches)) for r in out.itertuples(index=False)]
    assert len(got) == len(want) > 100
    for a, b in zip(got, want):
        assert a == pytest.approx(b, nan_ok=True, rel=1e-12)
    # a hundred trips take as many steps as one
    together, plain = [], trackers._metres
    one = (trackers.Route(np.linspace(32, 32.02, 20), np.full(20, 34.7)), np.array([[32.001, 34.7, 5.0, 10.0, 1.4]] * 10))
    for many in (1, 100):
        seen = []
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(trackers, "_metres", lambda *a, seen=seen: (seen.append(1), plain(*a))[1])
            trackers._match_together([(trackers.Matcher(one[0]), one[1]) for _ in range(many)])
        together.append(len(seen))
    assert together[0] == together[1]


def test_walks_start_near_stops_only(spark, tmp_path, monkeypatch):
    """F6 (F12): no search starts, and no street is searched, farther from every stop than the radius; the walks are those
    of searches from all origins along all streets."""
    monkeypatch.setattr(transit.K, "MAX_ACCESS_M", 700.0)
    customers = spark.range(120).select(c("id").alias("c_custkey")).union(spark.createDataFrame([(None,), (7,)], "c_custkey long"))
    t = tables(spark, tmp_path, supplier=suppliers(spark, 120), customer=customers, nation=spark.range(2).select(c("id").cast("int").alias("n_nationkey")))
    seen, plain = [], transit.P.least_cost_labels

    def watched(searches, edges, cost):
        seen.append((searches.agg(F.max("source")).first()[0], edges.agg(F.max("source")).first()[0]))
        return plain(searches, edges, cost)

    monkeypatch.setattr(transit.P, "least_cost_labels", watched)
    found = transit.access_walks(t)
    origins = t.sql(transit._REQUESTS).select("access_mode", c("origin").alias("source"))
    whole = transit._reached(transit._street_searches(origins, 700.0), paths.graph(t, False))
    stops = transit.stop_times(t).select(c("stop_id").alias("node")).distinct()
    assert rows(found) == rows(whole.join(stops, "node").select("access_mode", "source", "node", "duration_s", "distance_m")) != []
    assert max(seen[0]) < 75 and seen[1] == (119, 119)


def test_late_labels_are_not_followed(spark, monkeypatch):
    """F2 (G11): leads with too little time for a walk are not planned, labels that come too late are dropped, and the
    answers are those of planning every lead."""
    from pathloom.operators import schedule as S

    hop = "trip_id long, trip_no long, first_s double, headway_s double, allowed array<string>"
    trips = spark.createDataFrame([(1, 1, 21600.0, 600.0, []), (2, 2, 21900.0, 900.0, [])], hop)
    times = spark.createDataFrame([(t, k, 10 * t + k if k < 4 else 5, 300.0 * k, 300.0 * k + 30) for t in (1, 2) for k in range(5)], "trip_id long, stop_seq int, stop_id long, arr_off_s double, dep_off_s double")
    steps = [("walk", a, b, 60.0 * abs(a - b) + 240, 80.0 * abs(a - b)) for a in (10, 11, 13, 20, 22, 23, 5) for b in (10, 12, 13, 14, 20, 23, 30, 900)]
    walks = spark.createDataFrame(steps, "access_mode string, from_node long, to_node long, duration_s double, distance_m double")
    asked = [(i, "walk", "none", (10, 20, 13, 77)[i % 4], (13, 23, 12, 30, 900, 78)[i % 6], 30000.0 + 977 * i) for i in range(24)]
    asked = spark.createDataFrame(asked, "request_id long, access_mode string, vehicle string, origin long, destination long, target_s double")
    leads = asked.withColumn("lead_min", F.explode(F.sequence(F.lit(5), F.lit(240), F.lit(5))))
    trials = leads.withColumns({"depart_s": c("target_s") - c("lead_min") * 60, "request_id": F.struct("request_id", "lead_min", "target_s")})
    every = S.plan(trials.drop("lead_min", "target_s"), walks, trips, times).filter(c("final_s") <= c("request_id.target_s"))
    in_time = every.select("request_id.request_id", "request_id.lead_min", "stop_id", "n_rides", "final_s").toPandas()
    best = in_time[in_time.lead_min == in_time.groupby("request_id").lead_min.transform("min")]
    late, plain = [], S.scan_round

    def watched(labels, *tables):
        late.append(labels.filter(c("arrival_s") > c("request_id.until_s")).count())
        return plain(labels, *tables)

    monkeypatch.setattr(S, "scan_round", watched)
    got = S.arrive_by(asked, walks, trips, times).select("request_id", "lead_min", "stop_id", "n_rides", "final_s").collect()
    assert sorted(map(tuple, got)) == sorted(best[["request_id", "lead_min", "stop_id", "n_rides", "final_s"]].itertuples(index=False, name=None)) != []
    assert late and not any(late)


def test_places_that_share_a_key_have_a_profile_each(spark):
    """F8 (G14): a profile has one value per bin, for copies of a place too, and no place of a key is left out."""
    places = [(1, 32.0, 34.7, [10.0]), (1, 32.0, 34.7, [10.0]), (1, 32.0, 34.7, [50.0]), (1, -60.0, 34.7, [10.0]), (None, 32.0, 34.7, []), (2, 32.0, 34.7, [10.0])]
    frame = spark.createDataFrame(places, "street_id long, lat double, lon double, horizon array<double>")
    built = [tuple(r) for r in paths.shade_profiles(frame, 1718917200).collect()]
    assert sorted((k is None, k, len(p)) for k, p in built if k) == [(False, 1, 288)] * 3 + [(False, 2, 288)] and len(built) == 5
    one = {tuple(p) for k, p in built if k == 1}
    assert len(one) == 3 and {tuple(p) for k, p in built if k == 2} < one
