"""Jobs on hand-built inputs: graph, schedule, feeds, bundles, spatial joins, trackers, streams."""

import math
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import paths as P
from pathloom.operators import schedule as S
from pathloom.operators import spatial as J
from pathloom.operators.components import cluster_signals, connected_components
from pathloom.operators.scan import previous_row
from pathloom.sources import gtfs, manifest
from pathloom.streaming import events as E
from pathloom.streaming import trackers as T

c = F.col
EDGE = (
    "edge_id long, source long, target long, distance_m double, side string, modes array<string>, crossing_kind string,"
    " crossing_confidence string, signal_id string, comfort double, shade_profile array<double>, max_height_m double,"
    " max_width_m double, max_weight_t double"
)
SEARCH = (
    "search_id long, source long, goal long, mode string, speed double, departure_s double, allow_low boolean, height_m double,"
    " width_m double, weight_t double, max_distance_m double, factor double"
)


def edge(number, source, target, distance, side=None, crossing=None, confidence="high", shade=(0.0,)):
    return (number, source, target, float(distance), side, ["walk", "car"], crossing, confidence, None, 0.5, list(shade), None, None, None)


def search(number, source, goal, mode="walk", departure=0.0, factor=0.0, limit=None, low=False):
    return (number, source, goal, mode, 1.0, departure, low, None, None, None, limit, factor)


def solve(spark, edges, searches, cost=P.duration_cost):
    table = spark.createDataFrame(searches, SEARCH)
    labels = P.least_cost_labels(table, spark.createDataFrame(edges, EDGE), cost)
    path = {}
    for r in sorted(P.path_edges(labels, table).collect(), key=lambda r: r.seq):
        path.setdefault(r.search_id, []).append(r.edge_id)
    return path, {r.search_id: r for r in P.reached_goals(labels, table).collect()}


def test_side_of_street(spark):
    blocked = [edge(1, 0, 1, 1, "left"), edge(2, 1, 2, 1, "right"), edge(3, 1, 2, 10, "left")]
    assert solve(spark, blocked, [search(1, 0, 2)])[0] == {1: [1, 3]}
    crossing = [edge(1, 0, 1, 1, "left"), edge(2, 1, 2, 1, crossing="marked"), edge(3, 2, 3, 1, "right")]
    assert solve(spark, crossing, [search(1, 0, 3)])[0] == {1: [1, 2, 3]}


def test_crossings_limits_and_unreachable(spark):
    edges = [edge(1, 0, 1, 5, crossing="marked", confidence="low"), edge(2, 0, 2, 4), edge(3, 2, 1, 4), edge(4, 1, 3, 100)]
    path, found = solve(
        spark, edges, [search(1, 0, 1), search(2, 0, 1, low=True), search(3, 0, 3, limit=50.0), search(4, 3, 0), search(5, 1, 1)]
    )
    assert path == {1: [2, 3], 2: [1]}
    assert set(found) == {1, 2, 5} and found[5].cost == 0


def settle(edges, one):
    """Label-setting search in plain Python."""
    import heapq

    _, source, goal, mode, speed, departure, low, *_, factor = one
    best, heap = {}, [(0.0, 0, source, "center", 0.0, 0.0)]
    while heap:
        cost, _, node, side, elapsed, sun = heapq.heappop(heap)
        if (node, side) in best:
            continue
        best[node, side] = (cost, sun)
        if node == goal:
            return cost, sun
        for e in edges:
            if e[1] != node or (e[6] and e[7] == "low" and not low):
                continue
            bound = e[4] if e[4] in ("left", "right") else None
            if mode != "walk" or e[6]:
                after = "center"
            elif bound is None:
                after = side
            elif side in ("left", "right") and side != bound:
                continue
            else:
                after = bound
            profile = e[10]
            at = (departure + elapsed) % 86400 / 86400 * len(profile)
            left = math.floor(at) % len(profile)
            shade = profile[left] * (1 - (at - math.floor(at))) + profile[(left + 1) % len(profile)] * (at - math.floor(at))
            duration = e[3] / speed
            exposed = duration * (1 - max(0.0, min(1.0, shade)))
            heapq.heappush(heap, (cost + duration + factor * exposed, e[0], e[2], after, elapsed + duration, sun + exposed))
    return None


def test_time_dependent_costs_match_label_setting(spark):
    """Sun penalties make edges non-FIFO; the rounds must still give what one label at a time gives."""
    rng = random.Random(7)
    edges = [
        edge(i, rng.randrange(14), rng.randrange(14), rng.uniform(600, 9000), rng.choice([None, None, "left", "right"]),
             rng.choice([None, None, None, "marked"]), rng.choice(["high", "high", "low"]), [rng.random() for _ in range(24)])
        for i in range(60)
    ]
    searches = [search(i, rng.randrange(14), rng.randrange(14), departure=rng.uniform(0, 86400), factor=rng.choice([0.5, 4.0, 16.0])) for i in range(40)]
    _, found = solve(spark, edges, searches, P.shade_cost)
    for one in searches:
        expected = settle(edges, one)
        if expected is None:
            assert one[0] not in found
        else:
            assert found[one[0]].cost == pytest.approx(expected[0], abs=1e-6)
            assert found[one[0]].sun_s == pytest.approx(expected[1], abs=1e-6)


def walk_from(edges, source, speed=1.35):
    """Least (duration, distance) from the middle of a node to every node, walking."""
    import heapq

    best, heap = {}, [(0.0, source, "center")]
    while heap:
        metres, node, side = heapq.heappop(heap)
        if (node, side) in best:
            continue
        best[node, side] = metres
        for e in edges:
            if e[1] != node or (e[6] and e[7] == "low"):
                continue
            if e[4] and not e[6] and side in ("left", "right") and side != e[4]:
                continue
            heapq.heappush(heap, (metres + e[3], e[2], "center" if e[6] else e[4] or side))
    out = {}
    for (node, _), metres in best.items():
        out[node] = min(out.get(node, math.inf), metres)
    return {node: (metres / speed, metres) for node, metres in out.items()}


def test_egress_by_search_back_from_destinations(spark):
    """Itineraries are those of all walks between stops and nodes, with walks to the asked destinations only."""
    from pathloom import constants as K
    from pathloom.plans.transit import egress_search

    rng = random.Random(21)
    edges = [
        edge(i, rng.randrange(18), rng.randrange(18), rng.uniform(900, 2500), rng.choice([None, None, "left", "right"]),
             rng.choice([None, None, None, "marked"]), rng.choice(["high", "high", "low"]))
        for i in range(45)
    ]
    stops = list(range(0, 18, 2))
    all_walks = [("walk", a, b, *v) for a in range(18) for b, v in walk_from(edges, a).items()]
    walks = spark.createDataFrame(all_walks, "access_mode string, from_node long, to_node long, duration_s double, distance_m double")
    trips = spark.createDataFrame([(i, i, 19800.0 + 70 * i, 600.0 + 60 * i, []) for i in range(6)], "trip_id long, trip_no long, first_s double, headway_s double, allowed array<string>")
    ride = [(i, k, rng.choice(stops), 200.0 * k, 200.0 * k + 20) for i in range(6) for k in range(4)]
    times = spark.createDataFrame(ride, "trip_id long, stop_seq int, stop_id long, arr_off_s double, dep_off_s double")
    asked = [(i, rng.randrange(18), rng.randrange(18) if i % 9 else 99, "walk", "none", 25000.0 + 61 * i) for i in range(40)]
    requests = spark.createDataFrame(asked, "request_id long, origin long, destination long, access_mode string, vehicle string, depart_s double")
    search_back = egress_search(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(x,) for x in stops], "stop_id long"))
    seen = []

    def watched(destinations, radius):
        found = search_back(destinations, radius)
        seen.append((radius, {r.destination for r in destinations.collect()}, found.collect()))
        return found

    near = walks.filter(c("to_node").isin(stops))
    want = S.plan(requests, walks, trips, times)
    got = S.plan(requests, near, trips, times, egress=watched)
    columns = ("request_id", "rank", "stop_id", "n_rides", F.round("final_s", 3).alias("final_s"))
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())
    assert seen[0][0] == K.MAX_ACCESS_M and len(seen) > 1 and seen[-1][1] < seen[0][1]
    for radius, destinations, found in seen:
        pairs = {(r.from_node, r.to_node): r.distance_m for r in found}
        true = {(a, b): v[1] for _, a, b, *v in all_walks if b in destinations and (a in stops or a == b) and v[1] <= radius}
        assert pairs.keys() - {(99, 99)} == true.keys() and all(pairs[k] == pytest.approx(true[k]) for k in true)


PLACED = EDGE + ", lat1 double, lon1 double, lat2 double, lon2 double"


def grid_edges(side, seed):
    """A street grid with bent lengths, one-sided streets and crossings."""
    rng = random.Random(seed)
    at = {(x, y): (32.0 + y * 0.001 + rng.uniform(-2e-4, 2e-4), 34.7 + x * 0.001 + rng.uniform(-2e-4, 2e-4)) for x in range(side) for y in range(side)}
    out = []
    for (x, y), a in at.items():
        for other in ((x + 1, y), (x, y + 1)):
            if other in at:
                b = at[other]
                metres = math.hypot((a[0] - b[0]) * 111_195, (a[1] - b[1]) * 111_195 * math.cos(math.radians(32.05))) * rng.uniform(1.05, 1.3)
                for n, (u, v, p, q) in enumerate((((x, y), other, a, b), (other, (x, y), b, a))):
                    base = edge(len(out), u[0] * side + u[1], v[0] * side + v[1], metres, rng.choice([None, None, None, "left", "right"]),
                                rng.choice([None, "marked"]), "high", [rng.random() for _ in range(6)])
                    out.append((*base, *p, *q))
    return out


def flood(edges, one):
    """(cost, settled labels) of a label-setting search without any bound."""
    import heapq

    _, source, goal, _, _, departure, _, *_, factor = one
    after, best, heap = {}, {}, [(0.0, source, "center", 0.0)]
    for e in edges:
        after.setdefault(e[1], []).append(e)
    while heap:
        cost, node, side, elapsed = heapq.heappop(heap)
        if (node, side) in best:
            continue
        best[node, side] = cost
        if node == goal:
            return cost, len(best)
        for e in after.get(node, ()):
            if not e[6] and e[4] and side in ("left", "right") and side != e[4]:
                continue
            at = (departure + elapsed) % 86400 / 86400 * 6
            left = math.floor(at) % 6
            shade = e[10][left] * (1 - (at - math.floor(at))) + e[10][(left + 1) % 6] * (at - math.floor(at))
            heapq.heappush(heap, (cost + e[3] + factor * e[3] * (1 - shade), e[2], "center" if e[6] else e[4] or side, elapsed + e[3]))
    return None, len(best)


@pytest.mark.parametrize("with_landmarks", [False, True])
def test_goal_directed_search_settles_less(spark, monkeypatch, with_landmarks):
    """Costs of plain label-setting, also where costs depend on the time; fewer labels, and spread over tasks."""
    monkeypatch.setattr(P, "GUIDE_FROM", 30)
    side = 6 if with_landmarks else 11
    rows = grid_edges(side, 5)
    edges = spark.createDataFrame(rows, PLACED)
    ends = [(side * 2 + 2, side * 4 + 3), (side * 3 + 3, side * 3 + 5)] if with_landmarks else [(side * 4 + 4, side * 6 + 6), (side * 5 + 5, side * 5 + 9)]
    searches = [search(i, *ends[i % 2], factor=0.0 if i < 2 else 1.5, departure=i * 9000.0) for i in range(4)]
    table = spark.createDataFrame(searches, SEARCH)
    marks = P.landmark_distances(edges) if with_landmarks else None
    labels = P.least_cost_labels(table, edges, P.shade_cost, guide=P.sunny_cost, landmarks=marks)
    found = {r.search_id: r.cost for r in P.reached_goals(labels, table).collect()}
    settled = {r.search_id: r.n for r in P.settled_per_search(labels).collect()}
    for one in searches:
        cost, n = flood(rows, one)
        assert found[one[0]] == pytest.approx(cost, abs=1e-6)
        assert settled[one[0]] <= n
        if one[0] < 2:  # costs that don't change with time
            assert settled[one[0]] <= n / 2


def test_schedule_search(spark):
    """The small schedule: a folding bike rides both trips, a full-size one none; arrival targets are met."""
    trips = spark.createDataFrame(
        [(1, 1, 19800.0, 600.0, ["folding_bike", "personal_scooter"]), (2, 2, 20100.0, 900.0, ["folding_bike", "personal_scooter"])],
        "trip_id long, trip_no long, first_s double, headway_s double, allowed array<string>",
    )
    times = spark.createDataFrame(
        [(1, 0, 1, 0.0, 0.0), (1, 1, 2, 360.0, 390.0), (1, 2, 3, 840.0, 840.0), (2, 0, 3, 0.0, 0.0), (2, 1, 4, 480.0, 480.0)],
        "trip_id long, stop_seq int, stop_id long, arr_off_s double, dep_off_s double",
    )
    walks = spark.createDataFrame(
        [("bike", 1, 1, 0.0, 0.0), ("bike", 1, 2, 300.0, 1200.0), ("bike", 4, 4, 0.0, 0.0), ("bike", 3, 4, 900.0, 3000.0)],
        "access_mode string, from_node long, to_node long, duration_s double, distance_m double",
    )
    asked = spark.createDataFrame(
        [(1, 1, 4, "bike", "folding_bike", 28800.0), (2, 1, 4, "bike", "full_size_bike", 28800.0)],
        "request_id long, origin long, destination long, access_mode string, vehicle string, depart_s double",
    )
    found = S.plan(asked, walks, trips, times).collect()
    assert {r.request_id for r in found} == {1}
    best = min(found, key=lambda r: r["rank"])
    assert best.final_s == 30480.0 and best.n_rides == 1 or best.n_rides == 2
    # 08:00 run reaches stop 3 at 08:14; next run of trip 2 is 08:20, arriving 08:28; biking from stop 3 takes until 08:29
    assert best.final_s == 28800 + 28 * 60
    targets = asked.drop("depart_s").withColumn("target_s", F.lit(9.5 * 3600))
    late = S.arrive_by(targets, walks, trips, times).collect()
    assert late and all(r.final_s <= 9.5 * 3600 for r in late) and {r.request_id for r in late} == {1}


def feed(directory, **changes):
    files = {
        "stops.txt": "﻿stop_id,stop_name,stop_lat,stop_lon\na,A,32.07,34.78\nb,B,32.08,34.79\n",
        "routes.txt": "route_id,route_short_name\nr,1\n",
        "trips.txt": "route_id,service_id,trip_id\nr,s,t\n",
        "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,08:00:00,08:00:00,a,1\nt,08:05:00,08:05:00,b,2\n",
        "calendar_dates.txt": "service_id,date,exception_type\ns,20260802,1\n",
        **changes,
    }
    for name, text in files.items():
        if text is not None:
            with open(os.path.join(directory, name), "w", encoding="utf-8") as handle:
                handle.write(text)


def test_feed_validation(spark):
    with tempfile.TemporaryDirectory() as directory:
        feed(directory)
        findings, counts = gtfs.validate_directory(spark, directory)
        assert [r.rule for r in findings.filter("severity = 'error'").collect()] == []
        assert {r.table_name: r.rows for r in counts.collect()} == {"stops.txt": 2, "routes.txt": 1, "trips.txt": 1, "stop_times.txt": 2}
    with tempfile.TemporaryDirectory() as directory:
        feed(directory, **{"stop_times.txt": "trip_id,stop_id,stop_sequence\nt,a,1\nt,missing,1\nt,b,x\n", "calendar_dates.txt": None})
        findings, _ = gtfs.validate_directory(spark, directory)
        messages = {r.message for r in findings.collect()}
        assert "stop_times.txt:3 references missing stop_id=missing in stops.txt" in messages
        assert "stop_times.txt:3 stop_sequence is not increasing" in messages
        assert "stop_times.txt:4 has an invalid stop_sequence" in messages
        assert "GTFS has neither calendar.txt nor calendar_dates.txt" in messages
    with tempfile.TemporaryDirectory() as directory:
        feed(directory, **{"trips.txt": None})
        findings, counts = gtfs.validate_directory(spark, directory)
        assert [r.message for r in findings.collect()] == ["Missing required GTFS files: trips.txt"] and counts is None


def test_bundle_tampering(spark):
    with tempfile.TemporaryDirectory() as directory:
        for name in ("street_graph", "places", "transit", "shade_profiles"):
            with open(os.path.join(directory, name), "w") as handle:
                handle.write(name)
        files = manifest.scan_files(spark, directory).withColumn("logical_name", c("path")).withColumn("media_type", F.lit("text/plain"))
        built = manifest.build_manifest(files, "b", "c", {"osm": "1"}, ["x", "x"], "2026-01-01 00:00:00").cache()
        assert built.first().attribution == ["x"]
        assert manifest.validate_bundle(built, manifest.scan_files(spark, directory)).count() == 0
        with open(os.path.join(directory, "places"), "w") as handle:
            handle.write("PLACES")
        assert [r.message for r in manifest.validate_bundle(built, manifest.scan_files(spark, directory)).collect()] == ["Checksum mismatch: places"]


def test_nearest_with_a_hot_spot(spark):
    """A third of the points at one coordinate, copies among the targets, far points beyond all fine cells."""
    rng = random.Random(3)
    targets = [(i, 32 + rng.random() / 10, 34 + rng.random() / 10) for i in range(60)] + [(100 + i, 32.05, 34.05) for i in range(20)]
    points = [(i, 32.05, 34.0501) for i in range(60)] + [(60 + i, 31 + rng.random() * 3, 33 + rng.random() * 3) for i in range(60)]
    found = J.nearest(
        spark.createDataFrame(points, "p long, lat double, lon double"), spark.createDataFrame(targets, "t long, lat double, lon double"), "p", "t"
    ).collect()

    def metres(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return round(2 * 6_371_008.8 * math.asin(math.sqrt(h)), 6)

    expected = {p[0]: min((metres(p, t), t[0]) for t in targets) for p in points}
    assert {r.p: r.t for r in found} == {p: t for p, (_, t) in expected.items()}


@pytest.mark.parametrize("by", [[], ["mode"]])
def test_outliers_and_a_dense_city_go_down_the_tree(spark, monkeypatch, by):
    """Far points around the globe, also across its seam and near its poles; targets packed in one place, few elsewhere."""
    from pathloom.operators import tree

    monkeypatch.setattr(tree, "LEAF", 8)
    rng = random.Random(17)
    modes = ["walk", "car"]
    targets = [(i, rng.choice(modes), 32 + rng.gauss(0, 0.003), 34 + rng.gauss(0, 0.003)) for i in range(1500)]
    targets += [(2000 + i, rng.choice(modes), rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(40)]
    targets += [(3000, "walk", 10.0, 179.95), (3001, "car", 10.0, -179.95), (3002, "walk", 89.9, 0.0)]
    points = [(i, rng.choice(modes), rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(60)]
    points += [(100, "car", 10.0, 179.0), (101, "walk", 10.0, -179.0), (102, "walk", 88.0, 179.0), (103, "bus", 1.0, 1.0)] + [(200 + i, "walk", 20.0, 20.0) for i in range(30)]
    found = J.nearest(
        spark.createDataFrame(points, "p long, mode string, lat double, lon double"), spark.createDataFrame(targets, "t long, mode string, lat double, lon double"), "p", "t", by=by
    )

    def metres(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return round(2 * 6_371_008.8 * math.asin(min(1.0, math.sqrt(h))), 6)

    expected = {p[0]: min(((metres(p, t), t[0]) for t in targets if not by or t[1] == p[1]), default=(None, None))[1] for p in points}
    assert {r.p: r.t for r in found.collect()} == expected
    cells, leaves = tree.build_tree(spark.createDataFrame(targets, "_target long, mode string, t_lat double, t_lon double"), by)
    sizes = [r["count"] for r in leaves.groupBy(*by, "depth", "cy", "cx").count().collect()]
    assert sum(sizes) == len(targets) and max(sizes) <= 8


def test_building_shade_against_brute_force(spark):
    """The ray form against a direct test: a point is shaded when some step back along the ray lies in the footprint."""
    rng = random.Random(5)
    buildings, rings = [], []
    for i in range(30):
        lat, lon, half = 32.07 + rng.random() / 400, 34.78 + rng.random() / 400, 0.0001 + rng.random() / 8000
        ring = [(lon - half, lat - half), (lon + half, lat - half), (lon + half, lat + half), (lon - half, lat + half), (lon - half, lat - half)]
        height, confidence = 5 + rng.random() * 30, rng.choice(["high", "low"])
        buildings.append((i, height, confidence, ring))
        rings.append((lat, lon, half, height, confidence))
    samples = [(1, 0, i, 1.0, 32.07 + rng.random() / 400, 34.78 + rng.random() / 400) for i in range(300)]
    azimuth, elevation = 130.0, 25.0
    got = J.shade_samples(
        spark.createDataFrame(samples, "trip_id long, segment long, sample long, distance_m double, lat double, lon double"),
        spark.createDataFrame([(1, azimuth, elevation)], "trip_id long, azimuth double, elevation double"),
        spark.createDataFrame(buildings, "osm_id long, height_m double, confidence string, ring array<struct<lon:double,lat:double>>"),
        "trip_id",
    ).collect()
    ky, kx = 110_900.0, 111_320.0 * math.cos(math.radians(32.071))
    wrong = 0
    for row in got:
        shaded = high = False
        for lat, lon, half, height, confidence in rings:
            length = min(250.0, height / math.tan(math.radians(elevation)))
            steps = np.linspace(0, length, 600)
            y = row.lat + steps * math.cos(math.radians(azimuth)) / ky
            x = row.lon + steps * math.sin(math.radians(azimuth)) / kx
            inside = (np.abs(y - lat) <= half) & (np.abs(x - lon) <= half)
            if inside.any() and not inside[0]:
                shaded, high = True, high or confidence == "high"
        wrong += (shaded, high) != (row.shaded, row.high)
    # the brute force uses a flat plane and steps, so points within centimetres of an edge may differ
    assert wrong <= 3 and any(r.shaded for r in got) and not all(r.shaded for r in got)


def test_components_and_clusters(spark):
    nodes = spark.range(300).toDF("id")
    chain = spark.range(99).select(c("id").alias("a"), (c("id") + 1).alias("b")).union(spark.createDataFrame([(150, 250), (250, 200)], "a long, b long"))
    found = {r.id: r.component for r in connected_components(nodes, chain).collect()}
    assert all(found[i] == 0 for i in range(100)) and found[250] == 150 and found[200] == 150 and found[299] == 299
    signals = spark.createDataFrame([(1, 32.07, 34.78), (2, 32.0701, 34.78), (3, 32.0702, 34.78), (4, 32.08, 34.78), (5, 32.08, 34.78)], "osm_id long, lat double, lon double")
    assert {r.osm_id: r.cluster for r in cluster_signals(signals).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_previous_row_across_chunks(spark):
    rows = [(k, t) for k in (1, 2) for t in range(0, 200, 7)]
    frame = spark.createDataFrame(rows, "k long, t long").withColumn("v", c("t") * 10)
    seen = {(r.k, r.t): (r.prev1_v, r.prev2_v) for r in previous_row(frame, ["k"], ["t"], ["v"], F.floor(c("t") / 10), depth=2).collect()}
    for k, t in rows:
        assert seen[k, t] == ((t - 7) * 10 if t >= 7 else None, (t - 14) * 10 if t >= 14 else None)


ROUTE = [(32.0733, 34.7799), (32.0776, 34.7749), (32.0819, 34.7806)]


def follow(spark, fixes, kind):
    rows = [(1, i, i, lat, lon, 5.0, heading, None) for i, (lat, lon, heading) in enumerate(fixes)]
    frame = spark.createDataFrame(rows, "trip_id long, fix_id long, ts_us long, lat double, lon double, accuracy_m double, heading double, speed double")
    vertices = spark.createDataFrame([(1, i, *p) for i, p in enumerate(ROUTE)], "trip_id long, idx long, lat double, lon double")
    return sorted(T.follow(frame, vertices, kind).collect(), key=lambda r: r.fix_id)


def test_trackers(spark):
    far = (32.12, 34.84, 0.0)
    for kind in ("matcher", "progress"):
        assert [r.off_route for r in follow(spark, [far] * 3, kind)] == [False, False, True]
    assert follow(spark, [(*ROUTE[1], None)], "matcher")[0].geometry_index >= 1
    assert follow(spark, [(*ROUTE[2], None)], "progress")[0].arrived
    middle = follow(spark, [((ROUTE[0][0] + ROUTE[1][0]) / 2, (ROUTE[0][1] + ROUTE[1][1]) / 2, None)], "progress")[0]
    assert middle.distance_m < 2 and not middle.off_route and middle.fraction > 0 and middle.remaining_m < 1500


def test_streaming_status_and_requests(spark):
    rows = [(1, 7, i, i * 10, 32.0, 34.0, True) for i in range(5)]
    frame = spark.createDataFrame(rows, "provider long, vehicle_id long, observation_id long, s long, lat double, lon double, available boolean")
    frame = frame.withColumn("observed_at", F.timestamp_seconds("s")).drop("s")
    with tempfile.TemporaryDirectory() as directory:
        frame.write.parquet(f"{directory}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{directory}/in")
        run = E.latest_status(stream).writeStream.format("memory").queryName("status").outputMode("complete").trigger(availableNow=True).start()
        run.awaitTermination(60)
        assert [r.observation_id for r in spark.table("status").collect()] == [4]
        asked = stream.select(F.lit("h").alias("request_hash"), c("observed_at").alias("ts"))
        run = E.unique_requests(asked).writeStream.format("memory").queryName("asked").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(60)
        assert spark.table("asked").count() == 1


def test_spaced_alerts(spark):
    rows = [("a", t * 1_000_000, t) for t in (0, 10, 29, 30, 45, 61)] + [("b", 5_000_000, 9)]
    kept = T.spaced(spark.createDataFrame(rows, "key string, at_us long, id long"), 30).collect()
    assert sorted(r.id for r in kept) == [0, 9, 30, 61]


def test_spacing_by_pointers_equals_a_scan(spark, monkeypatch):
    monkeypatch.setattr(T, "SPAN_GAPS", 3)
    rng = random.Random(13)
    rows = [(k, int(rng.choice([rng.uniform(0, 5000), rng.gauss(900, 40)]) * 1e6), i) for i, k in enumerate(rng.choices("aaab", k=1500))]
    rows += [("c", 7, 1), ("c", 7, 0), ("d", 0, 5)] + rows[:20]
    want, until = [], {}
    for key, at, ident in sorted(rows):
        if key not in until or at >= until[key]:
            until[key] = at + 30_000_000
            want.append((key, at, ident))
    got = T.spaced(spark.createDataFrame(rows, "key string, at_us long, id long"), 30)
    assert sorted(map(tuple, got.collect())) == want
    assert T.spaced(got.limit(0), 30).count() == 0


def test_session_replay_is_chunk_independent(spark):
    rng = random.Random(2)
    rows = [(trip, i, i, rng.choice(E.EVENTS + ("UNLISTED",))) for trip in range(5) for i in range(60)]
    frame = spark.createDataFrame(rows, "trip_id long, event_id long, ts long, event string")
    from pathloom.constants import NAVIGATION_TRANSITIONS as table

    for width in (1, 7, 1000):
        got = {r.trip_id: r.state for r in E.replay(frame, F.floor(c("ts") / width)).collect()}
        for trip in range(5):
            state = "idle"
            for t, _, _, event in rows:
                if t == trip:
                    state = table[state].get(event, state)
            assert got[trip] == state
