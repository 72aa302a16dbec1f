"""Streams with keyed state next to their batch twins: events out of order, late events, expiry."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from pathloom.streaming import events as E
from pathloom.streaming import state as S
from pathloom.streaming import trackers as T

c = F.col
START = 1_704_067_200


@pytest.fixture(autouse=True)
def typed_state(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.use_typed_state(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, batches, schema, make, name):
    """(result rows, progress) of a stream that gets each list of rows as a micro-batch; rows have seconds in ``s``."""
    with tempfile.TemporaryDirectory() as directory:
        for number, rows in enumerate(batches):
            part = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(c("s") + START)).drop("s").coalesce(1)
            part.write.mode("append").parquet(f"{directory}/in/batch={number}")
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{directory}/in/*")
        made = make(stream)
        run = (
            made.writeStream.format("memory").queryName(name).outputMode("update" if "stale" in made.columns or "device_id" in made.columns else "append")
            .option("checkpointLocation", f"{directory}/cp").trigger(availableNow=True).start()
        )
        assert run.awaitTermination(300)
        progress = [p for p in run.recentProgress if p["stateOperators"]]
        return [tuple(r) for r in spark.table(name).collect()], progress


def dropped(progress):
    return sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress)


def in_batches(rng, rows, span, at):
    """Rows dealt to batches about by their time, shuffled inside and across neighbours."""
    out = {}
    for row in rows:
        out.setdefault(int((row[at] + rng.uniform(0, span * 0.8)) // span), []).append(row)
    return [rng.sample(out[k], len(out[k])) for k in sorted(out)]


def test_sessions_in_any_order_and_late_events(spark):
    rng = random.Random(6)
    schema = "trip_id long, event_id long, s long, event string"
    rows = [(trip, 100 * trip + i, 7 * i + trip, rng.choice(E.EVENTS + ("UNLISTED",))) for trip in range(4) for i in range(50)]
    batches = in_batches(rng, rows, 100, 2) + [[(99, 1, 100_000, "PLAN")], [(0, 7777, 5, "STOP"), (99, 2, 100_001, "STOP")]]
    got, progress = streamed(spark, batches, schema, lambda s: S.replay_stream(s, "100 seconds"), "sessions")
    assert dropped(progress) == 1
    assert len({r[1] for r in got if r[0] != 99}) == len(rows)
    frame = spark.createDataFrame(rows, schema).withColumnRenamed("s", "ts")
    want = {r["trip_id"]: r["state"] for r in E.replay(frame, F.floor(c("ts") / 60)).collect()}
    last = {trip: max(r[1] for r in rows if r[0] == trip) for trip in range(4)}
    assert {r[0]: r[2] for r in got if r[0] != 99 and r[1] == last[r[0]]} == want


def test_session_expires(spark):
    rows = [[(1, 1, 0, "PLAN"), (1, 2, 1, "ROUTES_READY")], [(2, 3, 90_000, "PLAN")], [(2, 5, 95_000, "PLAN")], [(1, 4, 95_000, "START"), (2, 6, 200_000, "PLAN")], [(2, 7, 200_001, "PLAN")]]
    got, progress = streamed(spark, rows, "trip_id long, event_id long, s long, event string", lambda s: S.replay_stream(s, "10 seconds", 3600), "expiring")
    assert {r[1]: r[2] for r in got if r[0] == 1} == {1: "planning.requesting", 2: "preview", 4: "idle"}


def test_spaced_stream_equals_batch(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 2]), rng.randrange(4000), i) for i in range(400)]
    batches = in_batches(rng, rows, 300, 1) + [[(9, 90_000, 9000)], [(9, 90_001, 9001)]]
    got, progress = streamed(spark, batches, "key long, s long, id long", lambda s: S.spaced_stream(s, 30, "300 seconds"), "spaced")
    frame = spark.createDataFrame(rows, "key long, s long, id long").select("key", ((c("s") + START) * 1_000_000).alias("at_us"), "id")
    assert sorted(r for r in got if r[0] != 9) == sorted(map(tuple, T.spaced(frame, 30).collect()))
    assert dropped(progress) == 0


def test_status_becomes_stale_and_is_forgotten(spark):
    schema = "provider long, vehicle_id long, observation_id long, s long, lat double, lon double, available boolean"
    rng = random.Random(4)
    rows = [(1, v, 100 * v + i, 40 * i + v, 32.0 + i / 100, 34.0, i % 3 > 0) for v in range(5) for i in range(6 + v)]
    batches = in_batches(rng, rows, 60, 3) + [[(2, 0, 9000, 480, 0.0, 0.0, True)]]
    got, _ = streamed(spark, batches + [[(2, 0, 9001, 481, 0.0, 0.0, True)]], schema, lambda s: S.status_stream(s, "60 seconds", 120, 3600), "status_a")
    newest = {}
    for provider, vehicle, ts_us, ident, _, _, _, stale in got:
        newest[provider, vehicle] = max(newest.get((provider, vehicle), ()), (ts_us, ident, stale))
    frame = spark.createDataFrame(rows, schema).withColumn("observed_at", F.timestamp_seconds(c("s") + START))
    # the watermark is at 420 s when the stream ends
    batch = E.with_stale(E.latest_status(frame), F.timestamp_seconds(F.lit(START + 420))).collect()
    assert {(1, r["vehicle_id"]): (r["observation_id"], r["stale"]) for r in batch} == {k: v[1:] for k, v in newest.items() if k[0] == 1}
    assert {r["stale"] for r in batch} == {True, False}
    # an hour later nothing but the one who was seen last is in the state
    later = [[(2, 0, 9002, 9000, 0.0, 0.0, True)], [(2, 0, 9003, 9001, 0.0, 0.0, True)]]
    _, progress = streamed(spark, batches + later, schema, lambda s: S.status_stream(s, "60 seconds", 120, 3600), "status_b")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    _, alone = streamed(spark, later, schema, lambda s: S.status_stream(s, "60 seconds", 120, 3600), "status_c")
    assert max(held) > 5 and held[-1] == alone[-1]["stateOperators"][0]["numRowsTotal"]


def test_latest_fix_stream_equals_batch(spark):
    rng = random.Random(8)
    schema = "device_id long, fix_id long, s long, lat double, lon double"
    rows = [(d, 10 * d + i, rng.randrange(300), rng.random(), rng.random()) for d in range(6) for i in range(9)]
    got, _ = streamed(spark, in_batches(rng, rows, 50, 2), schema, lambda s: S.fix_stream(s, "400 seconds"), "fixes")
    newest = {}
    for device, ts_us, ident, *_ in got:
        newest[device] = max(newest.get(device, (0, 0)), (ts_us, ident))
    frame = spark.createDataFrame(rows, schema).withColumnRenamed("s", "ts")
    assert {d: v[1] for d, v in newest.items()} == {r["device_id"]: r["fix_id"] for r in E.latest_fix(frame).collect()}


@pytest.mark.parametrize("kind", ["progress", "matcher"])
def test_trackers_with_fixes_out_of_order(spark, kind):
    rng = random.Random(1)
    schema = "trip_id long, fix_id long, s long, lat double, lon double, accuracy_m double, heading double, speed double"
    rows = [
        (trip, 100 * trip + i, 5 * i, 32.05 + i * 0.001 + rng.gauss(0, 1e-4), 34.75 + (0.01 if rng.random() < 0.3 else 0), 10.0, None if i % 2 else 3.0, 1.4)
        for trip in (1, 2, 3) for i in range(19)
    ]
    vertices = spark.createDataFrame([(t, i, 32.05 + i * 0.001, 34.75) for t in (1, 2, 3) for i in range(20)], "trip_id long, idx long, lat double, lon double")
    end = [[(4, 999, 9_000, 0.0, 0.0, 1.0, None, None)], [(4, 1000, 9_001, 0.0, 0.0, 1.0, None, None)]]
    batches = in_batches(rng, rows, 20, 2)
    assert any(a[2] > b[2] for x, y in zip(batches, batches[1:]) for a in x for b in y)  # also across micro-batches
    got, _ = streamed(spark, batches + end, schema, lambda s: S.follow_stream(s, vertices, kind, "60 seconds"), f"trips_{kind}")
    fixes = spark.createDataFrame(rows, schema).withColumnRenamed("s", "ts_us")
    want = sorted(tuple(r) for r in T.follow(fixes, vertices, kind).collect())
    assert sorted(r for r in got if r[0] != 4) == want
