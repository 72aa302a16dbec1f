"""Bundles with hashes computed apart from Spark, and the versioned feature store."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from pathloom import constants as K
from pathloom.sources import manifest, osm

c = F.col


def bundle(folder, rng):
    """Files of all sizes around the piece size, with names that need quoting; path -> (size, hash)."""
    out = {}
    for name, size in [*((n, rng.randrange(1, 5000)) for n in K.BUNDLE_REQUIRED), ("sub/empty", 0), ("sub/two words %41", 77), ("big", manifest.HASH_BYTES * 2 + 3), ("exact", manifest.HASH_BYTES)]:
        data = rng.randbytes(size)
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "wb") as handle:
            handle.write(data)
        out[name] = (size, hashlib.sha256(data).hexdigest())
    return out


def test_fixity_and_findings_on_generated_bundles(spark, tmp_path):
    rng = random.Random(5)
    truth = bundle(tmp_path, rng)
    found = {r["path"]: (r["size_bytes"], r["sha256"]) for r in manifest.scan_files(spark, str(tmp_path)).collect()}
    assert found == truth
    files = spark.createDataFrame([(n, n, h, s, "x") for n, (s, h) in truth.items()], "logical_name string, path string, sha256 string, size_bytes long, media_type string")
    path = str(tmp_path / "manifest.json.d")
    manifest.write_manifest(manifest.build_manifest(files, "b", "c", {"osm": "1"}, ["x"], "2026-01-01 00:00:00"), path)
    built = manifest.read_manifest(spark, path)
    sound = [r["message"] for r in manifest.validate_bundle(built, manifest.scan_files(spark, str(tmp_path))).collect()]
    assert sound == ["Empty bundle file: sub/empty"]
    # damage: a byte changed, a byte added, a file gone
    names = sorted(n for n in K.BUNDLE_REQUIRED)
    changed, longer, gone = names[:3]
    data = bytearray((tmp_path / changed).read_bytes())
    data[len(data) // 2] ^= 1
    (tmp_path / changed).write_bytes(bytes(data))
    with open(tmp_path / longer, "ab") as handle:
        handle.write(b"!")
    os.remove(tmp_path / gone)
    got = {(r["severity"], r["message"]) for r in manifest.validate_bundle(built, manifest.scan_files(spark, str(tmp_path))).collect()}
    assert got == {
        ("warning", "Empty bundle file: sub/empty"), ("error", f"Checksum mismatch: {changed}"), ("error", f"Size mismatch: {longer}"),
        ("error", f"Checksum mismatch: {longer}"), ("error", f"Missing bundle file: {gone}"),
    }


def test_file_larger_than_an_array(spark, tmp_path):
    """More than 2 GB, which no row could hold; the file is sparse, so it takes no room."""
    size = (2 << 30) + 12_345
    with open(tmp_path / "large", "wb") as handle:
        handle.truncate(size)
    digest, zeros = hashlib.sha256(), bytes(1 << 24)
    for at in range(0, size, len(zeros)):
        digest.update(zeros[: min(len(zeros), size - at)])
    row = manifest.scan_files(spark, str(tmp_path)).first()
    assert (row["path"], row["size_bytes"], row["sha256"]) == ("large", size, digest.hexdigest())


def features(spark, count, shift=0.0):
    rng = random.Random(9)
    rows = [(i, 32.0 + shift + rng.random(), 34.0 + rng.random(), rng.random() * 0.001) for i in range(count)]
    frame = spark.createDataFrame(rows, "osm_id long, min_lat double, min_lon double, d double")
    buildings = frame.select("osm_id", "min_lat", "min_lon", (c("min_lat") + c("d")).alias("max_lat"), (c("min_lon") + c("d")).alias("max_lon"), F.lit(10.0).alias("height_m"))
    signals = frame.filter("osm_id % 5 = 0").select("osm_id", c("min_lat").alias("lat"), c("min_lon").alias("lon"))
    return rows, buildings, signals


def test_readers_see_whole_versions_only(spark, tmp_path):
    path = str(tmp_path / "store")
    _, buildings, signals = features(spark, 300)
    assert osm.current_version(spark, path) is None
    first = osm.write_store(buildings, signals, path, "one")
    _, more, lights = features(spark, 500, 0.1)
    second = osm.write_version(more, lights, path, "two")
    box = (-90.0, -180.0, 90.0, 180.0)
    # written, but not published
    assert osm.current_version(spark, path) == first and osm.read_store(spark, path, "buildings", *box).count() == 300
    opened = osm.read_store(spark, path, "buildings", *box)
    osm.publish(spark, path, second)
    assert osm.read_store(spark, path, "buildings", *box).count() == 500 and opened.count() == 300
    facts = {r["key"]: r["value"] for r in osm.read_metadata(spark, path).collect()}
    assert (facts["building_count"], facts["signal_count"], facts["source_version"]) == ("500", "100", "two")
    west, south, east, north = map(float, facts["coverage_bbox"].strip("[]").split(","))
    low = more.agg(F.min("min_lat"), F.min("min_lon"), F.max("max_lat"), F.max("max_lon")).first()
    assert (south, west, north, east) == pytest.approx(tuple(low), abs=1e-6)
    third = osm.write_store(buildings, signals, path, "three")
    assert osm.read_store(spark, path, "signals", *box).count() == 60
    assert sorted(os.listdir(f"{path}/versions")) == sorted([second, third])


def test_files_are_pruned_by_their_boxes(spark, tmp_path):
    path = str(tmp_path / "store")
    rows, buildings, signals = features(spark, 4000)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        osm.write_store(buildings, signals, path, "x")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    box = (32.2, 34.2, 32.3, 34.3)
    got = osm.read_store(spark, path, "buildings", *box)
    want = {i for i, lat, lon, d in rows if lat + d >= 32.2 and lat <= 32.3 and lon + d >= 34.2 and lon <= 34.3}
    assert {r["osm_id"] for r in got.collect()} == want and want
    everything = len(osm.files_touching(spark, path, "buildings", -90, -180, 90, 180))
    assert everything >= 12 and len(got.inputFiles()) <= everything / 3
    assert osm.read_store(spark, path, "signals", 1.0, 1.0, 2.0, 2.0).count() == 0


def test_hilbert_key_walks_in_steps(spark):
    """Cells one after the other on the curve lie side by side."""
    step = 360.0 / (1 << osm.HILBERT_BITS)
    cells = [(x, y) for x in range(32) for y in range(32)]
    base_lon, base_lat = -180.0, -90.0
    frame = spark.createDataFrame([(x, y, base_lat + (y + 0.5) * step / 2, base_lon + (x + 0.5) * step) for x, y in cells], "x int, y int, lat double, lon double")
    order = [(r["x"], r["y"]) for r in frame.withColumn("h", osm.hilbert_key(c("lat"), c("lon"))).orderBy("h").collect()]
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(order, order[1:]))
