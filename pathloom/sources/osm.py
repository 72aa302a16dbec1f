"""Map features: element responses, extraction from node and way tables, and the feature store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom import constants as K
from pathloom.functions import rules
from pathloom.operators.selection import top_k

c = F.col

ELEMENTS = (
    "elements array<struct<type:string,id:bigint,lat:string,lon:string,tags:map<string,string>,"
    "geometry:array<struct<lat:string,lon:string>>>>"
)


def _elements(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    parsed = payloads.select(key, F.from_json(payload, ELEMENTS).alias("_p"))
    return parsed.select(key, F.posexplode("_p.elements").alias("position", "_e")).select(key, "position", "_e.*")


def response_signals(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    rows = _elements(payloads, key, payload).filter(c("tags")["highway"] == "traffic_signals")
    lat, lon = c("lat").try_cast("double"), c("lon").try_cast("double")
    return rows.select(key, "position", lat.alias("lat"), lon.alias("lon")).filter(c("lat").isNotNull() & c("lon").isNotNull())


def response_buildings(payloads: DataFrame, key: str, payload: str = "payload", limit: int = 10_000) -> DataFrame:
    """Buildings with at least four readable points; a response counts for its first ``limit`` of them."""
    rows = _elements(payloads, key, payload).filter(F.map_contains_key("tags", "building"))
    points = F.filter(
        F.transform(
            F.coalesce("geometry", F.array().cast("array<struct<lat:string,lon:string>>")),
            lambda p: F.struct(p["lon"].try_cast("double").alias("lon"), p["lat"].try_cast("double").alias("lat")),
        ),
        lambda p: p["lon"].isNotNull() & p["lat"].isNotNull(),
    )
    height, confidence = rules.building_height(c("tags")["height"], c("tags")["building:levels"])
    kept = rows.select(
        key, "position", points.alias("ring"), height.alias("height_m"), confidence.alias("confidence")
    ).filter(F.size("ring") >= 4)
    return top_k(kept, [key], [c("position")], limit, "_nth").drop("_nth")


def extract_signals(nodes: DataFrame, box: tuple[float, float, float, float] = K.COVERAGE_BBOX) -> DataFrame:
    tagged = nodes.filter(c("tags")["highway"] == "traffic_signals")
    return tagged.filter(rules.inside_box(c("lat"), c("lon"), box)).select(c("node_id").alias("osm_id"), "lat", "lon")


def locate_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways with their vertices in order; ways with an unlocated vertex are dropped.

    Only the located vertices of one way come together, so the group is as large as one outline.
    """
    refs = ways.select("way_id", F.posexplode("node_refs").alias("_at", "node_id"))
    placed = refs.join(nodes.select("node_id", "lat", "lon"), "node_id", "left")
    ordered = F.array_sort(F.collect_list(F.struct(c("_at"), c("node_id"), c("lon"), c("lat"))))
    rings = placed.groupBy("way_id").agg(F.every(c("lat").isNotNull() & c("lon").isNotNull()).alias("_all"), ordered.alias("_v"))
    return rings.filter("_all").select(
        "way_id", F.transform("_v", lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat"))).alias("ring")
    )


def extract_buildings(ways: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float] = K.COVERAGE_BBOX) -> DataFrame:
    """Closed, fully located building outlines that touch a box, with bounds and height."""
    built = ways.filter((F.coalesce(c("tags")["building"], F.lit("")) != "") & (F.size("node_refs") >= 4))
    rings = locate_ways(built, nodes).filter(F.element_at("ring", 1) == F.element_at("ring", -1))
    lons, lats = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    bounded = rings.withColumns(
        {
            "min_lon": F.array_min(lons), "min_lat": F.array_min(lats), "max_lon": F.array_max(lons), "max_lat": F.array_max(lats),
        }
    )
    west, south, east, north = box
    touching = bounded.filter(
        (c("max_lon") >= west) & (c("min_lon") <= east) & (c("max_lat") >= south) & (c("min_lat") <= north)
    )
    height, confidence = rules.building_height(c("tags")["height"], c("tags")["building:levels"])
    heights = built.select("way_id", height.alias("height_m"), confidence.alias("confidence"))
    return touching.join(heights, "way_id").withColumnRenamed("way_id", "osm_id")


#: Bits of a coordinate in the Hilbert keys of the store.
HILBERT_BITS = 16
BOUNDS = {"buildings": ("min_lat", "min_lon", "max_lat", "max_lon"), "signals": ("lat", "lon", "lat", "lon")}


def hilbert_key(lat: Column, lon: Column) -> Column:
    """Place of a coordinate on a Hilbert curve over the globe: near on the curve is near on the map."""
    side = 1 << HILBERT_BITS
    x = F.least(F.lit(side - 1), F.floor((lon + 180.0) / 360.0 * side)).cast("long")
    y = F.least(F.lit(side - 1), F.floor((lat + 90.0) / 180.0 * side)).cast("long")
    begin = F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("long").alias("d"))

    def step(at: Column, bit: Column) -> Column:
        s = F.pow(F.lit(2.0), bit).cast("long")
        right, up = at["x"].bitwiseAND(s) > 0, at["y"].bitwiseAND(s) > 0
        d = at["d"] + s * s * F.when(right & up, 2).when(right, 3).when(up, 1).otherwise(0)
        # the lower quadrants are turned, the right one of them also mirrored
        tx = F.when(right & ~up, s - 1 - at["x"].bitwiseAND(s - 1)).otherwise(at["x"].bitwiseAND(s - 1))
        ty = F.when(right & ~up, s - 1 - at["y"].bitwiseAND(s - 1)).otherwise(at["y"].bitwiseAND(s - 1))
        return F.struct(F.when(up, tx).otherwise(ty).alias("x"), F.when(up, ty).otherwise(tx).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(HILBERT_BITS - 1), F.lit(0), F.lit(-1)), begin, step)["d"]


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def write_version(buildings: DataFrame, signals: DataFrame, path: str, source_version: str) -> str:
    """Write a whole new version of the feature store beside the current one; returns its name.

    Tables are clustered along a Hilbert curve, and an index has the box of every file. Coverage is measured.
    """
    spark = buildings.sparkSession
    version = uuid.uuid4().hex
    base = f"{path}/versions/{version}"
    boxes, facts = [], []
    for table, frame in (("buildings", buildings), ("signals", signals)):
        south, west, north, east = BOUNDS[table]
        frame.withColumn("_h", hilbert_key(c(south), c(west))).repartitionByRange("_h").sortWithinPartitions("_h").drop("_h").write.parquet(f"{base}/{table}")
        stored = spark.read.schema(frame.schema).parquet(f"{base}/{table}")
        box = [F.min(south).alias("south"), F.min(west).alias("west"), F.max(north).alias("north"), F.max(east).alias("east"), F.count("*").alias("n")]
        boxes.append(stored.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(*box).withColumn("table", F.lit(table)))
    index = boxes[0].unionByName(boxes[1])
    index.write.parquet(f"{base}/index")
    index = spark.read.schema(index.schema).parquet(f"{base}/index")
    counted = index.agg(
        *[F.coalesce(F.sum(F.when(c("table") == t, c("n"))), F.lit(0)).cast("string").alias(f"{t[:-1]}_count") for t in BOUNDS],
        F.format_string("[%.6f, %.6f, %.6f, %.6f]", F.min("west"), F.min("south"), F.max("east"), F.max("north")).alias("coverage_bbox"),
    )
    measured = counted.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in counted.columns]), F.array(*counted.columns))).alias("key", "value"))
    fixed = {
        "schema_version": "1", "source": "OpenStreetMap via Geofabrik", "source_version": source_version, "license": "ODbL-1.0",
        "attribution": "© OpenStreetMap contributors",
    }
    spark.createDataFrame(list(fixed.items()), "key string, value string").unionByName(measured).write.parquet(f"{base}/metadata")
    return version


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Make a version the current one: a small pointer is written aside and renamed over the old one, in one step."""
    files, aside = _files(spark, f"{path}/_current-{version}")
    out = files.create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    context.rename(files.makeQualified(aside), files.makeQualified(_files(spark, f"{path}/current")[1]), options)


def write_store(buildings: DataFrame, signals: DataFrame, path: str, source_version: str) -> str:
    """Replace the feature store: readers see the old version until the new one is whole, and then the new one.

    The version before stays for readers that have opened it; older ones are deleted.
    """
    spark = buildings.sparkSession
    before = current_version(spark, path)
    version = write_version(buildings, signals, path, source_version)
    publish(spark, path, version)
    files, folder = _files(spark, f"{path}/versions")
    for status in files.listStatus(folder):
        if status.getPath().getName() not in (before, version):
            files.delete(status.getPath(), True)
    return version


def current_version(spark: SparkSession, path: str) -> str | None:
    files, pointer = _files(spark, f"{path}/current")
    return spark.read.text(f"{path}/current").first()[0] if files.exists(pointer) else None


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the current version."""
    return spark.read.parquet(f"{path}/versions/{current_version(spark, path)}/metadata")


def files_touching(spark: SparkSession, path: str, table: str, south: float, west: float, north: float, east: float) -> list[str]:
    """Files of the current version whose box touches a box."""
    base = f"{path}/versions/{current_version(spark, path)}"
    boxes = spark.read.parquet(f"{base}/index").filter(
        (c("table") == table) & (c("north") >= south) & (c("south") <= north) & (c("east") >= west) & (c("west") <= east)
    )
    return [f"{base}/{table}/{row[0]}" for row in boxes.select("file").collect()]


def read_store(spark: SparkSession, path: str, table: str, south: float, west: float, north: float, east: float) -> DataFrame:
    """Features whose bounds touch a box: only files that can hold any are opened, bounds are pushed into their scan."""
    found = files_touching(spark, path, table, south, west, north, east)
    schema = spark.read.parquet(f"{path}/versions/{current_version(spark, path)}/{table}").schema
    if not found:
        return spark.createDataFrame([], schema)
    low_lat, low_lon, high_lat, high_lon = BOUNDS[table]
    exact = (c(high_lat) >= south) & (c(low_lat) <= north) & (c(high_lon) >= west) & (c(low_lon) <= east)
    return spark.read.schema(schema).parquet(*found).filter(exact)
