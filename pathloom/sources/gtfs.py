"""Schedule-feed tables: scan of header CSVs with file row numbers, and feed validation."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom import constants as K
from pathloom.operators.scan import previous_row

c = F.col


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text plus ``file_path`` and ``row_number`` (the header is row 1).

    Row numbers come without moving the data: rows of a file split are contiguous in their task, so a row's number is
    its place in the split plus the sizes of the splits before it, and only one row per split is aggregated.
    """
    rows = (
        spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
        .select("*", c("_metadata.file_path").alias("file_path"), c("_metadata.file_block_start").alias("_block"))
        .withColumn("_id", F.monotonically_increasing_id())
    )
    splits = rows.groupBy("file_path", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = rows.join(splits, ["file_path", "_block"])
    number = c("_offset") + c("_id") - c("_first") + 2
    return numbered.withColumn("row_number", number).drop("_block", "_id", "_first", "_offset")


def _finding(frame: DataFrame, file: str, rule: str, message: Column, severity: str = "error") -> DataFrame:
    return frame.select(
        F.lit(file).alias("file"),
        c("row_number").cast("long").alias("row"),
        F.lit(severity).alias("severity"),
        F.lit(rule).alias("rule"),
        message.alias("message"),
    )


def _value(name: str) -> Column:
    return F.trim(F.coalesce(c(name), F.lit("")))


def unique_key(rows: DataFrame, key: str, file: str) -> DataFrame:
    """Empty keys, and every repeat of a key after its first row.

    The first row per key is a partial aggregation; the repeats are found by joining back, which a hot key survives
    because the join can be split while a window over the key could not.
    """
    keyed = rows.select("row_number", _value(key).alias("_k"))
    first = keyed.filter(c("_k") != "").groupBy("_k").agg(F.min("row_number").alias("_first"))
    repeats = keyed.join(first, "_k").filter(c("row_number") > c("_first"))
    empty = keyed.filter(c("_k") == "")
    where = F.concat(F.lit(f"{file}:"), c("row_number").cast("string"))
    return _finding(empty, file, "empty_key", F.concat(where, F.lit(f" has an empty {key}"))).unionByName(
        _finding(repeats, file, "duplicate_key", F.concat(where, F.lit(f" duplicates {key}="), c("_k")))
    )


def references(rows: DataFrame, key: str, targets: DataFrame, file: str, target_file: str) -> DataFrame:
    """Rows whose key has no row in the target table."""
    keyed = rows.select("row_number", _value(key).alias("_k"))
    known = targets.select(F.coalesce(c(key), F.lit("")).alias("_k")).distinct()
    where = F.concat(F.lit(f"{file}:"), c("row_number").cast("string"))
    message = F.concat(where, F.lit(f" references missing {key}="), c("_k"), F.lit(f" in {target_file}"))
    return _finding(keyed.join(known, "_k", "left_anti"), file, "missing_reference", message)


def coordinates(stops: DataFrame) -> DataFrame:
    lat, lon = c("stop_lat").try_cast("double"), c("stop_lon").try_cast("double")
    invalid = lat.isNull() | lon.isNull()
    inside = lat.between(*K.GTFS_LAT_RANGE) & lon.between(*K.GTFS_LON_RANGE)
    where = F.concat(F.lit("stops.txt:"), c("row_number").cast("string"))
    return _finding(
        stops.filter(invalid), "stops.txt", "invalid_coordinate", F.concat(where, F.lit(" has an invalid coordinate"))
    ).unionByName(
        _finding(
            stops.filter(~invalid & ~inside), "stops.txt", "implausible_coordinate",
            F.concat(where, F.lit(" is outside plausible Israel bounds")),
        )
    )


def stop_sequences(stop_times: DataFrame) -> DataFrame:
    """Unreadable sequence numbers, and numbers not above the previous readable one of the same trip in file order."""
    parsed = stop_times.select(
        "row_number", F.coalesce(c("trip_id"), F.lit("")).alias("trip_id"), c("stop_sequence").try_cast("long").alias("_seq")
    )
    readable = previous_row(
        parsed.filter(c("_seq").isNotNull()), ["trip_id"], ["row_number"], ["_seq"], F.floor(c("row_number") / 65536)
    )
    stuck = readable.filter(c("_seq") <= F.coalesce(c("prev1__seq"), F.lit(-1)))
    where = F.concat(F.lit("stop_times.txt:"), c("row_number").cast("string"))
    return _finding(
        parsed.filter(c("_seq").isNull()), "stop_times.txt", "invalid_sequence",
        F.concat(where, F.lit(" has an invalid stop_sequence")),
    ).unionByName(
        _finding(stuck, "stop_times.txt", "sequence_not_increasing", F.concat(where, F.lit(" stop_sequence is not increasing")))
    )


def file_findings(spark: SparkSession, names: Iterable[str]) -> tuple[DataFrame, bool]:
    """Findings about which files are present (file names are a short list), and whether validation can go on."""
    present = set(names)
    missing = sorted(set(K.GTFS_REQUIRED) - present)
    rows = []
    if missing:
        rows.append(("error", "missing_files", f"Missing required GTFS files: {', '.join(missing)}"))
    else:
        if not set(K.GTFS_CALENDARS) & present:
            rows.append(("error", "no_calendar", "GTFS has neither calendar.txt nor calendar_dates.txt"))
        if "feed_info.txt" not in present:
            rows.append((
                "warning", "no_feed_info", "feed_info.txt is missing; publisher/version metadata is unavailable",
            ))
    frame = spark.createDataFrame(
        [(None, None, *r) for r in rows], "file string, row long, severity string, rule string, message string"
    )
    return frame, not missing


def validate(spark: SparkSession, tables: dict[str, DataFrame], names: Iterable[str]) -> DataFrame:
    """All findings of a feed as one table."""
    present, complete = file_findings(spark, names)
    if not complete:
        return present
    stops, routes = tables["stops.txt"], tables["routes.txt"]
    trips, times = tables["trips.txt"], tables["stop_times.txt"]
    parts = [
        present,
        unique_key(stops, "stop_id", "stops.txt"),
        unique_key(routes, "route_id", "routes.txt"),
        unique_key(trips, "trip_id", "trips.txt"),
        references(trips, "route_id", routes, "trips.txt", "routes.txt"),
        references(times, "trip_id", trips, "stop_times.txt", "trips.txt"),
        references(times, "stop_id", stops, "stop_times.txt", "stops.txt"),
        coordinates(stops),
        stop_sequences(times),
    ]
    return reduce(DataFrame.unionByName, parts)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [f.agg(F.lit(n).alias("table_name"), F.count("*").alias("rows")) for n, f in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def validate_directory(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame | None]:
    """Findings and row counts of an extracted feed directory."""
    listing = spark.read.format("binaryFile").load(directory).select("path").collect()
    names = {row.path.rsplit("/", 1)[-1] for row in listing}
    if set(K.GTFS_REQUIRED) - names:
        return validate(spark, {}, names), None
    tables = {n: scan_table(spark, f"{directory}/{n}") for n in K.GTFS_REQUIRED}
    return validate(spark, tables, names), table_counts(tables)
