'''Account tables: favorites, preferences and history with JSON columns.'''

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.selection import top_k

c = F.col

DESTINATION = "struct<id:string,name:string,lat:double,lon:double>"
HISTORY_DAYS = 30


def read_table(spark: SparkSession, path: str, json_columns: dict[str, str]) -> DataFrame:
    """Account table with its JSON text columns parsed under fixed schemas (``<name>_parsed``)."""
    frame = spark.read.parquet(path)
    return with_parsed(frame, json_columns)


def with_parsed(frame: DataFrame, json_columns: dict[str, str]) -> DataFrame:
    return frame.withColumns({f"{n}_parsed": F.from_json(n, schema) for n, schema in json_columns.items()})


def latest_preferences(subjects: DataFrame, updates: DataFrame) -> DataFrame:
    """Last saved preferences of each subject; subjects without any get the defaults (history off)."""
    last = updates.groupBy("subject").agg(F.max_by("history_enabled", F.struct("updated_at", "update_id")).alias("_on"))
    return subjects.join(last, "subject", "left").select("subject", F.coalesce("_on", F.lit(False)).alias("history_enabled"))


def admitted_history(entries: DataFrame, preferences: DataFrame) -> DataFrame:
    """History is opt-in: only entries of subjects who switched it on."""
    return entries.join(preferences.filter("history_enabled").select("subject"), "subject", "left_semi")


def unexpired_history(entries: DataFrame, as_of: Column, keep: int = 200) -> DataFrame:
    """Unexpired entries, newest first, at most ``keep`` per subject."""
    fresh = entries.filter(c("created_at") + F.expr(f"INTERVAL {HISTORY_DAYS} DAYS") > as_of)
    return top_k(fresh, ["subject"], [c("created_at").desc(), c("id").desc()], keep)


def without_deleted(favorites: DataFrame, deletions: DataFrame) -> DataFrame:
    return favorites.join(deletions.select("subject", "id"), ["subject", "id"], "left_anti")


def recents(visits: DataFrame, keep: int = 6) -> DataFrame:
    """Last visited places of each subject, each place once, newest first."""
    last = visits.groupBy("subject", "place_id").agg(F.max(F.struct("seen_at", "id")).alias("_last"))
    ranked = top_k(last, ["subject"], [c("_last").desc()], keep)
    return ranked.select("subject", "place_id", "rank")


def toggled_favorites(toggles: DataFrame, keep: int = 20) -> DataFrame:
    """Places toggled an odd number of times, last toggled first."""
    counted = toggles.groupBy("subject", "place_id").agg(F.count("*").alias("_n"), F.max(F.struct("seen_at", "id")).alias("_last"))
    ranked = top_k(counted.filter(c("_n") % 2 == 1), ["subject"], [c("_last").desc()], keep)
    return ranked.select("subject", "place_id", "rank")
