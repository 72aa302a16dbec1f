"""Request and graph validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom import constants as K

c = F.col


def request_errors() -> Column:
    """Array of rule names a plan request breaks."""
    def outside(name: str, low: float, high: float, open_low: bool = False) -> Column:
        value = c(name)
        below = value <= low if open_low else value < low
        return F.coalesce(below | (value > high) | F.isnan(value.cast("double")), F.lit(False))

    rules = {
        "both_times": c("depart_at").isNotNull() & c("arrive_by").isNotNull(),
        "walking_preference": (c("mode") == "walk") & ~c("preference").isin(*K.WALK_PREFERENCES),
        "road_preference": c("mode").isin(*K.ROAD_MODES) & ~c("preference").isin(*K.ROAD_PREFERENCES),
        "unknown_mode": ~c("mode").isin(*K.ALL_MODES),
        "unknown_preference": ~c("preference").isin(*K.PREFERENCES),
        "origin": outside("origin_lat", -90, 90) | outside("origin_lon", -180, 180),
        "destination": outside("destination_lat", -90, 90) | outside("destination_lon", -180, 180),
        "height_m": outside("height_m", 0, 10, open_low=True),
        "width_m": outside("width_m", 0, 5, open_low=True),
        "weight_t": outside("weight_t", 0, 100, open_low=True),
        "time_detour": outside("time_cap", 0, 100),
        "distance_detour": outside("distance_cap", 0, 100),
        "carry_distance": outside("carry_m", 0, 10_000),
    }
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an unknown end."""
    ids = nodes.select("node_id")
    known = edges.join(ids, edges["source"] == ids["node_id"], "left_semi")
    known = known.join(ids, known["target"] == ids["node_id"], "left_semi")
    return edges.join(known.select("source", "target"), ["source", "target"], "left_anti")


def eligible_nodes(edges: DataFrame, mode: Column) -> DataFrame:
    """Nodes touched by any edge that admits a mode."""
    allowed = edges.filter(F.array_contains(c("modes"), mode))
    ends = allowed.select(F.explode(F.array("source", "target")).alias("node_id"))
    return ends.distinct()
