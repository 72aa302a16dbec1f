"""Connected components and distance clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom import constants as K
from pathloom.functions.geo import to_grid
from pathloom.operators.cells import cell
from pathloom.operators.rounds import RoundState

c = F.col


def connected_components(nodes: DataFrame, links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) with the smallest member id as component, from undirected links (a, b).

    Every node points at a parent, itself at first. In a round each node and its parent are hooked under the least
    grandparent among the node's neighbours, and pointers are shortened to grandparents, so whole trees are merged at
    once and few rounds are needed even for long chains. Rounds are written to the shared checkpoint folder.
    """
    state = RoundState(nodes.sparkSession, "components")
    both = links.select("a", "b").union(links.select(c("b").alias("a"), c("a").alias("b"))).distinct()
    both = state.keep(both, "links")
    labels = state.save(nodes.select("id", c("id").alias("parent"), c("id").alias("grand"), F.lit(True).alias("moved")))
    for _ in range(max_rounds):
        around = both.join(labels.select(c("id").alias("b"), "grand"), "b").groupBy("a").agg(F.min("grand").alias("_near"))
        seen = labels.join(around, labels["id"] == around["a"], "left")
        hooks = seen.select(
            F.explode(
                F.array(
                    F.struct(c("id"), F.least("grand", "_near").alias("parent"), c("parent").alias("_old")),
                    F.struct(c("parent").alias("id"), F.least("grand", "_near").alias("parent"), F.lit(None).cast(labels.schema["id"].dataType).alias("_old")),
                )
            ).alias("_h")
        )
        parents = hooks.groupBy(c("_h.id").alias("id")).agg(
            F.min("_h.parent").alias("parent"), F.max("_h._old").alias("_old")
        )
        above = parents.select(c("id").alias("parent"), c("parent").alias("grand"))
        labels = state.save(
            parents.join(above, "parent").select(
                "id", "parent", "grand", ((c("_old") != c("parent")) | (c("parent") != c("grand"))).alias("moved")
            )
        )
        if labels.filter("moved").isEmpty():
            return labels.select("id", c("parent").alias("component"))
    raise RuntimeError(f"components still changing after {max_rounds} rounds")


def cluster_signals(signals: DataFrame, radius_m: float = K.SIGNAL_CLUSTER_M) -> DataFrame:
    """(osm_id, cluster) of signals chained together by gaps of at most a radius.

    Signals at one place are one until the clusters are known, and those at one spot are one node. Cells are small enough
    that all spots of a cell are within the radius of each other, so a cell is one node as well and only spots of
    neighbouring cells have to be compared.
    """
    state = RoundState(signals.sparkSession, "clusters")
    x, y = to_grid(c("lat"), c("lon"))
    size = radius_m / 1.4143
    # kept, as projecting places is dear and they are looked at several times
    places = state.keep(signals.groupBy("lat", "lon").agg(F.min("osm_id").alias("osm_id")), "places")
    placed = places.select("lat", "lon", "osm_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))
    placed = state.keep(placed.withColumn("cy", cell(c("y"), size)).withColumn("cx", cell(c("x"), size)), "placed")
    spots = placed.groupBy("cy", "cx", "x", "y").agg(F.min("osm_id").alias("osm_id"))
    named = state.keep(placed.groupBy("cy", "cx").agg(F.min("osm_id").alias("id")), "cells")
    # half of the 5x5 neighbourhood: every unordered pair of cells meets once
    offsets = [(dy, dx) for dy in range(0, 3) for dx in range(-2, 3) if dy > 0 or dx > 0]
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    left = spots.withColumn("_o", F.explode(shifts)).select(
        "cy", "cx", c("x").alias("x1"), c("y").alias("y1"),
        (c("cy") + c("_o.dy")).alias("ny"), (c("cx") + c("_o.dx")).alias("nx"),
    )
    right = spots.select(c("cy").alias("ny"), c("cx").alias("nx"), c("x").alias("x2"), c("y").alias("y2"))
    gap = (c("x1") - c("x2")) * (c("x1") - c("x2")) + (c("y1") - c("y2")) * (c("y1") - c("y2"))
    touching = left.join(right, ["ny", "nx"]).filter(gap <= radius_m * radius_m).select("cy", "cx", "ny", "nx").distinct()
    links = touching.join(named.withColumnRenamed("id", "a"), ["cy", "cx"]).join(
        named.select(c("cy").alias("ny"), c("cx").alias("nx"), c("id").alias("b")), ["ny", "nx"]
    )
    components = connected_components(named.select("id"), links)
    found = state.keep(placed.join(named, ["cy", "cx"]).join(components, "id").select("lat", "lon", "x", "y", "component"), "found")
    members = signals.select("osm_id", "lat", "lon").join(found, ["lat", "lon"])
    return members.select("osm_id", c("component").alias("cluster"), "x", "y")
