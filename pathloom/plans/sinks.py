"""GeoJSON sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.polyline import slices
from pathloom.plans import mapping as M
from pathloom.plans.registry import Tables, query
from pathloom.session import ensure_checkpoint_dir
from pathloom.sources import geojson

c = F.col

_ANNOTATIONS = f"""SELECT route_id, idx AS start_index, idx + idx % 3 AS end_index, CASE WHEN idx % 2 = 0 THEN 'shade' ELSE 'sun' END AS classification,
  CASE WHEN idx % 4 = 0 THEN 'marked' END AS crossing_kind FROM ({M.WALKS}) k"""
_XY = "'[' || v.lon || ',' || v.lat || ']'"


@query(
    "S14",
    f"""SELECT '{{"type":"Feature","properties":{{"classification":"' || a.classification || '"}},"geometry":{{"type":"LineString","coordinates":[' || string_agg({_XY}, ',' ORDER BY v.idx) || ']}}}}' AS value
        FROM ({_ANNOTATIONS}) a JOIN ({M.WALKS}) v ON v.route_id = a.route_id AND v.idx BETWEEN a.start_index AND a.end_index GROUP BY a.route_id, a.start_index, a.end_index, a.classification HAVING count(*) >= 2
        UNION ALL SELECT '{{"type":"Feature","properties":{{"crossing":"marked"}},"geometry":{{"type":"Point","coordinates":' || {_XY} || '}}}}' FROM ({M.WALKS}) v WHERE v.idx % 4 = 0""",
)
def s14(t: Tables) -> DataFrame:
    walks = t.sql(M.WALKS)
    annotations = t.sql(_ANNOTATIONS)
    lines = geojson.line_features(slices(annotations.drop("crossing_kind"), walks, "route_id"))
    spots = annotations.withColumn("idx", c("start_index")).join(walks, ["route_id", "idx"])
    points = geojson.crossing_features(spots)
    path = f"{ensure_checkpoint_dir(t.spark)}/features-{uuid.uuid4().hex}"
    geojson.write_features(lines.select("feature").unionByName(points.select("feature")), path)
    return t.spark.read.text(path)
