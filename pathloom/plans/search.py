"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators import search as X
from pathloom.operators.selection import top_k
from pathloom.plans import mapping as M
from pathloom.plans.registry import Tables, query

c = F.col

_CORPUS = """SELECT p_partkey AS place_id, p_name AS name, CAST(NULL AS VARCHAR(20)) AS name_he, p_brand AS subtitle, p_type AS category,
  CAST(32.0 AS DOUBLE) + ((p_partkey * 7919) % 20000) / 1e5 AS lat, CAST(34.69 AS DOUBLE) + ((p_partkey * 104729) % 24000) / 1e5 AS lon FROM part"""
_QUERIES = """SELECT CAST(n_nationkey AS BIGINT) AS query_id, CASE CAST(n_nationkey % 6 AS INTEGER) WHEN 0 THEN 'red' WHEN 1 THEN 'Small ri' WHEN 2 THEN 'wid' WHEN 3 THEN 'blue bolt' WHEN 4 THEN 'brand 1'
  ELSE 'b' END AS query, CAST(n_nationkey % 20 + 1 AS BIGINT) AS limit_, CASE WHEN n_nationkey % 3 = 0 THEN 'ECONOMY, SMALL' END AS category,
  CASE WHEN n_nationkey % 2 = 0 THEN CAST(32.1 AS DOUBLE) END AS lat, CASE WHEN n_nationkey % 2 = 0 THEN CAST(34.8 AS DOUBLE) END AS lon FROM nation"""

_POSTINGS_SQL = f"""SELECT term, place_id, count(*) AS tf, any_value(doc_len) AS doc_len FROM (
  SELECT place_id, len(w) AS doc_len, unnest(w) AS term FROM (SELECT place_id, regexp_extract_all(lower(concat_ws(' ', name, subtitle, category)), '[a-z0-9]+') AS w FROM ({_CORPUS}) k) a) b GROUP BY term, place_id"""
_MATCH_SQL = f"""p AS MATERIALIZED ({_POSTINGS_SQL}),
t AS (SELECT query_id, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS token FROM (SELECT query_id, regexp_extract_all(lower(query), '[a-z0-9]+') AS w FROM ({_QUERIES}) q) a),
h AS (SELECT query_id, i, n, place_id, sum(tf) AS tf, any_value(doc_len) AS doc_len FROM t JOIN p ON starts_with(p.term, t.token) GROUP BY 1, 2, 3, 4),
d AS (SELECT query_id, i, count(*) AS df FROM h GROUP BY 1, 2),
s AS (SELECT count(*) AS n_docs, avg(l) AS avg_len FROM (SELECT place_id, any_value(doc_len) AS l FROM p GROUP BY place_id) x),
m AS (SELECT query_id, place_id, sum(greatest(1e-6, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))) AS score
      FROM h JOIN d USING (query_id, i) CROSS JOIN s GROUP BY query_id, place_id, n HAVING count(*) = n)"""


def _queries(t: Tables) -> DataFrame:
    return t.sql(_QUERIES).withColumnRenamed("limit_", "limit")


@query("X1", _POSTINGS_SQL)
def x1(t: Tables) -> DataFrame:
    return X.build_postings(t.sql(_CORPUS))


@query("J16", f"WITH {_MATCH_SQL} SELECT query_id, place_id, round(score, 6) AS score FROM m")
def j16(t: Tables) -> DataFrame:
    found = X.match(_queries(t), X.build_postings(t.sql(_CORPUS)))
    return found.select("query_id", "place_id", F.round("score", 6).alias("score"))


@query(
    "X2",
    f"""WITH {_MATCH_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, place_id) AS rel FROM m),
        k AS (SELECT b.query_id, b.place_id, b.rel, q.limit_, CASE WHEN q.lat IS NOT NULL THEN round({M.haversine('c.lat', 'c.lon', 'q.lat', 'q.lon')}, 6) END AS near
              FROM b JOIN ({_QUERIES}) q USING (query_id) JOIN ({_CORPUS}) c USING (place_id)
              WHERE b.rel <= greatest(50, 8 * q.limit_) AND (coalesce(q.category, '') = '' OR list_contains(list_transform(string_split(q.category, ','), lambda x: trim(x)), c.category)))
        SELECT query_id, place_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near NULLS FIRST, rel) AS rank FROM k) z WHERE rank <= limit_""",
)
def x2(t: Tables) -> DataFrame:
    corpus = t.sql(_CORPUS)
    return X.search(_queries(t), corpus, X.build_postings(corpus))


_OFFLINE = f"SELECT query_id, query, CAST(32.1 AS DOUBLE) AS q_lat, CAST(34.8 AS DOUBLE) AS q_lon FROM ({_QUERIES}) q"


@query(
    "X3",
    f"""SELECT query_id, place_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pow(lat - q_lat, 2) + pow(lon - q_lon, 2), place_id) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place_id) AS f FROM ({_OFFLINE}) q JOIN ({_CORPUS}) c ON contains(lower(c.name), lower(trim(q.query)))) x WHERE f <= 20) y WHERE rank <= 8""",
)
def x3(t: Tables) -> DataFrame:
    return X.offline_search(t.sql(_OFFLINE), t.sql(_CORPUS))


_NAMED = f"SELECT place_id, category, lat, lon, CASE WHEN place_id % 4 = 0 THEN 'אבן גבירול' WHEN place_id % 4 = 1 THEN 'בן יהודה' WHEN place_id % 4 = 2 THEN 'דיזנגוף' ELSE 'רוטשילד' END AS name_he FROM ({M.PLACES}) p"


@query(
    "W12",
    f"""SELECT place_id, row_number() OVER (PARTITION BY category ORDER BY round({M.haversine('lat', 'lon', '32.1', '34.8')}, 6), place_id) AS by_distance,
               row_number() OVER (PARTITION BY category ORDER BY pow(lat - 32.1::DOUBLE, 2) + pow(lon - 34.8::DOUBLE, 2), place_id) AS by_degrees,
               row_number() OVER (PARTITION BY category ORDER BY name_he, place_id) AS by_name FROM ({_NAMED}) n""",
)
def w12(t: Tables) -> DataFrame:
    return proximity_ranks(t.sql(_NAMED), 32.1, 34.8)


def proximity_ranks(places: DataFrame, lat: float, lon: float) -> DataFrame:
    """Three orderings of each category: distance, squared degrees, and Hebrew name collation."""
    from pyspark.sql import Window

    from pathloom.functions.geo import haversine_m

    def rank(*order):
        return F.row_number().over(Window.partitionBy("category").orderBy(*order, "place_id")).cast("long")

    dy, dx = c("lat") - lat, c("lon") - lon
    return places.select(
        "place_id",
        rank(F.round(haversine_m(c("lat"), c("lon"), lat, lon), 6)).alias("by_distance"),
        rank(dy * dy + dx * dx).alias("by_degrees"),
        rank(F.collate("name_he", "he")).alias("by_name"),
    )
