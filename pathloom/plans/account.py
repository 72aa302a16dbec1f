"""Account queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.plans import mapping as M
from pathloom.plans.registry import Tables, query
from pathloom.sources import account as A

c = F.col

_UPDATES = "SELECT user_id AS subject, event_id AS update_id, ts AS updated_at, value > 50 AS history_enabled FROM events WHERE event_type = 'signup'"
_ENTRIES = "SELECT user_id AS subject, event_id AS id, ts AS created_at FROM events WHERE event_type = 'view'"
_SUBJECTS = "SELECT DISTINCT user_id AS subject FROM events"
_PREFS_SQL = f"""SELECT s.subject, coalesce(p.history_enabled, false) AS history_enabled FROM ({_SUBJECTS}) s LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY updated_at DESC, update_id DESC) AS rn FROM ({_UPDATES}) u) x WHERE rn = 1) p ON p.subject = s.subject"""


@query("S13", "SELECT event_id AS id, user_id AS subject, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click'")
def s13(t: Tables) -> DataFrame:
    table = A.read_table(t.spark, f"{t.directory}/events.parquet", {"props": "struct<k:bigint>"})
    return table.filter(c("event_type") == "click").select(
        c("event_id").alias("id"), c("user_id").alias("subject"), c("props_parsed.k").alias("k")
    )


def preferences(t: Tables) -> DataFrame:
    return A.latest_preferences(t.sql(_SUBJECTS), t.sql(_UPDATES))


@query("W9", _PREFS_SQL)
def w9(t: Tables) -> DataFrame:
    return preferences(t)


@query("J10", f"SELECT e.subject, e.id FROM ({_ENTRIES}) e WHERE e.subject IN (SELECT subject FROM ({_PREFS_SQL}) p WHERE history_enabled)")
def j10(t: Tables) -> DataFrame:
    return A.admitted_history(t.sql(_ENTRIES), preferences(t)).select("subject", "id")


@query("J11", """SELECT user_id AS subject, event_id AS id FROM events f WHERE event_type = 'click' AND NOT EXISTS (
  SELECT 1 FROM events d WHERE d.event_type = 'error' AND d.user_id = f.user_id AND d.event_id = f.event_id + 1)""")
def j11(t: Tables) -> DataFrame:
    favorites = t.sql("SELECT user_id AS subject, event_id AS id FROM events WHERE event_type = 'click'")
    deletions = t.sql("SELECT user_id AS subject, event_id - 1 AS id FROM events WHERE event_type = 'error'")
    return A.without_deleted(favorites, deletions).select("subject", "id")


@query(
    "W10",
    f"""SELECT subject, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY created_at DESC, id DESC) AS rank FROM ({_ENTRIES}) e
        WHERE created_at + INTERVAL 30 DAY > TIMESTAMP '{M.AS_OF}') x WHERE rank <= 200""",
)
def w10(t: Tables) -> DataFrame:
    return A.unexpired_history(t.sql(_ENTRIES), F.lit(M.AS_OF).cast("timestamp_ntz")).select("subject", "id", "rank")


def _place_events(kind: str) -> str:
    return f"SELECT user_id AS subject, event_id % 10 AS place_id, ts AS seen_at, event_id AS id FROM events WHERE event_type = '{kind}'"


def _ranked_sql(kind: str, keep: int, having: str) -> str:
    return f"""SELECT subject, place_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY seen_at DESC, id DESC) AS rank FROM (
      SELECT subject, place_id, max(seen_at) AS seen_at, arg_max(id, seen_at) AS id FROM ({_place_events(kind)}) e GROUP BY subject, place_id {having}) x) y WHERE rank <= {keep}"""


@query(
    "W11",
    f"SELECT 'recent' AS kind, * FROM ({_ranked_sql('view', 6, '')}) r UNION ALL SELECT 'favorite', * FROM ({_ranked_sql('click', 20, 'HAVING count(*) % 2 = 1')}) f",
)
def w11(t: Tables) -> DataFrame:
    recent = A.recents(t.sql(_place_events("view"))).withColumn("kind", F.lit("recent"))
    return recent.unionByName(A.toggled_favorites(t.sql(_place_events("click"))).withColumn("kind", F.lit("favorite")))
