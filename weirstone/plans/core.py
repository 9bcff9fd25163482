"""Queries of the core, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.operators.sessions import known_seconds, sessionize
from weirstone.sources.tables import SENTINELS, table

SESSION_GAP = 1800


def all_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every visit of every account, single comments included."""
    c = table(spark, sf_dir, "commenters").select("author", "comment_id", known_seconds("created_utc").alias("ts"))
    return sessionize(c.filter(~F.col("author").isin(*SENTINELS)), "author", "ts", SESSION_GAP, event_id="comment_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = all_sessions(spark, sf_dir).filter("n_events >= 2")
    return s.select("author", "session_start", "session_end", F.col("n_events").alias("n_comments"))


def p1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_sessions(spark, sf_dir)


_SESSIONS_SQL = """
WITH e AS (SELECT author, comment_id, min(CASE WHEN created_utc >= 100000000000 THEN created_utc // 1000 ELSE created_utc END) AS ts
           FROM commenters WHERE author IS NOT NULL AND author <> '[deleted]' AND created_utc > 0 AND comment_id IS NOT NULL GROUP BY 1, 2),
     g AS (SELECT author, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY author ORDER BY ts, comment_id) <= 1800 THEN 0 ELSE 1 END AS fresh, comment_id FROM e),
     s AS (SELECT author, ts, sum(fresh) OVER (PARTITION BY author ORDER BY ts, comment_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
"""

QUERIES = {"p1_found": p1_found, "p1_sessions": p1_sessions}
SQL = {
    "p1_found": _SESSIONS_SQL + "SELECT author, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_comments FROM s GROUP BY author, k HAVING count(*) >= 2",
    "p1_sessions": _SESSIONS_SQL + "SELECT author, min(ts) AS session_start, max(ts) AS session_end, max(ts) - min(ts) AS duration, count(*) AS n_events FROM s GROUP BY author, k",
}
