"""Registration of queries, and the SQL views they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirstone.operators import clean
from weirstone.sources.tables import table


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def raw_comments(spark: SparkSession, d: str) -> DataFrame:
    return clean.comments(table(spark, d, "commenters"))


def comments(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_comments(table(spark, d, "commenters"))


def posts(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_posts(table(spark, d, "posts"))


def all_posts(spark: SparkSession, d: str) -> DataFrame:
    return clean.posts(table(spark, d, "posts"))


SUB = "trim(regexp_replace(lower(trim(sub)), '^/?r/', ''))"
_SEED = "coalesce(author = 'AutoModerator' OR author ILIKE '%bot', FALSE)"
_PHRASES = " OR ".join(f"coalesce(contains(lower(body), '{p}'), FALSE)" for p in clean.PHRASES)
_ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in ["retrieved_at", *clean.POST_COLUMNS])
#: c0, p0: all comments and posts, one row each; c, p: without automation and deleted accounts.
VIEWS = f"""
c0 AS (SELECT * EXCLUDE (k) REPLACE ({SUB} AS sub), CASE WHEN created_utc >= 100000000000 THEN created_utc // 1000 WHEN created_utc > 0 THEN created_utc END AS ts,
              {_SEED} OR coalesce(distinguished = 'moderator', FALSE) OR {_PHRASES} AS is_seed, (author IS NULL OR author = '[deleted]') AS is_gone
       FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY commenter_tag NULLS LAST, retrieved_at DESC NULLS LAST, score DESC NULLS LAST, created_utc NULLS LAST) AS k
             FROM commenters WHERE comment_id IS NOT NULL) WHERE k = 1),
p0 AS (SELECT * EXCLUDE (k) REPLACE ({SUB} AS sub), {_SEED} AS is_seed, (author IS NULL OR author = '[deleted]') AS is_gone
       FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY {_ORDER}) AS k FROM posts WHERE post_id IS NOT NULL) WHERE k = 1),
c AS (SELECT * FROM c0 WHERE NOT is_seed AND NOT is_gone),
p AS (SELECT * FROM p0 WHERE NOT is_seed AND NOT is_gone)
"""


def with_views(body: str) -> str:
    """A query over the views; ``body`` may add further ones before its SELECT."""
    return f"WITH {VIEWS}{body}"
