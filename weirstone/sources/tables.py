"""Readers for the raw and derived tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of ``author`` that name no account.
SENTINELS = ("[deleted]",)

POSTS_SCHEMA = (
    "sub string, month string, role string, incentive_tier string, post_id string, author string, author_fullname string,"
    " domain string, link_flair_text string, created_utc bigint, title_len bigint, selftext_len bigint, score bigint,"
    " num_comments_reported bigint, num_crossposts bigint, subreddit_subscribers bigint, upvote_ratio double, is_self boolean,"
    " over_18 boolean, removed_by_category string, meta_removal_type string, meta_was_deleted_later boolean, meta_is_edited boolean,"
    " implied_votes double, implied_downs double, implied_ups double, contested_share double, n_comments_observed bigint,"
    " n_unique_commenters bigint, comment_score_p50 bigint, comment_score_p90 bigint, comment_score_max bigint, max_depth bigint,"
    " comment_score_gini double, mean_depth double, pct_toplevel double, reply_reciprocity double, removed_comment_rate double,"
    " tombstone_rate double, bot_comment_rate double, submitter_reply_rate double, first10_arrival_gaps array<bigint>,"
    " first10_authors array<string>, top10_authors array<string>"
)

COMMENTERS_SCHEMA = (
    "sub string, month string, post_id string, role string, commenter_tag string, author string, author_fullname string,"
    " comment_id string, created_utc bigint, score bigint, controversiality bigint, depth bigint, body_len bigint,"
    " is_submitter boolean, parent_is_post boolean, body string, distinguished string, meta_removal_type string,"
    " meta_was_deleted_later boolean"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ndjson(spark: SparkSession, folder: str, schema: str, suffix: str = "*.ndjson.zst") -> DataFrame:
    """Newline-delimited JSON of a folder. Missing keys become null, hidden files are skipped; no match is an error."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("pathGlobFilter", suffix).json(folder)
    if not df.inputFiles():
        raise FileNotFoundError(f"no {suffix} in {folder}")
    return df


def csv(spark: SparkSession, paths: str | list[str], optional: dict[str, str] | None = None) -> DataFrame:
    """CSV files with a header, united by name; ``optional`` columns (name to type) are added as null where absent."""
    paths = [paths] if isinstance(paths, str) else paths
    out = None
    for p in paths:
        df = spark.read.option("header", True).option("inferSchema", True).csv(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    for name, kind in (optional or {}).items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file of names, without blank lines and ``#`` comments."""
    v = F.trim(F.col("value"))
    return spark.read.text(path).select(v.alias("name")).filter((v != "") & ~v.startswith("#"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The community catalogue with canonical names."""
    df = csv(spark, path)
    return df.withColumn("sub_name", canonical_sub("sub_name"))


def canonical_sub(col) -> F.Column:
    """A community's name in lower case, trimmed, without a leading ``r/``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "^/?r/", ""))


def latest_rows(df: DataFrame, key: str, version: str, values: list[str]) -> DataFrame:
    """One row per non-null ``key``: the one with the greatest ``version`` (null lowest).

    Equal versions are settled by the greatest values in the order given, so that the row doesn't
    depend on the order of input. The maximum is taken before the shuffle as well as after it.
    """
    best = F.max(F.struct(version, *values)).alias("_best")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_best.{v}").alias(v) for v in values])
