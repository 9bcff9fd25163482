"""Cleaning of the raw tables: one row per comment and post, and flags for automation and deleted accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstone.functions.metrics import base36
from weirstone.operators.sessions import known_seconds
from weirstone.sources.tables import canonical_sub, latest_rows

#: The system account and the phrases automated comments use.
SYSTEM_ACCOUNT = "AutoModerator"
PHRASES = ("i am a bot", "beep boop", "performed automatically", "this action was performed automatically")

POST_COLUMNS = ["score", "sub", "month", "role", "incentive_tier", "author", "created_utc", "upvote_ratio", "num_comments_reported", "n_comments_observed", "subreddit_subscribers", "submitter_reply_rate", "meta_was_deleted_later", "title_len", "selftext_len", "comment_score_gini", "comment_score_p50", "mean_depth", "pct_toplevel", "first10_authors", "top10_authors", "first10_arrival_gaps", "removed_by_category"]


def automated_author(author: Column) -> Column:
    return F.coalesce((author == SYSTEM_ACCOUNT) | F.ilike(author, F.lit("%bot")), F.lit(False))


def automated_comment(author: Column, body: Column, distinguished: Column) -> Column:
    said = F.lit(False)
    for p in PHRASES:
        said = said | F.coalesce(F.contains(F.lower(body), F.lit(p)), F.lit(False))
    return automated_author(author) | F.coalesce(distinguished == "moderator", F.lit(False)) | said


def gone_author(author: Column) -> Column:
    return F.coalesce(author.isNull() | (author == "[deleted]"), F.lit(False))


def one_per_comment(df: DataFrame) -> DataFrame:
    """The row of each comment under its first tag ('first10' before 'top10'), the latest fetched. A comment has a few rows, so the windows are small."""
    order = [F.asc_nulls_last("commenter_tag"), F.desc_nulls_last("retrieved_at"), F.desc_nulls_last("score"), F.asc_nulls_last("created_utc")]
    rn = F.row_number().over(Window.partitionBy("comment_id").orderBy(*order))
    return df.filter("comment_id IS NOT NULL").withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def comments(df: DataFrame) -> DataFrame:
    """De-duplicated comments with canonical community, known time, account ordinal and flags."""
    c = one_per_comment(df)
    seed = automated_comment(F.col("author"), F.col("body"), F.col("distinguished"))
    ordinal = F.when(F.startswith(F.col("author_fullname"), F.lit("t2_")), base36(F.substring("author_fullname", 4, 20)))
    return c.withColumns({"sub": canonical_sub("sub"), "ts": known_seconds("created_utc"), "is_seed": seed, "is_gone": gone_author(F.col("author")), "ordinal": ordinal})


def clean_comments(df: DataFrame) -> DataFrame:
    return comments(df).filter("NOT is_seed AND NOT is_gone")


def posts(df: DataFrame) -> DataFrame:
    """The latest row of each post with canonical community and flags."""
    p = latest_rows(df, "post_id", "retrieved_at", POST_COLUMNS)
    return p.withColumns({"sub": canonical_sub("sub"), "is_seed": automated_author(F.col("author")), "is_gone": gone_author(F.col("author"))})


def clean_posts(df: DataFrame) -> DataFrame:
    return posts(df).filter("NOT is_seed AND NOT is_gone")
