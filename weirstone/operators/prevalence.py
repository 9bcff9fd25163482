"""From scored accounts to a share of high-risk accounts by community, month and role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_POSTS, PER_POST, FLOOR, THRESHOLD, LEAST = 100, 10, 15, 0.7, 10


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group in a total order. Rank filters go below the shuffle (limit per group), so a large group sends n rows a task."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(rank) <= n)


def linear_score(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, score): weighted sum of standardised columns, brought to 0..1. Moments and limits are single rows."""
    moments = df.agg(*[F.avg(c).alias(f"m_{c}") for c in weights], *[F.stddev_pop(c).alias(f"s_{c}") for c in weights])
    z = sum((F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    raw = df.join(F.broadcast(moments)).select(key, z.alias("raw"))
    ends = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return raw.join(F.broadcast(ends)).select(key, F.try_divide(F.col("raw") - F.col("lo"), F.col("hi") - F.col("lo")).alias("score"))


def influencers(p: DataFrame, c: DataFrame, top_posts: int = TOP_POSTS, per_post: int = PER_POST) -> DataFrame:
    """(sub, month, author, role): posters of the top posts (once a post), their top and latest commenters (once), and both together (once)."""
    top = top_per_group(p.filter("role = 'top'"), ["sub", "month"], [F.desc_nulls_last("score"), F.col("post_id")], top_posts)
    posters = top.select("sub", "month", "author", "post_id")
    said = c.select("post_id", "author", "score", "ts", "comment_id").join(posters.select("post_id", "sub", "month"), "post_id")
    best = top_per_group(said, ["post_id"], [F.desc_nulls_last("score"), F.col("author"), F.col("comment_id")], per_post)
    last = top_per_group(said, ["post_id"], [F.desc_nulls_last("ts"), F.col("author"), F.col("comment_id")], per_post)
    keys = ["sub", "month", "author"]
    commenters = best.select(*keys).unionByName(last.select(*keys)).distinct()
    both = posters.select(*keys).unionByName(commenters).distinct()
    role = lambda df, r: df.select(*keys, F.lit(r).alias("role"))
    return role(posters, "poster").unionByName(role(commenters, "commenter")).unionByName(role(both, "combined"))


def prevalence(people: DataFrame, scores: DataFrame, floor: int = FLOOR, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each community, month and role; rates are null below ``floor`` scored accounts."""
    j = people.join(scores, "author", "left")
    scored = F.count("score")
    shown = lambda x: F.when(scored >= floor, x)
    high = F.when(F.col("score").isNotNull(), F.when(F.col("score") >= threshold, 100.0).otherwise(0.0))
    return j.groupBy("sub", "month", "role").agg(
        F.count("*").alias("n"), scored.alias("n_scored"), (100.0 * scored / F.count("*")).alias("coverage_pct"), shown(F.avg(high)).alias("pct_high_risk"), shown(F.avg("score")).alias("mean_score")
    )


def wide(by_role: DataFrame) -> DataFrame:
    """Roles as columns, named role_measure."""
    measures = ["n", "n_scored", "coverage_pct", "pct_high_risk", "mean_score"]
    return by_role.groupBy("sub", "month").pivot("role", ["poster", "commenter", "combined"]).agg(*[F.first(m).alias(m) for m in measures])
