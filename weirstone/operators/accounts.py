"""Features of accounts from cleaned comments and posts, one row per account."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirstone.functions import metrics as M


#: The columns of cleaned comments that the features below read.
COLUMNS = [
    "author", "sub", "month", "post_id", "score", "ts", "controversiality", "is_submitter", "depth", "body_len", "meta_removal_type", "meta_was_deleted_later", "ordinal", "is_seed",
]


def rate(cond) -> F.Column:
    """Share of rows where the condition holds; null counts as not."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def comment_stats(c: DataFrame) -> DataFrame:
    return c.groupBy("author").agg(
        F.count("*").alias("n_comments"), F.countDistinct("sub").alias("n_subs"), F.countDistinct("post_id").alias("n_threads"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.avg("score").alias("mean_score"), F.median("score").alias("median_score"),
        F.stddev_samp("score").alias("sd_score"), rate(F.col("controversiality") == 1).alias("controversial_rate"), rate(F.col("is_submitter")).alias("submitter_rate"),
        F.avg("depth").alias("mean_depth"), F.avg("body_len").alias("mean_body_len"), rate(F.col("meta_removal_type").isNotNull()).alias("removal_rate"),
        rate(F.col("meta_was_deleted_later")).alias("deleted_later_rate"), F.max("ordinal").alias("ordinal"), F.bool_or("is_seed").alias("ever_seed"),
    )


def post_stats(p: DataFrame) -> DataFrame:
    return p.groupBy("author").agg(F.count("*").alias("n_posts"), F.avg("score").alias("mean_post_score"))


def repeat_engagement(c: DataFrame) -> DataFrame:
    per = c.groupBy("author", "post_id").agg(F.count("*").alias("k"))
    return per.groupBy("author").agg(F.count("*").alias("n_distinct_threads"), F.count_if(F.col("k") > 1).alias("n_repeat_threads"), rate(F.col("k") > 1).alias("repeat_rate"))


def own_post_replies(p: DataFrame) -> DataFrame:
    return p.filter("n_comments_observed > 0").groupBy("author").agg(F.avg("submitter_reply_rate").alias("own_post_reply_rate"), F.count("*").alias("n_own_posts"))


def reception(c: DataFrame) -> DataFrame:
    """How an account fares in its communities: rejected but returned, best, worst and spread of mean scores."""
    per = c.groupBy("author", "sub").agg(F.avg("score").alias("m"), F.countDistinct("month").alias("months"))
    out = per.groupBy("author").agg(F.count_if((F.col("m") < 0) & (F.col("months") >= 2)).alias("n_returned"), F.max("m").alias("best"), F.min("m").alias("worst"))
    return out.withColumns({"spread": F.col("best") - F.col("worst"), "silo": (F.col("n_returned") >= 1) & F.coalesce(F.col("best") > 5, F.lit(False))})


def tier_footprint(c: DataFrame, p0: DataFrame) -> DataFrame:
    """Comments by the incentive tier of their post; comments without their post don't count."""
    j = c.select("author", "post_id", "sub", "month").join(p0.select("post_id", "sub", "month", "incentive_tier"), ["post_id", "sub", "month"])
    tier = F.col("incentive_tier")
    low_subs = F.countDistinct(F.when(tier == "low", F.col("sub")))
    return j.groupBy("author").agg(*[F.count_if(tier == t).alias(f"n_{t}") for t in ("high", "medium", "low")], low_subs.alias("n_low_subs"))


def category_entropy(df: DataFrame, key: str, category: str) -> DataFrame:
    """Entropy in bits of a key's rows over a category."""
    per = df.groupBy(key, category).agg(F.count("*").alias("k"))
    total = per.groupBy(key).agg(F.sum("k").alias("n"))
    return per.join(total, key).groupBy(key).agg(F.sum(M.entropy_term(F.col("k") / F.col("n"))).alias("entropy"))


def name_shape(df: DataFrame, name: str) -> DataFrame:
    n = F.col(name)
    return df.select(name).distinct().select(
        name, F.rlike(n, F.lit(M.DEFAULT_USERNAME)).alias("default_pattern"), M.char_entropy(n).alias("char_entropy"), F.length(F.regexp_extract(n, r"(\d+)$", 1)).alias("digit_suffix")
    )


def timing(df: DataFrame, key: str, ts: str, least: int = 5) -> DataFrame:
    """Interval entropy, burstiness and quantisation of each key's gaps, for keys with ``least`` times or more.

    Gaps are formed by a window, which spills, and reduced by grouped aggregates; no array of all times is built.
    """
    w = Window.partitionBy(key).orderBy(ts)
    g = df.filter(F.col(ts).isNotNull()).select(key, (F.col(ts) - F.lag(ts).over(w)).alias("g")).filter("g IS NOT NULL")
    pos = F.when(F.col("g") > 0, F.col("g"))
    near = F.lit(False)
    for t in (60, 300, 900):
        x = F.bround(F.col("g") / t) * t
        near = near | ((x > 0) & (F.abs(F.col("g") - x) <= 2))
    stats = g.groupBy(key).agg(
        F.count("*").alias("n"), F.avg("g").alias("mu"), F.stddev_pop("g").alias("sigma"), F.min("g").alias("gmin"), F.max("g").alias("gmax"),
        F.count(pos).alias("np"), F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.count_if((F.col("g") > 0) & near).alias("hits"),
    ).filter(F.col("n") >= least - 1)
    lo, width = F.log10("lo"), (F.log10(F.col("hi") + 1) - F.log10("lo")) / M.LOG10_BINS
    bins = g.filter("g > 0").join(stats.filter("lo < hi").select(key, "lo", "hi", "np"), key).select(key, "np", F.least(F.lit(M.LOG10_BINS - 1), F.floor((F.log10("g") - lo) / width)).alias("b"))
    ent = bins.groupBy(key, "np", "b").agg(F.count("*").alias("k")).groupBy(key).agg((F.sum(M.entropy_term(F.col("k") / F.col("np"))) / F.log2(F.lit(float(M.LOG10_BINS)))).alias("e"))
    r, a, b = F.col("sigma") / F.col("mu"), F.sqrt(F.col("n") + 1), F.sqrt(F.col("n") - 1)
    burst = F.when((F.col("n") < 3) | (F.col("mu") == 0), None).when(F.col("gmin") == F.col("gmax"), -1.0).otherwise(F.try_divide(a * r - b, (a - 2) * r + b))
    entropy = F.when(F.col("np") < 2, None).when(F.col("lo") == F.col("hi"), 0.0).otherwise(F.col("e"))
    return stats.join(ent, key, "left").select(key, F.col("n").alias("n_gaps"), entropy.alias("interval_entropy"), burst.alias("burstiness"), (F.col("hits") / F.col("n")).alias("quantization_rate"))


def features(c: DataFrame, p: DataFrame, p0: DataFrame) -> DataFrame:
    """All of the above in one row per commenting account. Every join is on the account, so the sides share one layout."""
    parts = [post_stats(p), repeat_engagement(c), own_post_replies(p), reception(c), tier_footprint(c, p0), category_entropy(c, "author", "sub").withColumnRenamed("entropy", "sub_entropy"), name_shape(c, "author"), timing(c, "author", "ts")]
    f = comment_stats(c)
    for part in parts:
        f = f.join(part, "author", "left")
    span = F.greatest((F.col("last_seen") - F.col("first_seen")) / 86400, F.lit(0.0))
    return f.withColumns({
        "n_posts": F.coalesce("n_posts", F.lit(0)), "span_days": span, "comments_per_day": F.col("n_comments") / F.greatest(span, F.lit(1.0)),
        "score_per_day": F.col("mean_score") * F.col("n_comments") / F.greatest(span, F.lit(1.0)), "hobby_absence": F.coalesce(F.col("n_low_subs"), F.lit(0)) == 0,
    })
