"""Diagnostic signals of communities, first and second generation. Every function gives one row for each group in ``by``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirstone.functions import metrics as M
from weirstone.operators.accounts import rate

#: Calibrated 95th percentiles of the two network signals, and the limits of the rank-decay slope.
CROSS_SUB_P95, GINI_P95, STEEP, FLAT = 70.0, 75.0, -0.93, -0.22


def _hours(p: DataFrame, by: list[str]) -> DataFrame:
    h = p.filter("created_utc > 0").select(*by, (F.pmod(F.floor(F.col("created_utc") / 3600), 24)).cast("int").alias("hour"))
    k = h.groupBy(*by, "hour").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by)  # 24 rows
    k = k.withColumns({"n": F.sum("k").over(w), "r": F.row_number().over(w.orderBy(F.desc("k"), "hour"))})
    share = F.col("k") / F.col("n")
    return k.groupBy(*by).agg(
        (100 * F.sum(F.when(F.col("r") <= 3, F.col("k")).otherwise(0)) / F.max("n")).alias("top3_pct"),
        (-F.sum(share * F.log2(share + 1e-10))).alias("entropy"), F.max(F.when(F.col("r") == 1, F.col("hour"))).alias("peak_hour"),
    )


def temporal(p: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("created_utc")
    iv = p.filter("created_utc > 0").select(*by, (F.col("created_utc") - F.lag("created_utc").over(w)).alias("g"))
    iv = iv.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.stddev_pop("g"), F.avg("g")).alias("cv"))
    cv = F.when(F.col("n") >= 4, F.coalesce("cv", F.lit(0.0))).otherwise(1.0)
    out = _hours(p, by).join(iv, by).withColumn("interval_cv", cv)
    conc = F.least(F.col("top3_pct"), F.lit(60.0))
    ent = F.greatest(F.lit(0.0), (1 - F.col("entropy") / F.log2(F.lit(24.0))) * 40)
    reg = M.ramp(F.col("interval_cv"), 0.85, 30)
    return out.withColumn("temporal_score", F.least(conc * 0.7 + ent * 0.7 + reg, F.lit(100.0))).drop("cv", "n")


def engagement(p: DataFrame, by: list[str]) -> DataFrame:
    a = p.groupBy(*by).agg(
        F.count("*").alias("n"), M.pearson("score", "num_comments_reported").alias("corr"), F.stddev_samp("upvote_ratio").alias("ratio_sd"), F.avg("upvote_ratio").alias("mean_ratio"),
        (F.avg("score") / F.greatest(F.avg("num_comments_reported"), F.lit(1.0))).alias("ucr"), (100 * rate((F.col("score") > 500) & (F.col("num_comments_reported") < 5))).alias("simulacra"),
    )
    score = F.coalesce(M.ramp(F.col("corr"), 0.30, 50), F.lit(0.0)) + F.coalesce(M.ramp(F.col("ratio_sd"), 0.025, 30), F.lit(0.0)) + F.least(F.coalesce(F.col("ucr"), F.lit(0.0)) / 30 * 40, F.lit(40.0)) + F.least(F.col("simulacra") / 10 * 20, F.lit(20.0))
    first = F.least(F.greatest(F.lit(0.0), F.least(F.col("ucr") / 30 * 65, F.lit(65.0)) + F.greatest(F.lit(0.0), F.least((F.col("mean_ratio") - 0.85) / 0.15 * 35, F.lit(35.0)))), F.lit(100.0))
    return a.withColumns({"engagement_score": F.least(score, F.lit(100.0)), "engagement_score_v1": first}).filter("n >= 5")


def distribution(p: DataFrame, by: list[str]) -> DataFrame:
    """Spread, corrected skewness, and the slope and fit of log score over log rank."""
    cv = lambda c: F.when(F.avg(c) > 0, F.stddev_samp(c) / F.avg(c)).otherwise(0.0)
    a = p.groupBy(*by).agg(cv("score").alias("score_cv"), cv("num_comments_reported").alias("comments_cv"), M.skewness_g1("score").alias("score_skew"), F.avg("mean_depth").alias("avg_depth"))
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "post_id"))
    x = p.filter("score > 0").select(*by, F.ln(r.cast("double")).alias("x"), F.ln("score").alias("y"))
    fit = x.groupBy(*by).agg(F.count("*").alias("k"), F.regr_slope("y", "x").alias("slope"), F.when(F.max("y") > F.min("y"), F.regr_r2("y", "x")).otherwise(0.0).alias("r2")).filter("k >= 8").drop("k")
    out = a.join(fit, by, "left")
    decay = F.coalesce(F.greatest(F.lit(0.0), F.least((F.col("slope") - STEEP) / (FLAT - STEEP) * 50, F.lit(50.0))), F.lit(0.0))
    second = decay + F.coalesce(M.ramp(F.col("comments_cv"), 0.8, 30), F.lit(0.0)) + F.coalesce(M.ramp(F.col("avg_depth"), 0.5, 20), F.lit(0.0))
    first = F.coalesce(M.ramp(F.col("score_cv"), 0.8, 70), F.lit(0.0)) + F.coalesce(M.ramp(F.col("comments_cv"), 0.8, 30), F.lit(0.0))
    return out.withColumns({"distribution_score": F.least(second, F.lit(100.0)), "distribution_score_v1": F.least(first, F.lit(100.0))})


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Gini coefficient of each group by ranks; no group is collected."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    x = df.filter(F.col(value).isNotNull()).select(*by, F.greatest(F.col(value), F.lit(0)).cast("double").alias("v"), r.alias("i"))
    n, s = F.count("*"), F.sum("v")
    return x.groupBy(*by).agg(F.when((n >= 2) & (s != 0), 2 * F.sum(F.col("v") * F.col("i")) / (n * F.nullif(s, F.lit(0.0))) - (n + 1) / n).alias("gini"))


def cross_sub(active: DataFrame, sub: str, account: str, period: list[str]) -> DataFrame:
    """Share of a community's accounts that are active in another one in the same period."""
    a = active.select(*period, sub, account).dropna().distinct()
    k = a.groupBy(*period, account).agg(F.count("*").alias("k"))
    return a.join(k, [*period, account]).groupBy(*period, sub).agg((100 * rate(F.col("k") >= 2)).alias("cross_sub_rate"), F.count("*").alias("n_accounts"))


def network(p: DataFrame, active: DataFrame, sub: str = "sub", period: list[str] | None = None) -> DataFrame:
    period = period or ["month"]
    out = gini(p, [*period, sub], "score").join(cross_sub(active, sub, "author", period), [*period, sub])
    g = F.coalesce(F.col("gini"), F.lit(0.0)) * 100
    return out.withColumn("network_score", F.least(F.least(F.col("cross_sub_rate") / CROSS_SUB_P95 * 50, F.lit(50.0)) + F.least(g / GINI_P95 * 50, F.lit(50.0)), F.lit(100.0)))


def comment_ring(p: DataFrame, tagged: DataFrame) -> DataFrame:
    """Timing and recurrence of early and top commenters. ``tagged``: (post_id, sub, author, tag, ts, is_submitter), one row for each comment and tag."""
    first, top = tagged.filter("tag = 'first10'"), tagged.filter("tag = 'top10'")
    f = first.join(p.select("post_id", F.col("author").alias("poster"), F.col("created_utc").alias("t0")), "post_id")
    per = f.groupBy("post_id").agg(
        F.count("ts").alias("k"), F.stddev_samp((F.col("ts") - F.col("t0")) / 60).alias("sd"), ((F.min("ts") - F.max("t0")) / 60).alias("ttfc"),
        F.coalesce(F.bool_or(F.coalesce(F.col("is_submitter"), F.lit(False)) | F.coalesce(F.col("author") == F.col("poster"), F.lit(False))), F.lit(False)).alias("amp"),
    )
    who = first.select("post_id", "author").distinct()
    both = who.join(top.select("post_id", "author").distinct().withColumn("hit", F.lit(1)), ["post_id", "author"], "left").groupBy("post_id").agg((F.count("hit") / F.count("*")).alias("overlap"))
    often = top.groupBy("sub", "author").agg(F.countDistinct("post_id").alias("k")).filter("k >= 3").select("sub", "author")
    recur = top.join(often, ["sub", "author"], "left_semi").select("sub", "post_id").distinct().groupBy("sub").agg(F.count("*").alias("recur"))
    j = p.select("sub", "post_id").join(per, "post_id", "left").join(both, "post_id", "left")
    burst = F.when(F.col("k") >= 3, F.greatest(F.lit(0.0), 1 - F.col("sd") / 30) * 100)
    a = j.groupBy("sub").agg(
        F.count("*").alias("n_posts"), F.coalesce(F.avg("overlap"), F.lit(0.0)).alias("overlap_rate"), F.coalesce(F.avg(burst), F.lit(0.0)).alias("burst_score"), F.avg("ttfc").alias("avg_ttfc"),
        F.coalesce(100 * F.avg(F.when(F.col("ttfc").isNotNull(), F.when(F.col("ttfc") < 5, 1.0).otherwise(0.0))), F.lit(0.0)).alias("fast_pct"), rate(F.col("amp")).alias("self_amp_rate"),
    ).join(recur, "sub", "left")
    a = a.withColumn("recurrence_rate", F.coalesce(F.col("recur"), F.lit(0)) / F.col("n_posts")).drop("recur")
    return a.withColumn("ring_score", F.least(F.col("burst_score") * 0.6 + F.col("fast_pct") * 0.25 + F.col("recurrence_rate") * 10 + F.col("self_amp_rate") * 5, F.lit(100.0)))


def coordination(p: DataFrame, top: DataFrame, risky: DataFrame) -> DataFrame:
    """Shares of posts whose poster, commenters or both are high-risk accounts. ``risky``: (author)."""
    r = risky.select("author").distinct().withColumn("bad", F.lit(1))
    per = top.select("post_id", "author").distinct().join(r, "author", "left").groupBy("post_id").agg(F.count("bad").alias("b"), F.count("*").alias("k"))
    j = per.join(p.select("post_id", "sub", "author").join(r, "author", "left").select("post_id", "sub", F.col("bad").isNotNull().alias("poster")), "post_id")
    most, any_ = F.col("b") / F.col("k") >= 0.5, F.col("b") > 0
    pct = lambda c: 100 * rate(c)
    return j.groupBy("sub").agg(
        F.count("*").alias("n_posts"), pct(F.col("poster") & most).alias("both_pct"), pct(F.col("poster") & ~most).alias("poster_only_pct"), pct(~F.col("poster") & most).alias("commenter_only_pct"), pct(any_).alias("any_pct")
    )
