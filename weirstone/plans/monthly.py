"""Queries on prevalence, publishing and change over months."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weirstone.operators import accounts as A
from weirstone.operators import prevalence as P
from weirstone.operators import ranks
from weirstone.plans.base import Registry, all_posts, comments, posts, with_views

query = Registry()

#: Published bands of the combined series, fixed values.
BANDS = {"moderate": 10.66, "high": 14.63, "critical": 18.22}
WEIGHTS = {"removal_rate": 1.0, "submitter_rate": 0.5, "mean_depth": -0.5}

_SCORES = """
, n AS (SELECT author, count(*) AS n FROM (SELECT author FROM c UNION ALL SELECT author FROM p) GROUP BY 1),
f AS (SELECT author, avg(CASE WHEN meta_removal_type IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN is_submitter THEN 1.0::DOUBLE ELSE 0 END) AS b, avg(depth) AS d
      FROM c JOIN n USING (author) WHERE n >= 10 GROUP BY 1),
z AS (SELECT author, coalesce((a - avg(a) OVER ()) / nullif(stddev_pop(a) OVER (), 0), 0) + 0.5 * coalesce((b - avg(b) OVER ()) / nullif(stddev_pop(b) OVER (), 0), 0) - 0.5 * coalesce((d - avg(d) OVER ()) / nullif(stddev_pop(d) OVER (), 0), 0) AS raw FROM f),
sc AS (SELECT author, (raw - min(raw) OVER ()) / nullif(max(raw) OVER () - min(raw) OVER (), 0) AS score FROM z)
"""
_ROLES = _SCORES + """
, tp AS (SELECT sub, month, post_id, author FROM p WHERE role = 'top' QUALIFY row_number() OVER (PARTITION BY sub, month ORDER BY score DESC NULLS LAST, post_id) <= 100),
sd AS (SELECT tp.sub, tp.month, c.post_id, c.author, c.score, c.ts, c.comment_id FROM c JOIN tp USING (post_id)),
cm AS (SELECT sub, month, author FROM (SELECT * FROM sd QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY score DESC NULLS LAST, author, comment_id) <= 10)
       UNION SELECT sub, month, author FROM (SELECT * FROM sd QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY ts DESC NULLS LAST, author, comment_id) <= 10)),
rl AS (SELECT sub, month, author, 'poster' AS role FROM tp UNION ALL SELECT *, 'commenter' FROM cm UNION ALL SELECT *, 'combined' FROM (SELECT sub, month, author FROM tp UNION SELECT * FROM cm)),
pv AS (SELECT sub, month, role, count(*) AS n, count(score) AS n_scored, 100.0::DOUBLE * count(score) / count(*) AS coverage_pct,
   CASE WHEN count(score) >= 15 THEN avg(CASE WHEN score IS NULL THEN NULL WHEN score >= 0.7 THEN 100.0::DOUBLE ELSE 0 END) END AS pct_high_risk, CASE WHEN count(score) >= 15 THEN avg(score) END AS mean_score
   FROM rl LEFT JOIN sc USING (author) GROUP BY 1, 2, 3)
"""


def scores(spark, d):
    c, p = comments(spark, d), posts(spark, d)
    enough = c.select("author").unionByName(p.select("author")).groupBy("author").agg(F.count("*").alias("k")).filter(F.col("k") >= P.LEAST)
    f = c.groupBy("author").agg(A.rate(F.col("meta_removal_type").isNotNull()).alias("removal_rate"), A.rate(F.col("is_submitter")).alias("submitter_rate"), F.avg("depth").alias("mean_depth"))
    return P.linear_score(f.join(enough, "author", "left_semi"), "author", WEIGHTS)


def roles(spark, d):
    return P.prevalence(P.influencers(posts(spark, d), comments(spark, d)), scores(spark, d))


@query(with_views(_SCORES + "SELECT * FROM sc"))
def linear_scores(spark, d):
    return scores(spark, d)


@query(with_views("SELECT sub, month, post_id, row_number() OVER (PARTITION BY sub, month ORDER BY score DESC NULLS LAST, post_id) AS rn FROM p WHERE role = 'top' QUALIFY rn <= 100"))
def top_posts(spark, d):
    t = P.top_per_group(posts(spark, d).filter("role = 'top'"), ["sub", "month"], [F.desc_nulls_last("score"), F.col("post_id")], 100)
    return t.select("sub", "month", "post_id", F.col("rn").cast("bigint").alias("rn"))


@query(with_views("SELECT post_id, author, row_number() OVER (PARTITION BY post_id ORDER BY score DESC NULLS LAST, author, comment_id) AS rn FROM c QUALIFY rn <= 10"))
def top_commenters(spark, d):
    t = P.top_per_group(comments(spark, d), ["post_id"], [F.desc_nulls_last("score"), F.col("author"), F.col("comment_id")], 10)
    return t.select("post_id", "author", F.col("rn").cast("bigint").alias("rn"))


@query(with_views("SELECT post_id, author, row_number() OVER (PARTITION BY post_id ORDER BY ts DESC NULLS LAST, author, comment_id) AS rn FROM c QUALIFY rn <= 10"))
def latest_commenters(spark, d):
    t = P.top_per_group(comments(spark, d), ["post_id"], [F.desc_nulls_last("ts"), F.col("author"), F.col("comment_id")], 10)
    return t.select("post_id", "author", F.col("rn").cast("bigint").alias("rn"))


@query(with_views("SELECT post_id, author, rn FROM (SELECT post_id, author, row_number() OVER (PARTITION BY post_id ORDER BY t, author) AS rn FROM (SELECT post_id, author, min(ts) AS t FROM c WHERE ts IS NOT NULL GROUP BY 1, 2)) WHERE rn <= 10"))
def first_authors(spark, d):
    """The first ten distinct authors of each thread."""
    first = comments(spark, d).filter("ts IS NOT NULL").groupBy("post_id", "author").agg(F.min("ts").alias("t"))
    return P.top_per_group(first, ["post_id"], [F.col("t"), F.col("author")], 10).select("post_id", "author", F.col("rn").cast("bigint").alias("rn"))


@query(with_views(_ROLES + "SELECT * FROM pv"))
def prevalence_by_role(spark, d):
    return roles(spark, d)


_MEASURES = ["n", "n_scored", "coverage_pct", "pct_high_risk", "mean_score"]
_WIDE = ", ".join(f"max({m}) FILTER (WHERE role = '{r}') AS {r}_{m}" for r in ("poster", "commenter", "combined") for m in _MEASURES)


@query(with_views(_ROLES + f"SELECT sub, month, {_WIDE} FROM pv GROUP BY 1, 2"))
def prevalence_pivot(spark, d):
    return P.wide(roles(spark, d))


@query(with_views(_ROLES + f"SELECT sub, month, role, CASE WHEN pct_high_risk >= {BANDS['critical']} THEN 'critical' WHEN pct_high_risk >= {BANDS['high']} THEN 'high' WHEN pct_high_risk >= {BANDS['moderate']} THEN 'moderate' WHEN pct_high_risk IS NOT NULL THEN 'low' END AS severity FROM pv"))
def severity_label(spark, d):
    from weirstone.functions.metrics import band

    return roles(spark, d).select("sub", "month", "role", band(F.col("pct_high_risk"), **BANDS).alias("severity"))


@query(with_views(_ROLES + "SELECT role, count(pct_high_risk) AS n, quantile_cont(pct_high_risk, 0.5) AS moderate, quantile_cont(pct_high_risk, 0.8) AS high, quantile_cont(pct_high_risk, 0.95) AS critical FROM pv GROUP BY 1"))
def severity_bands(spark, d):
    """Bands from the cells' median and 80th and 95th percentile."""
    q = lambda x: F.percentile("pct_high_risk", F.lit(x))
    return roles(spark, d).groupBy("role").agg(F.count("pct_high_risk").alias("n"), q(0.5).alias("moderate"), q(0.8).alias("high"), q(0.95).alias("critical"))


@query(with_views(_ROLES + ", m AS (SELECT sub, month, pct_high_risk AS v, lag(pct_high_risk) OVER (PARTITION BY sub ORDER BY month) AS prev, lag(pct_high_risk, 3) OVER (PARTITION BY sub ORDER BY month) AS prev3 FROM pv WHERE role = 'combined' AND pct_high_risk IS NOT NULL) SELECT sub, month, v, v - prev AS delta, v - prev3 AS delta3, row_number() OVER (PARTITION BY month ORDER BY v DESC, sub) AS topper FROM m QUALIFY topper <= 5"))
def movers(spark, d):
    """The five communities with the highest rates of each month, and their change to the published month before and three before."""
    m = roles(spark, d).filter("role = 'combined' AND pct_high_risk IS NOT NULL")
    w = Window.partitionBy("sub").orderBy("month")
    v = F.col("pct_high_risk")
    m = m.select("sub", "month", v.alias("v"), (v - F.lag(v).over(w)).alias("delta"), (v - F.lag(v, 3).over(w)).alias("delta3"))
    return P.top_per_group(m, ["month"], [F.desc("v"), F.col("sub")], 5, "topper").withColumn("topper", F.col("topper").cast("bigint"))


@query(with_views("SELECT sub, month, avg(CASE WHEN meta_was_deleted_later THEN 1.0::DOUBLE ELSE 0 END) AS rate, count(*) AS n FROM c GROUP BY 1, 2"))
def self_delete_rate(spark, d):
    return comments(spark, d).groupBy("sub", "month").agg(A.rate(F.col("meta_was_deleted_later")).alias("rate"), F.count("*").alias("n"))


@query(with_views(", m AS (SELECT sub, month, median(subreddit_subscribers) AS subscribers FROM p0 WHERE sub IS NOT NULL AND month IS NOT NULL GROUP BY 1, 2) SELECT sub, month, subscribers, 100 * (subscribers / nullif(lag(subscribers) OVER (PARTITION BY sub ORDER BY month), 0) - 1) AS growth_pct FROM m"))
def subscriber_growth(spark, d):
    m = all_posts(spark, d).filter("sub IS NOT NULL AND month IS NOT NULL").groupBy("sub", "month").agg(F.median("subreddit_subscribers").alias("subscribers"))
    before = F.lag("subscribers").over(Window.partitionBy("sub").orderBy("month"))
    return m.withColumn("growth_pct", 100 * (F.try_divide(F.col("subscribers"), before) - 1))


@query(with_views(", m AS (SELECT sub, month, count(*) AS n FROM c WHERE sub IS NOT NULL AND month IS NOT NULL GROUP BY 1, 2) SELECT sub, month, n, avg(n) OVER w AS prev6, n < 0.5 * avg(n) OVER w AS cliff FROM m WINDOW w AS (PARTITION BY sub ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"))
def freshness(spark, d):
    """Comments of each month against the mean of up to six before it."""
    m = comments(spark, d).filter("sub IS NOT NULL AND month IS NOT NULL").groupBy("sub", "month").agg(F.count("*").alias("n"))
    prev = F.avg("n").over(Window.partitionBy("sub").orderBy("month").rowsBetween(-6, -1))
    return m.withColumns({"prev6": prev, "cliff": F.col("n") < 0.5 * prev})


@query(with_views(", a AS (SELECT DISTINCT author, month FROM c WHERE month IS NOT NULL), x AS (SELECT month, strftime((month || '-01')::DATE + INTERVAL 1 MONTH, '%Y-%m') AS next, author FROM a) SELECT x.month, count(*) AS n, count(a.author) AS kept, count(a.author) / count(*) AS retention FROM x LEFT JOIN a ON a.author = x.author AND a.month = x.next GROUP BY 1"))
def cohort_retention(spark, d):
    a = comments(spark, d).filter("month IS NOT NULL").select("author", "month").distinct()
    following = F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM")
    x = a.select("author", "month", following.alias("next"))
    j = x.join(a.select("author", F.col("month").alias("next"), F.lit(1).alias("there")), ["author", "next"], "left")
    return j.groupBy("month").agg(F.count("*").alias("n"), F.count("there").alias("kept"), (F.count("there") / F.count("*")).alias("retention"))


@query(with_views(", a AS (SELECT author, count(DISTINCT month) AS k FROM c GROUP BY 1) SELECT count(*) AS n, 100 * avg(CASE WHEN k >= 6 THEN 1.0::DOUBLE ELSE 0 END) AS pct_6, 100 * avg(CASE WHEN k >= 2 THEN 1.0::DOUBLE ELSE 0 END) AS pct_2 FROM a"))
def persistence(spark, d):
    a = comments(spark, d).groupBy("author").agg(F.countDistinct("month").alias("k"))
    return a.agg(F.count("*").alias("n"), (100 * A.rate(F.col("k") >= 6)).alias("pct_6"), (100 * A.rate(F.col("k") >= 2)).alias("pct_2"))


@query(with_views(_SCORES + ", m AS (SELECT DISTINCT c.month, author, sc.score AS score FROM c JOIN sc USING (author) WHERE month IS NOT NULL), q AS (SELECT month, count(*) AS n, quantile_cont(score, 0.9) AS p90 FROM m GROUP BY 1), g AS (SELECT quantile_cont(score, 0.9) AS all90 FROM sc) SELECT m.month, m.author, score >= CASE WHEN n >= 10 THEN p90 ELSE all90 END AS high_risk FROM m JOIN q USING (month), g"))
def month_relative_high_risk(spark, d):
    """High risk within the month's active accounts: over their 90th percentile, or everyone's where fewer than ten are active."""
    s = scores(spark, d)
    m = comments(spark, d).filter("month IS NOT NULL").select("author", "month").distinct().join(s, "author")
    q = m.groupBy("month").agg(F.count("*").alias("n"), F.percentile("score", F.lit(0.9)).alias("p90"))
    g = ranks.quantile_row(s, "score", {"all90": 0.9})
    limit = F.when(F.col("n") >= 10, F.col("p90")).otherwise(F.col("all90"))
    return m.join(q, "month").join(F.broadcast(g)).select("month", "author", (F.col("score") >= limit).alias("high_risk"))


@query(with_views(_SCORES + ", a AS (SELECT sub, month, author FROM c UNION ALL SELECT sub, month, author FROM p) SELECT sub, month, avg(score) AS mean_score, count(*) AS n FROM a JOIN sc USING (author) GROUP BY 1, 2"))
def activity_rollup(spark, d):
    keys = ["sub", "month", "author"]
    both = comments(spark, d).select(*keys).unionByName(posts(spark, d).select(*keys))
    return both.join(scores(spark, d), "author").groupBy("sub", "month").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n"))


@query(with_views(_SCORES + ", k AS (SELECT sub, month, author, count(*) AS w FROM c GROUP BY 1, 2, 3) SELECT sub, month, sum(score * w) / sum(w) AS weighted, count(*) AS accounts, sum(w)::BIGINT AS comments FROM k JOIN sc USING (author) GROUP BY 1, 2 HAVING count(*) >= 15"))
def weighted_mean_score(spark, d):
    k = comments(spark, d).groupBy("sub", "month", "author").agg(F.count("*").alias("w")).join(scores(spark, d), "author")
    return k.groupBy("sub", "month").agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("weighted"), F.count("*").alias("accounts"), F.sum("w").alias("comments")).filter("accounts >= 15")


@query(with_views(", m AS (SELECT sub, month, avg(score) AS v FROM p WHERE sub IS NOT NULL AND month IS NOT NULL GROUP BY 1, 2), x AS (SELECT sub, v, row_number() OVER (PARTITION BY sub ORDER BY month) AS i FROM m) SELECT sub, count(*) AS n, regr_slope(v, i) AS slope, CASE WHEN max(v) > min(v) AND count(*) > 1 THEN regr_r2(v, i) END AS r2, (max(v) - min(v)) / nullif(avg(v), 0) AS swing FROM x GROUP BY 1"))
def monthly_stability(spark, d):
    m = posts(spark, d).filter("sub IS NOT NULL AND month IS NOT NULL").groupBy("sub", "month").agg(F.avg("score").alias("v"))
    x = m.withColumn("i", F.row_number().over(Window.partitionBy("sub").orderBy("month")))
    r2 = F.when((F.max("v") > F.min("v")) & (F.count("*") > 1), F.regr_r2("v", "i"))
    return x.groupBy("sub").agg(F.count("*").alias("n"), F.regr_slope("v", "i").alias("slope"), r2.alias("r2"), F.try_divide(F.max("v") - F.min("v"), F.avg("v")).alias("swing"))
