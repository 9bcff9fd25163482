"""Queries that put the signals of communities together: unified scores, comparisons, histories, back-tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirstone.operators import accounts as A
from weirstone.operators import signals as S
from weirstone.operators import stats
from weirstone.plans import monthly, research
from weirstone.plans.base import Registry, all_posts, comments, posts, with_views

query = Registry()
_R, _M = research.query.sql, monthly.query.sql

#: The weights of the first unified score and its limits of severity.
PARTS = {"user_score": 0.40, "engagement_score": 0.25, "temporal_score": 0.20, "distribution_score": 0.15}
SEVERITY = {"CRITICAL": 70, "HIGH": 40, "MODERATE": 20}


def severity_of(score) -> F.Column:
    s = F.when(score >= SEVERITY["CRITICAL"], "CRITICAL")
    return s.when(score >= SEVERITY["HIGH"], "HIGH").when(score >= SEVERITY["MODERATE"], "MODERATE").otherwise("LOW")


_SEVERITY = "CASE WHEN {0} >= 70 THEN 'CRITICAL' WHEN {0} >= 40 THEN 'HIGH' WHEN {0} >= 20 THEN 'MODERATE' ELSE 'LOW' END"


# accounts behind a community's posts and top comments

_KINDS = """
, st AS (SELECT author, avg(CASE WHEN meta_removal_type IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS r, min(ts) AS seen FROM c GROUP BY 1),
fl AS (SELECT author, r >= 0.2 AS susp, r >= 0.5 AS very, regexp_matches(author, '^[A-Z][a-z]+[-_]?[A-Z][a-z0-9]+[-_]?\\d{2,6}$') AS plain, coalesce(seen >= max(seen) OVER () - 90 * 86400, FALSE) AS fresh FROM st),
po AS (SELECT sub, count(*) AS n_posters, 100 * avg(susp::INT) AS a, 100 * avg(very::INT) AS b, 100 * avg(plain::INT) AS g, 100 * avg(fresh::INT) AS h FROM p JOIN fl USING (author) WHERE sub IS NOT NULL GROUP BY 1),
co AS (SELECT sub, count(*) AS n_commenters, 100 * avg(susp::INT) AS a, 100 * avg(very::INT) AS b, 100 * avg(plain::INT) AS g, 100 * avg(fresh::INT) AS h
       FROM (SELECT sub, author FROM c WHERE sub IS NOT NULL AND commenter_tag = 'top10') JOIN fl USING (author) GROUP BY 1),
ac AS (SELECT sub, coalesce(n_posters, 0) AS n_posters, coalesce(n_commenters, 0) AS n_commenters,
         coalesce(least(po.a + po.b * 0.3 + po.g * 0.5 + po.h * 0.4, 100), 0) AS poster_score, coalesce(least(co.a + co.b * 0.3 + co.g * 0.5 + co.h * 0.4, 100), 0) AS commenter_score
       FROM po FULL JOIN co USING (sub)),
ap AS (SELECT *, CASE WHEN n_commenters > 0 THEN poster_score * 0.4 + commenter_score * 0.6 ELSE poster_score END AS account_score FROM ac)
"""


def account_parts(spark, d) -> DataFrame:
    c, p = comments(spark, d), posts(spark, d)
    s = c.groupBy("author").agg(A.rate(F.col("meta_removal_type").isNotNull()).alias("r"), F.min("ts").alias("seen"))
    last = s.agg(F.max("seen").alias("last"))  # one row
    name = A.name_shape(s, "author").select("author", F.col("default_pattern").alias("plain"))
    fresh = F.coalesce(F.col("seen") >= F.col("last") - 90 * 86400, F.lit(False))
    flags = s.join(F.broadcast(last)).select("author", (F.col("r") >= 0.2).alias("susp"), (F.col("r") >= 0.5).alias("very"), fresh.alias("fresh")).join(name, "author")
    points = F.least(sum((100 * A.rate(F.col(f)) * w for f, w in (("susp", 1.0), ("very", 0.3), ("plain", 0.5), ("fresh", 0.4))), F.lit(0.0)), F.lit(100.0))
    side = lambda df, who: df.filter("sub IS NOT NULL").select("sub", "author").join(flags, "author").groupBy("sub").agg(F.count("*").alias(f"n_{who}s"), points.alias(f"{who}_score"))
    both = side(p, "poster").join(side(c.filter("commenter_tag = 'top10'"), "commenter"), "sub", "full").fillna(0)
    score = F.when(F.col("n_commenters") > 0, F.col("poster_score") * 0.4 + F.col("commenter_score") * 0.6).otherwise(F.col("poster_score"))
    return both.withColumn("account_score", score)


@query(with_views(_KINDS + "SELECT * FROM ap"))
def account_component(spark, d):
    """Posters at 40 % and top commenters at 60 %. Karma and age aren't in the tables; removals, default names and late first sight stand for them."""
    return account_parts(spark, d)


_UNIFIED = (
    f"WITH u AS ({with_views(_KINDS + 'SELECT sub, account_score AS user_score FROM ap')}), e AS (SELECT sub, avg(engagement_score_v1) AS engagement_score FROM ({_R['ucr_engagement']}) GROUP BY 1),"
    f" t AS (SELECT sub, temporal_score FROM ({_R['hour_entropy']})), x AS (SELECT sub, distribution_score_v1 AS distribution_score FROM ({_R['rank_decay']})),"
    " f AS (SELECT *, user_score * 0.40 + engagement_score * 0.25 + temporal_score * 0.20 + distribution_score * 0.15 AS final_score FROM u JOIN e USING (sub) JOIN t USING (sub) JOIN x USING (sub))"
)


@query(_UNIFIED + f" SELECT *, {_SEVERITY.format('final_score')} AS severity FROM f")
def unified_v1(spark, d):
    p = posts(spark, d)
    e = S.engagement(p, ["sub", "month"]).groupBy("sub").agg(F.avg("engagement_score_v1").alias("engagement_score"))
    t = S.temporal(p.filter("sub IS NOT NULL"), ["sub"]).select("sub", "temporal_score")
    x = S.distribution(p.filter("sub IS NOT NULL"), ["sub"]).select("sub", F.col("distribution_score_v1").alias("distribution_score"))
    j = account_parts(spark, d).select("sub", F.col("account_score").alias("user_score")).join(e, "sub").join(t, "sub").join(x, "sub")
    final = sum((F.col(k) * w for k, w in PARTS.items()), F.lit(0.0))
    return j.withColumn("final_score", final).withColumn("severity", severity_of(F.col("final_score")))


# month-relative risk

_RISK = f"""
WITH hr AS ({_M['month_relative_high_risk']}), {{views}},
ac AS (SELECT sub, month, author FROM c WHERE sub IS NOT NULL AND month IS NOT NULL UNION ALL SELECT sub, month, author FROM p WHERE sub IS NOT NULL AND month IS NOT NULL AND role = 'top'),
rr AS (SELECT sub, ac.month, count(*) AS n_activity, 100 * avg(high_risk::INT) AS pct_high_risk FROM ac JOIN hr ON hr.month = ac.month AND hr.author = ac.author GROUP BY 1, 2)
"""


def _with_risk(body: str) -> str:
    from weirstone.plans.base import VIEWS

    return _RISK.replace("{views}", VIEWS) + body


def risk_rows(spark, d) -> DataFrame:
    risk = monthly.month_relative_high_risk(spark, d)
    keys = ["sub", "month", "author"]
    a = comments(spark, d).select(*keys).unionByName(posts(spark, d).filter("role = 'top'").select(*keys)).dropna(subset=["sub", "month"])
    return a.join(risk, ["month", "author"])


def risk_rollup_rows(spark, d) -> DataFrame:
    return risk_rows(spark, d).groupBy("sub", "month").agg(F.count("*").alias("n_activity"), (100 * A.rate(F.col("high_risk"))).alias("pct_high_risk"))


@query(_with_risk("SELECT * FROM rr"))
def risk_rollup(spark, d):
    """Share of a community's activity that comes from the month's high-risk accounts."""
    return risk_rollup_rows(spark, d)


@query(_with_risk(f"SELECT month, {_SEVERITY.format('pct_high_risk')} AS severity, count(*) AS n FROM rr GROUP BY 1, 2"))
def severity_history(spark, d):
    return risk_rollup_rows(spark, d).groupBy("month", severity_of(F.col("pct_high_risk")).alias("severity")).agg(F.count("*").alias("n"))


@query(_with_risk("""
, b AS (SELECT p.sub, count(*) FILTER (WHERE role = 'top') AS n_top, count(*) FILTER (WHERE role IS DISTINCT FROM 'top') AS n_other, avg(high_risk::INT) FILTER (WHERE role = 'top') AS t, avg(high_risk::INT) FILTER (WHERE role IS DISTINCT FROM 'top') AS o
        FROM p LEFT JOIN hr ON hr.author = p.author AND hr.month = p.month WHERE p.sub IS NOT NULL GROUP BY 1)
SELECT sub, n_top, n_other, CASE WHEN n_top > 0 AND n_other >= 5 THEN 100 * t END AS top_pct, CASE WHEN n_top > 0 AND n_other >= 5 THEN 100 * o END AS other_pct,
 CASE WHEN n_top > 0 AND n_other >= 5 AND o > 0 THEN t / o END AS ratio FROM b"""))
def baseline_comparison(spark, d):
    """Posters of top posts against those of the others, where at least five others are known."""
    p = posts(spark, d).filter("sub IS NOT NULL").select("sub", "month", "author", F.coalesce(F.col("role") == "top", F.lit(False)).alias("top"))
    j = p.join(monthly.month_relative_high_risk(spark, d), ["author", "month"], "left")
    mean = lambda top: F.avg(F.when(F.col("top") == top, F.col("high_risk").cast("int")))
    b = j.groupBy("sub").agg(F.count_if("top").alias("n_top"), F.count_if(~F.col("top")).alias("n_other"), mean(True).alias("t"), mean(False).alias("o"))
    ok = (F.col("n_top") > 0) & (F.col("n_other") >= 5)
    ratio = F.when(ok & (F.col("o") > 0), F.col("t") / F.col("o"))
    return b.select("sub", "n_top", "n_other", F.when(ok, 100 * F.col("t")).alias("top_pct"), F.when(ok, 100 * F.col("o")).alias("other_pct"), ratio.alias("ratio"))


_ROW = (
    f"WITH r AS ({_with_risk('SELECT * FROM rr')}), g AS ({_R['ucr_engagement']}), n AS ({_R['network_signals']}), t AS ({_R['hour_entropy']}), x AS ({_R['rank_decay']}), k AS ({_R['comment_ring']}), s AS ({_R['astroturf_shares']})"
    " SELECT r.sub, r.month, pct_high_risk AS final_score, n_activity, engagement_score, network_score, temporal_score, ring_score, distribution_score, both_pct, commenter_only_pct"
    " FROM r LEFT JOIN g ON g.sub = r.sub AND g.month = r.month LEFT JOIN n ON n.sub = r.sub AND n.month = r.month LEFT JOIN t ON t.sub = r.sub LEFT JOIN x ON x.sub = r.sub LEFT JOIN k ON k.sub = r.sub LEFT JOIN s ON s.sub = r.sub"
)


def rows(spark, d) -> DataFrame:
    p = posts(spark, d)
    named = p.filter("sub IS NOT NULL")
    out = risk_rollup_rows(spark, d).withColumnRenamed("pct_high_risk", "final_score")
    out = out.join(S.engagement(p, ["sub", "month"]).select("sub", "month", "engagement_score"), ["sub", "month"], "left")
    out = out.join(research.network_signals(spark, d).select("sub", "month", "network_score"), ["sub", "month"], "left")
    for part, cols in (
        (S.temporal(named, ["sub"]), ["temporal_score"]), (research.comment_ring(spark, d), ["ring_score"]), (S.distribution(named, ["sub"]), ["distribution_score"]),
        (research.astroturf_shares(spark, d), ["both_pct", "commenter_only_pct"]),
    ):
        out = out.join(part.select("sub", *cols), "sub", "left")
    return out.select("sub", "month", "final_score", "n_activity", "engagement_score", "network_score", "temporal_score", "ring_score", "distribution_score", "both_pct", "commenter_only_pct")


@query(_ROW)
def unified_rows(spark, d):
    """One row a community and month: the score is the risk roll-up, all else is detail beside it."""
    return rows(spark, d)


SIGNALS = ["final_score", "engagement_score", "network_score"]
_CV = ", ".join(f"coalesce(stddev_samp({s}) / nullif(abs(avg({s})), 0), 0) AS c{i}" for i, s in enumerate(SIGNALS))


@query(f"""WITH z AS ({_ROW}), m AS (SELECT sub, {", ".join(f"avg({s}) AS {s}" for s in SIGNALS)} FROM z GROUP BY 1), v AS (SELECT {_CV} FROM m),
w AS (SELECT {", ".join(f"greatest(0.08, least(0.42, c{i} / nullif(c0 + c1 + c2, 0))) AS w{i}" for i in range(3))} FROM v)
{" UNION ALL ".join(f"SELECT '{s}' AS signal, w{i} / (w0 + w1 + w2) AS weight FROM w" for i, s in enumerate(SIGNALS))}""")
def signal_weights(spark, d):
    """Weights by how much a signal tells communities apart: its variation over theirs all, kept within 0.08 and 0.42 and brought to a sum of 1."""
    m = rows(spark, d).groupBy("sub").agg(*[F.avg(s).alias(s) for s in SIGNALS])
    v = m.agg(*[F.coalesce(F.try_divide(F.stddev_samp(s), F.abs(F.avg(s))), F.lit(0.0)).alias(f"c{i}") for i, s in enumerate(SIGNALS)])
    total = F.nullif(F.col("c0") + F.col("c1") + F.col("c2"), F.lit(0.0))
    w = v.select(*[F.greatest(F.lit(0.08), F.least(F.lit(0.42), F.col(f"c{i}") / total)).alias(f"w{i}") for i in range(3)])
    each = F.array(*[F.struct(F.lit(s).alias("signal"), (F.col(f"w{i}") / (F.col("w0") + F.col("w1") + F.col("w2"))).alias("weight")) for i, s in enumerate(SIGNALS)])
    return w.select(F.inline(each))


@query(f"""WITH z AS ({_ROW}), k AS (SELECT *, dense_rank() OVER (ORDER BY month DESC) AS r FROM z),
a AS (SELECT sub, avg(final_score) AS base, avg(final_score) FILTER (WHERE r <= 3) AS recent FROM k GROUP BY 1), e AS (SELECT min(base) AS lo, max(base) AS hi FROM a)
SELECT sub, base, recent, (recent - base) / nullif(hi - lo, 0) AS velocity FROM a, e""")
def risk_velocity(spark, d):
    """The last three months against all, in units of the communities' range."""
    z = rows(spark, d).select("sub", "month", "final_score")
    months = z.select("month").distinct().withColumn("r", F.row_number().over(Window.orderBy(F.desc("month"))))  # one row a month
    k = z.join(F.broadcast(months), "month")
    a = k.groupBy("sub").agg(F.avg("final_score").alias("base"), F.avg(F.when(F.col("r") <= 3, F.col("final_score"))).alias("recent"))
    e = a.agg(F.min("base").alias("lo"), F.max("base").alias("hi"))
    return a.join(F.broadcast(e)).select("sub", "base", "recent", F.try_divide(F.col("recent") - F.col("base"), F.col("hi") - F.col("lo")).alias("velocity"))


_RANK = "(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2)"


@query(f"""WITH z AS ({_ROW}), k AS (SELECT *, dense_rank() OVER (ORDER BY month) AS r FROM z), h AS (SELECT max(r) AS n FROM k),
a AS (SELECT sub, avg(final_score) FILTER (WHERE r <= n / 2.0) AS early, avg(final_score) FILTER (WHERE r > n / 2.0) AS late FROM k, h GROUP BY 1),
b AS (SELECT {_RANK.format(x='early')} AS re, {_RANK.format(x='late')} AS rl FROM a WHERE early IS NOT NULL AND late IS NOT NULL)
SELECT round(corr(re, rl), 9) AS rho, count(*) AS n, CASE WHEN count(*) >= 5 AND corr(re, rl) >= 0.5 THEN 'stable' ELSE 'not shown' END AS verdict FROM b""")
def backtest(spark, d):
    """Whether the order of communities in the earlier half of the months holds in the later half."""
    z = rows(spark, d).select("sub", "month", "final_score")
    months = z.select("month").distinct().withColumn("r", F.row_number().over(Window.orderBy("month")))  # one row a month
    k = z.join(F.broadcast(months), "month").join(F.broadcast(months.agg(F.max("r").alias("n"))))
    early = F.col("r") <= F.col("n") / 2
    a = k.groupBy("sub").agg(F.avg(F.when(early, F.col("final_score"))).alias("early"), F.avg(F.when(~early, F.col("final_score"))).alias("late"))
    s = stats.spearman(a, "sub", "early", "late")
    verdict = F.when((F.col("n") >= 5) & F.coalesce(F.col("rho") >= 0.5, F.lit(False)), "stable").otherwise("not shown")
    return s.select(F.round("rho", 9).alias("rho"), "n", verdict.alias("verdict"))


@query(f"""WITH z AS ({_ROW}), k AS (SELECT sub, month, engagement_score AS v, row_number() OVER (PARTITION BY sub ORDER BY month DESC) AS r FROM z WHERE engagement_score IS NOT NULL)
SELECT sub, max(month) FILTER (WHERE r = 1) AS month, max(v) FILTER (WHERE r = 1) AS latest, max(v) FILTER (WHERE r = 1) - max(v) FILTER (WHERE r = 7) AS delta6 FROM k GROUP BY 1""")
def latest_values(spark, d):
    """The latest known value of each community and its change to six known months earlier."""
    k = rows(spark, d).select("sub", "month", F.col("engagement_score").alias("v")).filter("v IS NOT NULL")
    k = k.withColumn("r", F.row_number().over(Window.partitionBy("sub").orderBy(F.desc("month"))))
    at = lambda n, c: F.max(F.when(F.col("r") == n, F.col(c)))
    return k.groupBy("sub").agg(at(1, "month").alias("month"), at(1, "v").alias("latest"), (at(1, "v") - at(7, "v")).alias("delta6"))


# accounts over both tables

@query(with_views("""
, a AS (SELECT author, count(*) AS n_posts FROM p GROUP BY 1),
b AS (SELECT author, count(*) AS n_comments, avg(CASE WHEN commenter_tag = 'first10' THEN 1.0::DOUBLE ELSE 0 END) AS pct_first, avg(CASE WHEN commenter_tag = 'top10' THEN 1.0::DOUBLE ELSE 0 END) AS pct_top, avg(depth) AS mean_depth FROM c GROUP BY 1),
u AS (SELECT author, sub, month FROM p UNION ALL SELECT author, sub, month FROM c), s AS (SELECT author, count(DISTINCT sub) AS n_subs, count(DISTINCT month) AS n_months FROM u GROUP BY 1)
SELECT author, coalesce(n_posts, 0) AS n_posts, coalesce(n_comments, 0) AS n_comments, coalesce(pct_first, 0) AS pct_first, coalesce(pct_top, 0) AS pct_top, coalesce(mean_depth, 0) AS mean_depth,
 n_subs, n_months, coalesce(n_posts, 0) + coalesce(n_comments, 0) AS n_messages FROM a FULL JOIN b USING (author) JOIN s USING (author)"""))
def account_overview(spark, d):
    """Posters and commenters in one row each; communities and months over both."""
    p, c = posts(spark, d), comments(spark, d)
    a = p.groupBy("author").agg(F.count("*").alias("n_posts"))
    tagged = lambda t: A.rate(F.col("commenter_tag") == t)
    b = c.groupBy("author").agg(F.count("*").alias("n_comments"), tagged("first10").alias("pct_first"), tagged("top10").alias("pct_top"), F.avg("depth").alias("mean_depth"))
    u = p.select("author", "sub", "month").unionByName(c.select("author", "sub", "month"))
    s = u.groupBy("author").agg(F.countDistinct("sub").alias("n_subs"), F.countDistinct("month").alias("n_months"))
    both = a.join(b, "author", "full").fillna(0).join(s, "author")
    return both.withColumn("n_messages", F.col("n_posts") + F.col("n_comments"))


@query(with_views("""
, k AS (SELECT month, author, count(DISTINCT sub) AS n FROM (SELECT month, sub, author FROM c UNION ALL SELECT month, sub, author FROM p) WHERE month IS NOT NULL GROUP BY 1, 2)
SELECT month, count(*) AS accounts, count(*) FILTER (WHERE n >= 3) AS in3, count(*) FILTER (WHERE n >= 5) AS in5, count(*) FILTER (WHERE n >= 8) AS in8 FROM k GROUP BY 1"""))
def community_spread(spark, d):
    """Accounts seen in three, five and eight communities of a month."""
    keys = ["month", "sub", "author"]
    a = comments(spark, d).select(*keys).unionByName(posts(spark, d).select(*keys)).filter("month IS NOT NULL")
    k = a.groupBy("month", "author").agg(F.countDistinct("sub").alias("n"))
    return k.groupBy("month").agg(F.count("*").alias("accounts"), *[F.count_if(F.col("n") >= x).alias(f"in{x}") for x in (3, 5, 8)])


@query(with_views("""
, a AS (SELECT sub, author, count(*) AS n_appearances, count(DISTINCT post_id) AS n_threads, avg(score) AS mean_score, median(score) AS median_score, avg(CASE WHEN parent_is_post THEN 1.0::DOUBLE ELSE 0 END) AS pct_toplevel,
  avg(CASE WHEN commenter_tag = 'first10' THEN 1.0::DOUBLE ELSE 0 END) AS pct_first10, avg(CASE WHEN role = 'top' THEN 1.0::DOUBLE ELSE 0 END) AS pct_top_role, bool_or(author_fullname IS NOT NULL) AS has_fullname FROM c WHERE sub IS NOT NULL GROUP BY 1, 2),
t AS (SELECT sub, min(incentive_tier) AS tier FROM p0 WHERE sub IS NOT NULL GROUP BY 1) SELECT a.*, tier FROM a LEFT JOIN t USING (sub)"""))
def pilot_accounts(spark, d):
    c = comments(spark, d).filter("sub IS NOT NULL")
    a = c.groupBy("sub", "author").agg(
        F.count("*").alias("n_appearances"), F.countDistinct("post_id").alias("n_threads"), F.avg("score").alias("mean_score"), F.median("score").alias("median_score"), A.rate(F.col("parent_is_post")).alias("pct_toplevel"),
        A.rate(F.col("commenter_tag") == "first10").alias("pct_first10"), A.rate(F.col("role") == "top").alias("pct_top_role"), F.bool_or(F.col("author_fullname").isNotNull()).alias("has_fullname"),
    )
    return a.join(all_posts(spark, d).filter("sub IS NOT NULL").groupBy("sub").agg(F.min("incentive_tier").alias("tier")), "sub", "left")
