"""The flagship on a pinned model, and publishing: frozen bands, months written once, history and changes from what was published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.operators import accounts as A
from weirstone.operators import models as L
from weirstone.operators import prevalence as P
from weirstone.operators import publish as B
from weirstone.plans import monthly
from weirstone.plans.base import Registry, comments, posts, with_views
from weirstone.session import shared_path, written

query = Registry()

#: The pinned model: a logistic form with the medians that stand for nulls. It changes with a new version only.
PINNED = {
    "version": "m1", "features": ["removal_rate", "submitter_rate", "mean_depth", "mean_body_len"], "coefficients": [9.0, 1.5, -0.4, 0.002], "intercept": -0.2,
    "medians": {"removal_rate": 0.05, "submitter_rate": 0.0, "mean_depth": 0.5, "mean_body_len": 120.0},
}
SERIES, VALUE = "s1", "pct_high_risk"

_PINNED = """
, n AS (SELECT author, count(*) AS n FROM (SELECT author FROM c UNION ALL SELECT author FROM p) GROUP BY 1),
f AS (SELECT author, avg(CASE WHEN meta_removal_type IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN is_submitter THEN 1.0::DOUBLE ELSE 0 END) AS b, avg(depth) AS d, avg(body_len) AS l
      FROM c JOIN n USING (author) WHERE n >= 10 GROUP BY 1),
sc AS (SELECT author, 1 / (1 + exp(-(-0.2 + 9.0 * coalesce(a, 0.05) + 1.5 * coalesce(b, 0.0) - 0.4 * coalesce(d, 0.5) + 0.002 * coalesce(l, 120.0)))) AS score FROM f)
"""
_CELLS = _PINNED + monthly._ROLES[len(monthly._SCORES) :]


def scores(spark, d) -> DataFrame:
    """Accounts with ten contributions or more, scored by the model that is pinned, read back and checked."""
    path = shared_path(spark, "model") + "/model.json"
    L.pin_linear(spark, path, PINNED)
    c, p = comments(spark, d), posts(spark, d)
    enough = c.select("author").unionByName(p.select("author")).groupBy("author").agg(F.count("*").alias("k")).filter(F.col("k") >= P.LEAST)
    f = c.groupBy("author").agg(
        A.rate(F.col("meta_removal_type").isNotNull()).alias("removal_rate"), A.rate(F.col("is_submitter")).alias("submitter_rate"), F.avg("depth").alias("mean_depth"), F.avg("body_len").alias("mean_body_len")
    )
    return L.score_linear(f.join(enough, "author", "left_semi"), L.load_linear(spark, path), "author")


def cells(spark, d) -> DataFrame:
    return P.prevalence(P.influencers(posts(spark, d), comments(spark, d)), scores(spark, d))


@query(with_views(_PINNED + "SELECT author, round(score, 9) AS score FROM sc"))
def pinned_scores(spark, d):
    return scores(spark, d).select("author", F.round("score", 9).alias("score"))


@query(with_views(_CELLS + "SELECT * FROM pv"))
def prevalence_pinned(spark, d):
    """The share of high-risk accounts by community, month and role, on the pinned model."""
    return cells(spark, d)


def published(spark, d) -> tuple[DataFrame, DataFrame]:
    """(published cells, bands) after two runs: the first half of the months, then all of them; the second run finds the bands and the months that are there."""
    folder = shared_path(spark, "series")
    all_ = written(cells(spark, d).filter("sub IS NOT NULL AND month IS NOT NULL"))
    months = sorted(r.month for r in all_.select("month").distinct().collect())  # one row a month
    bands = None
    for run, upto in (("run 1", months[: (len(months) + 1) // 2]), ("run 2", months)):
        part = all_.filter(F.col("month").isin(upto)) if upto else all_
        bands = B.frozen_bands(spark, f"{folder}/bands", part, VALUE, PINNED["version"])
        B.publish(spark, f"{folder}/cells", B.role_blocks(B.severity(part, bands, VALUE), VALUE), SERIES, run)
    kept = B.read_if_there(spark, f"{folder}/cells")
    return (kept if kept is not None else B.role_blocks(B.severity(all_, bands, VALUE), VALUE).limit(0).withColumns({"series": F.lit(SERIES), "first_published": F.lit("")})), bands


_PUBLISHED = _CELLS + """
, cl AS (SELECT * FROM pv WHERE sub IS NOT NULL AND month IS NOT NULL), ms AS (SELECT month, dense_rank() OVER (ORDER BY month) AS i FROM (SELECT DISTINCT month FROM cl)),
hm AS (SELECT max(month) AS upto FROM ms WHERE i <= ((SELECT max(i) FROM ms) + 1) // 2),
bd AS (SELECT role, count(pct_high_risk) AS n, CASE WHEN count(pct_high_risk) < 20 THEN 20 ELSE quantile_cont(pct_high_risk, 0.5) END AS moderate, CASE WHEN count(pct_high_risk) < 20 THEN 40 ELSE quantile_cont(pct_high_risk, 0.8) END AS high,
         CASE WHEN count(pct_high_risk) < 20 THEN 70 ELSE quantile_cont(pct_high_risk, 0.95) END AS critical, min(month) AS since, max(month) AS until FROM cl, hm WHERE month <= upto GROUP BY 1),
pb AS (SELECT 's1' AS series, sub, month, role, CASE WHEN pct_high_risk IS NULL THEN 0 ELSE cl.n END AS n, pct_high_risk, mean_score,
         CASE WHEN pct_high_risk >= critical THEN 'critical' WHEN pct_high_risk >= high THEN 'high' WHEN pct_high_risk >= moderate THEN 'moderate' WHEN pct_high_risk IS NOT NULL THEN 'low' END AS severity,
         CASE WHEN month <= upto THEN 'run 1' ELSE 'run 2' END AS first_published FROM cl LEFT JOIN bd USING (role), hm)
"""


@query(with_views(_PUBLISHED + "SELECT series, sub, month, role, n, pct_high_risk, severity, first_published FROM pb"))
def published_cells(spark, d):
    """Cells as published: severities by bands that the first run froze; a cell without a rate counts no accounts."""
    return published(spark, d)[0].select("series", "sub", "month", "role", "n", "pct_high_risk", "severity", "first_published")


@query(with_views(_PUBLISHED + "SELECT role, n, moderate::DOUBLE AS moderate, high::DOUBLE AS high, critical::DOUBLE AS critical, since, until, 'm1' AS version FROM bd"))
def frozen_bands(spark, d):
    return published(spark, d)[1]


@query(with_views(_PUBLISHED + "SELECT series, month, min(first_published) AS first_published, count(*) AS cells FROM pb GROUP BY 1, 2"))
def month_manifest(spark, d):
    return B.manifest(published(spark, d)[0])


@query(with_views(_PUBLISHED + "SELECT sub, month, role, pct_high_risk - lag(pct_high_risk) OVER w AS delta, pct_high_risk - lag(pct_high_risk, 3) OVER w AS delta3 FROM pb WINDOW w AS (PARTITION BY series, role, sub ORDER BY month)"))
def published_changes(spark, d):
    """Changes to the published month before and three before."""
    return B.changes(published(spark, d)[0], VALUE).select("sub", "month", "role", "delta", "delta3")


@query(with_views(_PUBLISHED + """SELECT month, avg(pct_high_risk) FILTER (WHERE role = 'combined') AS avg_score, avg(pct_high_risk) FILTER (WHERE role = 'poster') AS poster_avg,
 avg(pct_high_risk) FILTER (WHERE role = 'commenter') AS commenter_avg, count(*) FILTER (WHERE role = 'combined' AND severity IN ('high', 'critical')) AS n_high FROM pb GROUP BY 1"""))
def published_history(spark, d):
    """Averages by month, from what was published."""
    at = lambda r: F.avg(F.when(F.col("role") == r, F.col(VALUE)))
    high = F.count_if((F.col("role") == "combined") & F.col("severity").isin("high", "critical"))
    return published(spark, d)[0].groupBy("month").agg(at("combined").alias("avg_score"), at("poster").alias("poster_avg"), at("commenter").alias("commenter_avg"), high.alias("n_high"))


@query(with_views(_PUBLISHED + "SELECT series, month, sub, role, 'severity' AS why FROM pb WHERE n < 0"))
def published_faults(spark, d):
    """Published cells that break a rule; there are none."""
    cells_, bands = published(spark, d)
    return B.inconsistencies(cells_, bands, VALUE)
