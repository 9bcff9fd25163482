"""Queries with models. Labels: an account is positive if some of its comments were deleted later."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirstone.operators import accounts as A
from weirstone.operators import models as L
from weirstone.plans.base import Registry, all_posts, comments, with_views
from weirstone.plans.research import _EDGES, edges
from weirstone.sources.tables import table

query = Registry()
#: Trees of the registered model, as many as the reference's monthly refresh has (n_estimators of BEST_CFG).
ROUNDS = 150
FEATURES = ["n_comments", "n_subs", "mean_score", "submitter_rate", "mean_depth", "mean_body_len", "removal_rate"]


def frame(spark, d):
    s = A.comment_stats(comments(spark, d)).withColumn("y", (F.col("deleted_later_rate") > 0).cast("int"))
    return s.select("author", "y", *FEATURES).filter("n_comments >= 2")


@query()
def model_scores(spark, d):
    f = frame(spark, d)
    return L.score(f, L.train(f, L.boosted(FEATURES, "y", rounds=ROUNDS), "y"), "author", "n_comments", 5)


@query()
def logistic_auc(spark, d):
    return L.cross_validated(frame(spark, d), L.logistic(FEATURES, "y"), "author", "y")


_FRAME = """
, fr AS (SELECT author, CASE WHEN avg(CASE WHEN meta_was_deleted_later THEN 1.0::DOUBLE ELSE 0 END) > 0 THEN 1 ELSE 0 END AS y, count(*) AS n_comments, count(DISTINCT sub) AS n_subs, avg(score) AS mean_score,
  avg(CASE WHEN is_submitter THEN 1.0::DOUBLE ELSE 0 END) AS submitter_rate, avg(depth) AS mean_depth, avg(body_len) AS mean_body_len, avg(CASE WHEN meta_removal_type IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS removal_rate
  FROM c GROUP BY 1 HAVING count(*) >= 2)
"""
_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2)"
_AUC = "SELECT (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0)::DOUBLE AS auc, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM"


@query(with_views(_FRAME + f"""
, s AS (SELECT author, y, mean_score, ntile(10) OVER (ORDER BY n_comments, author) AS s FROM fr WHERE mean_score IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('1:' || author), author) AS i, row_number() OVER (PARTITION BY s ORDER BY md5('2:' || author), author) AS j FROM s),
x AS (SELECT b.y, {_RANK.format('a.mean_score')} AS r FROM o a JOIN o b ON a.s = b.s AND a.i = b.j) {_AUC} x"""))
def permutation_floor(spark, d):
    """What the score's AUC would be if labels were dealt anew among accounts of like volume."""
    return L.permutation_floor(frame(spark, d), "author", "y", "mean_score", "n_comments")


@query(with_views(_FRAME + f", x AS (SELECT y, {_RANK.format('n_comments')} AS r FROM fr) {_AUC} x"))
def volume_baseline(spark, d):
    """AUC of the number of comments alone."""
    from weirstone.operators import stats

    return stats.auc(frame(spark, d), "author", "y", "n_comments")


_MAD = ", ".join(f"median({f}) AS m_{f}" for f in FEATURES)
_AWAY = ", ".join(f"{f} - m_{f} AS {f}" for f in FEATURES)
_DEV = ", ".join(f"median(abs({f})) AS d_{f}" for f in FEATURES)
_Z = " + ".join(f"coalesce({f} / nullif(1.4826 * d_{f}, 0), 0) ** 2" for f in FEATURES)


@query(with_views(_FRAME + f", m AS (SELECT {_MAD} FROM fr), a AS (SELECT author, {_AWAY} FROM fr, m), v AS (SELECT {_DEV} FROM a) SELECT author, round(sqrt(({_Z}) / {len(FEATURES)}), 6) AS anomaly FROM a, v"))
def anomaly_scores(spark, d):
    return L.anomaly_scores(frame(spark, d), "author", FEATURES).withColumn("anomaly", F.round("anomaly", 6))


@query()
def embedding_clusters(spark, d):
    return L.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


@query()
def embedding_components(spark, d):
    """Three components of the whole vectors."""
    e, cols = L.coordinates(table(spark, d, "embeddings"), "vec_id", "embedding")
    pc, _ = L.principal_components(e, "vec_id", cols, 3)
    return pc


_TAIL = """, tl AS (SELECT sub, a1, a2, n, round(list_sum(list_transform(range(n, least(d1, d2) + 1), lambda x: CASE WHEN d2 - x <= t - d1 THEN
  exp(lgamma(d1 + 1) - lgamma(x + 1) - lgamma(d1 - x + 1) + lgamma(t - d1 + 1) - lgamma(d2 - x + 1) - lgamma(t - d1 - d2 + x + 1) - lgamma(t + 1) + lgamma(d2 + 1) + lgamma(t - d2 + 1)) ELSE 0 END)), 9) AS p FROM e)"""


@query(_EDGES + _TAIL + " SELECT * FROM tl")
def pair_tails(spark, d):
    """How probable it is to meet so often by chance."""
    return L.with_tail(edges(spark, d)).select("sub", "a1", "a2", "n", F.round("p", 9).alias("p"))


@query(_EDGES + _TAIL + " SELECT a1, a2, sum(n)::BIGINT AS n, min(p) AS p, arg_min(sub, (p, sub)) AS best FROM tl GROUP BY 1, 2")
def pair_best(spark, d):
    """One row a pair: all shared threads, and the community in which chance is the least likely (ties: the first name)."""
    e = pair_tails(spark, d)
    return e.groupBy("a1", "a2").agg(F.sum("n").alias("n"), F.min("p").alias("p"), F.min_by("sub", F.struct("p", "sub")).alias("best"))


@query()
def volume_regimes(spark, d):
    m = comments(spark, d).filter("sub IS NOT NULL AND month IS NOT NULL").groupBy("sub", "month").agg(F.count("*").alias("n"))
    return L.regimes(m, "sub", "month", "n", least=4)


@query()
def matched_posts(spark, d):
    p = all_posts(spark, d).filter("sub IS NOT NULL AND month IS NOT NULL")
    return L.match_without_replacement(p.withColumn("t", F.col("role") == "top"), ["sub", "month"], "post_id", "t", "score")
