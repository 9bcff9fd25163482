"""Queries on community signals, the pair graph, texts and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirstone.operators import graph as G
from weirstone.operators import signals as S
from weirstone.operators import stats
from weirstone.operators import text as X
from weirstone.plans.base import Registry, all_posts, comments, posts, raw_comments, with_views
from weirstone.operators.sessions import known_seconds
from weirstone.sources.tables import canonical_sub, table

query = Registry()

# signals of communities

_RAMP = "greatest(0, least(({t} - {x}) / {t} * {c}, {c}))"


def _ramp(x, t, c):
    return f"coalesce({_RAMP.format(x=x, t=t, c=c)}, 0)"


@query(with_views(f"""
, h AS (SELECT sub, (created_utc // 3600) % 24 AS hour, count(*) AS k FROM p WHERE created_utc > 0 AND sub IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(k) OVER (PARTITION BY sub) AS n, row_number() OVER (PARTITION BY sub ORDER BY k DESC, hour) AS r FROM h),
a AS (SELECT sub, 100 * sum(k) FILTER (WHERE r <= 3) / max(n) AS top3_pct, -sum(k / n * log2(k / n + 1e-10)) AS entropy, (max(hour) FILTER (WHERE r = 1))::INT AS peak_hour FROM r GROUP BY 1),
g AS (SELECT sub, created_utc - lag(created_utc) OVER (PARTITION BY sub ORDER BY created_utc) AS g FROM p WHERE created_utc > 0),
i AS (SELECT sub, CASE WHEN count(*) >= 4 THEN coalesce(stddev_pop(g) / nullif(avg(g), 0), 0) ELSE 1 END AS interval_cv FROM g GROUP BY 1)
SELECT sub, top3_pct, entropy, peak_hour, interval_cv, least(least(top3_pct, 60) * 0.7 + greatest(0, (1 - entropy / log2(24)) * 40) * 0.7 + {_ramp('interval_cv', 0.85, 30)}, 100) AS temporal_score FROM a JOIN i USING (sub)"""))
def hour_entropy(spark, d):
    return S.temporal(posts(spark, d).filter("sub IS NOT NULL"), ["sub"])


@query(with_views(f"""
, a AS (SELECT sub, month, count(*) AS n, covar_pop(score, num_comments_reported) / nullif(stddev_pop(score) FILTER (WHERE num_comments_reported IS NOT NULL) * stddev_pop(num_comments_reported) FILTER (WHERE score IS NOT NULL), 0) AS corr,
 stddev_samp(upvote_ratio) AS ratio_sd, avg(upvote_ratio) AS mean_ratio, avg(score) / greatest(avg(num_comments_reported), 1) AS ucr, 100 * avg(CASE WHEN score > 500 AND num_comments_reported < 5 THEN 1.0::DOUBLE ELSE 0 END) AS simulacra FROM p GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT *, least({_ramp('corr', 0.30, 50)} + {_ramp('ratio_sd', 0.025, 30)} + least(coalesce(ucr, 0) / 30 * 40, 40) + least(simulacra / 10 * 20, 20), 100) AS engagement_score,
 least(greatest(0, least(ucr / 30 * 65, 65) + greatest(0, least((mean_ratio - 0.85) / 0.15 * 35, 35))), 100) AS engagement_score_v1 FROM a"""))
def ucr_engagement(spark, d):
    return S.engagement(posts(spark, d), ["sub", "month"])


@query(with_views(f"""
, a AS (SELECT sub, CASE WHEN avg(score) > 0 THEN stddev_samp(score) / avg(score) ELSE 0 END AS score_cv, CASE WHEN avg(num_comments_reported) > 0 THEN stddev_samp(num_comments_reported) / avg(num_comments_reported) ELSE 0 END AS comments_cv, CASE WHEN count(score) > 2 THEN skewness(score) END AS score_skew, avg(mean_depth) AS avg_depth FROM p WHERE sub IS NOT NULL GROUP BY 1),
x AS (SELECT sub, ln(row_number() OVER (PARTITION BY sub ORDER BY score DESC, post_id)) AS x, ln(score) AS y FROM p WHERE score > 0),
f AS (SELECT sub, regr_slope(y, x) AS slope, CASE WHEN max(y) > min(y) THEN regr_r2(y, x) ELSE 0 END AS r2 FROM x GROUP BY 1 HAVING count(*) >= 8)
SELECT sub, score_cv, comments_cv, round(score_skew, 3) AS score_skew, avg_depth, slope, r2, least(coalesce(greatest(0, least((slope + 0.93) / 0.71 * 50, 50)), 0) + {_ramp('comments_cv', 0.8, 30)} + {_ramp('avg_depth', 0.5, 20)}, 100) AS distribution_score,
 least({_ramp('score_cv', 0.8, 70)} + {_ramp('comments_cv', 0.8, 30)}, 100) AS distribution_score_v1 FROM a LEFT JOIN f USING (sub)"""))
def rank_decay(spark, d):
    return S.distribution(posts(spark, d).filter("sub IS NOT NULL"), ["sub"]).withColumn("score_skew", F.round("score_skew", 3))


_GINI = ", gs AS (SELECT sub, month, greatest(score, 0) AS v, row_number() OVER (PARTITION BY sub, month ORDER BY score) AS i FROM p WHERE score IS NOT NULL), gg AS (SELECT sub, month, CASE WHEN count(*) >= 2 AND sum(v) <> 0 THEN 2 * sum(v * i) / (count(*) * sum(v)) - (count(*) + 1) / count(*) END AS gini FROM gs GROUP BY 1, 2)"


@query(with_views(_GINI + "SELECT * FROM gg"))
def gini(spark, d):
    return S.gini(posts(spark, d), ["sub", "month"], "score")


_CROSS = ", ac AS (SELECT DISTINCT month, sub, author FROM (SELECT month, sub, author FROM c UNION ALL SELECT month, sub, author FROM p) WHERE month IS NOT NULL AND sub IS NOT NULL), cs AS (SELECT month, sub, 100 * avg(CASE WHEN k >= 2 THEN 1.0::DOUBLE ELSE 0 END) AS cross_sub_rate, count(*) AS n_accounts FROM (SELECT *, count(*) OVER (PARTITION BY month, author) AS k FROM ac) GROUP BY 1, 2)"


def _active(spark, d):
    keys = ["month", "sub", "author"]
    return comments(spark, d).select(*keys).unionByName(posts(spark, d).select(*keys))


@query(with_views(_CROSS + "SELECT * FROM cs"))
def cross_sub_authors(spark, d):
    return S.cross_sub(_active(spark, d), "sub", "author", ["month"])


@query(with_views(_CROSS + _GINI + "SELECT month, sub, gini, cross_sub_rate, n_accounts, least(least(cross_sub_rate / 70 * 50, 50) + least(coalesce(gini, 0) * 100 / 75 * 50, 50), 100) AS network_score FROM gg JOIN cs USING (month, sub)"))
def network_signals(spark, d):
    return S.network(posts(spark, d), _active(spark, d))


_TAGGED = f"""
, tg AS (SELECT post_id, trim(regexp_replace(lower(trim(sub)), '^/?r/', '')) AS sub, author, commenter_tag AS tag, comment_id, min(CASE WHEN created_utc >= 100000000000 THEN created_utc // 1000 WHEN created_utc > 0 THEN created_utc END) AS ts, bool_or(coalesce(is_submitter, FALSE)) AS is_submitter
  FROM commenters WHERE author IS NOT NULL AND author <> '[deleted]' AND comment_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5)
"""


def _tagged(spark, d):
    t = table(spark, d, "commenters").filter("author <> '[deleted]' AND comment_id IS NOT NULL")
    keys = ["post_id", canonical_sub("sub").alias("sub"), "author", F.col("commenter_tag").alias("tag"), "comment_id"]
    return t.groupBy(*keys).agg(F.min(known_seconds("created_utc")).alias("ts"), F.bool_or(F.coalesce("is_submitter", F.lit(False))).alias("is_submitter"))


@query(with_views(_TAGGED + """
, f AS (SELECT * FROM tg WHERE tag = 'first10'), t AS (SELECT * FROM tg WHERE tag = 'top10'),
pp AS (SELECT f.post_id, count(ts) AS k, stddev_samp((ts - created_utc) / 60) AS sd, (min(ts) - max(created_utc)) / 60 AS ttfc, coalesce(bool_or(is_submitter OR coalesce(f.author = p.author, FALSE)), FALSE) AS amp FROM f JOIN p USING (post_id) GROUP BY 1),
ov AS (SELECT a.post_id, count(b.author) / count(*) AS overlap FROM (SELECT DISTINCT post_id, author FROM f) a LEFT JOIN (SELECT DISTINCT post_id, author FROM t) b ON a.post_id = b.post_id AND a.author = b.author GROUP BY 1),
ow AS (SELECT sub, author FROM t GROUP BY 1, 2 HAVING count(DISTINCT post_id) >= 3), rc AS (SELECT sub, count(DISTINCT post_id) AS recur FROM t JOIN ow USING (sub, author) GROUP BY 1),
a AS (SELECT p.sub, count(*) AS n_posts, coalesce(avg(overlap), 0) AS overlap_rate, coalesce(avg(CASE WHEN k >= 3 THEN greatest(0, 1 - sd / 30) * 100 END), 0) AS burst_score, avg(ttfc) AS avg_ttfc,
 coalesce(100 * avg(CASE WHEN ttfc IS NOT NULL THEN CASE WHEN ttfc < 5 THEN 1.0::DOUBLE ELSE 0 END END), 0) AS fast_pct, avg(CASE WHEN amp THEN 1.0::DOUBLE ELSE 0 END) AS self_amp_rate FROM p LEFT JOIN pp USING (post_id) LEFT JOIN ov USING (post_id) WHERE p.sub IS NOT NULL GROUP BY 1)
SELECT a.*, coalesce(recur, 0) / n_posts AS recurrence_rate, least(burst_score * 0.6 + fast_pct * 0.25 + coalesce(recur, 0) / n_posts * 10 + self_amp_rate * 5, 100) AS ring_score FROM a LEFT JOIN rc USING (sub)"""))
def comment_ring(spark, d):
    return S.comment_ring(posts(spark, d).filter("sub IS NOT NULL"), _tagged(spark, d))


@query(with_views(_TAGGED + """
, rk AS (SELECT author FROM c GROUP BY 1 HAVING avg(CASE WHEN meta_removal_type IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) >= 0.2),
pc AS (SELECT post_id, count(rk.author) AS b, count(*) AS k FROM (SELECT DISTINCT post_id, author FROM tg WHERE tag = 'top10') x LEFT JOIN rk USING (author) GROUP BY 1),
j AS (SELECT p.sub, rk.author IS NOT NULL AS poster, b / k >= 0.5 AS most, b > 0 AS anyb FROM pc JOIN p USING (post_id) LEFT JOIN rk ON rk.author = p.author)
SELECT sub, count(*) AS n_posts, 100 * avg((poster AND most)::INT) AS both_pct, 100 * avg((poster AND NOT most)::INT) AS poster_only_pct, 100 * avg((NOT poster AND most)::INT) AS commenter_only_pct, 100 * avg(anyb::INT) AS any_pct FROM j GROUP BY 1"""))
def astroturf_shares(spark, d):
    from weirstone.operators.accounts import rate

    risky = comments(spark, d).groupBy("author").agg(rate(F.col("meta_removal_type").isNotNull()).alias("r")).filter("r >= 0.2")
    return S.coordination(posts(spark, d), _tagged(spark, d).filter("tag = 'top10'"), risky)


# the pair graph

_EDGES = """
WITH m AS (SELECT DISTINCT sub, post_id, author FROM presence WHERE author IS NOT NULL AND author <> '[deleted]' AND sub IS NOT NULL AND post_id IS NOT NULL),
t AS (SELECT sub, count(DISTINCT post_id) AS t FROM m GROUP BY 1), d AS (SELECT sub, author, count(*) AS d FROM m GROUP BY 1, 2),
n AS (SELECT x.sub, x.author AS a1, y.author AS a2, count(*) AS n FROM m x JOIN m y ON x.sub = y.sub AND x.post_id = y.post_id AND x.author < y.author GROUP BY 1, 2, 3 HAVING count(*) >= 2),
e AS (SELECT n.sub, a1, a2, n, d1.d AS d1, d2.d AS d2, t.t, (n - d1.d * d2.d / t.t) / nullif(sqrt(d1.d * d2.d / t.t * (t.t - d1.d) * (t.t - d2.d) / nullif(t.t * (t.t - 1.0::DOUBLE), 0)), 0) AS z
  FROM n JOIN d d1 ON d1.sub = n.sub AND d1.author = a1 JOIN d d2 ON d2.sub = n.sub AND d2.author = a2 JOIN t ON t.sub = n.sub)
"""


def edges(spark, d):
    return G.pair_edges(table(spark, d, "presence").filter("author <> '[deleted]'"), "sub", "post_id", "author")


@query(_EDGES + "SELECT * FROM e")
def pair_degree_z(spark, d):
    return edges(spark, d)


@query(_EDGES + ", b AS (SELECT author, other, sum(n) AS n FROM (SELECT a1 AS author, a2 AS other, n FROM e UNION ALL SELECT a2, a1, n FROM e) GROUP BY 1, 2) SELECT author, count(*) AS degree, sum(n)::BIGINT AS strength, sum(n * n) / (sum(n) * sum(n)) AS hhi FROM b GROUP BY 1")
def coappear_hhi(spark, d):
    return G.degrees(edges(spark, d))


@query(_EDGES + "SELECT a1, a2, sum(n)::BIGINT AS n, arg_max(sub, (z, sub)) AS best, max(z) AS z FROM e GROUP BY 1, 2")
def pair_collapse(spark, d):
    return G.collapse(edges(spark, d), "sub")


_E = _EDGES.replace("WITH m AS", ", m AS", 1)


@query(with_views(_E + ", f AS (SELECT post_id, author, min(ts) AS t FROM c WHERE ts IS NOT NULL GROUP BY 1, 2), q AS (SELECT DISTINCT a1, a2 FROM e) SELECT a1, a2, count(*) AS shared, median(abs(x.t - y.t)) AS median_gap, min(abs(x.t - y.t)) AS min_gap FROM q JOIN f x ON x.author = a1 JOIN f y ON y.author = a2 AND y.post_id = x.post_id GROUP BY 1, 2"))
def arrival_gaps(spark, d):
    return G.arrival_gaps(comments(spark, d), edges(spark, d).select("a1", "a2").distinct())


@query(with_views(_E + """, k AS (SELECT author, ts // 86400 AS day, count(*) AS x FROM c WHERE ts IS NOT NULL GROUP BY 1, 2), s AS (SELECT author, sum(x)::DOUBLE AS s, sum(x * x)::DOUBLE AS q FROM k GROUP BY 1), dd AS (SELECT (max(day) - min(day) + 1)::DOUBLE AS d FROM k), q AS (SELECT DISTINCT a1, a2 FROM e),
xy AS (SELECT a1, a2, sum(u.x * v.x) AS xy FROM q JOIN k u ON u.author = a1 JOIN k v ON v.author = a2 AND v.day = u.day GROUP BY 1, 2)
SELECT a1, a2, (d * coalesce(xy, 0) - u.s * v.s) / nullif(sqrt((d * u.q - u.s * u.s) * (d * v.q - v.s * v.s)), 0) AS r FROM q JOIN s u ON u.author = a1 JOIN s v ON v.author = a2 LEFT JOIN xy USING (a1, a2), dd"""))
def daily_correlation(spark, d):
    return G.daily_correlation(comments(spark, d), edges(spark, d).select("a1", "a2").distinct())


@query(with_views(", g AS (SELECT DISTINCT c.author AS a, p.author AS b FROM c JOIN p USING (post_id) WHERE c.author <> p.author) SELECT count(*) AS edges, count(h.a) AS returned, count(h.a) / nullif(count(*), 0) AS reciprocity FROM g LEFT JOIN g h ON h.a = g.b AND h.b = g.a"))
def reply_reciprocity(spark, d):
    r = comments(spark, d).select("post_id", "author").join(posts(spark, d).select("post_id", F.col("author").alias("poster")), "post_id")
    return G.reciprocity(r, "author", "poster")


# texts


@query(with_views("SELECT author, sum(k - 1)::BIGINT AS extra, count(*) FILTER (WHERE k > 1) AS groups FROM (SELECT author, body, count(*) AS k FROM c WHERE length(body) >= 10 GROUP BY 1, 2) GROUP BY 1"))
def own_repeat_rate(spark, d):
    return X.repeated_bodies(comments(spark, d))


@query(with_views("SELECT author, count(*) AS n_dup_bodies, sum(k)::BIGINT AS total_repeat_comments, max(subs) AS max_subs_for_one_body FROM (SELECT author, body, count(*) AS k, count(DISTINCT sub) AS subs FROM c WHERE length(body) >= 30 GROUP BY 1, 2 HAVING count(DISTINCT post_id) >= 2) GROUP BY 1"))
def dup_text_candidates(spark, d):
    return X.cross_thread_bodies(comments(spark, d))


@query(with_views(r"SELECT author, avg(CASE WHEN regexp_matches(body, 'https?://|www\.') THEN 1.0::DOUBLE ELSE 0 END) AS url_rate FROM c GROUP BY 1"))
def url_rate(spark, d):
    return X.link_rate(comments(spark, d))


_WORDS = "unnest(list_filter(regexp_split_to_array(lower(body), '[^a-z0-9_]+'), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join("'" + w.replace("'", "''") + "'" for w in X.stop_words()) + ") AND NOT regexp_full_match(w, '[0-9]+')))"


@query(with_views(f", w AS (SELECT sub, month, {_WORDS} AS word FROM c) SELECT month, word, count(DISTINCT sub) AS subs, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT sub) >= 4"))
def cross_sub_words(spark, d):
    w = X.word_counts(comments(spark, d), ["sub", "month"], "body")
    return w.groupBy("month", "word").agg(F.count_if(F.col("sub").isNotNull()).alias("subs"), F.sum("n").alias("n")).filter("subs >= 4")


@query(with_views(f", w AS (SELECT meta_removal_type IS NOT NULL AS removed, {_WORDS} AS word FROM c), k AS (SELECT word, count(*) FILTER (WHERE removed) AS a, count(*) FILTER (WHERE NOT removed) AS b FROM w GROUP BY 1), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM k) SELECT word, a AS removed, b AS kept, ((a + 1) / (ta + 1)) / ((b + 1) / (tb + 1)) AS ratio FROM k, t WHERE a + b >= 10"))
def word_divergence(spark, d):
    """How much more often a word stands in removed comments than in others."""
    c = comments(spark, d).select(F.col("meta_removal_type").isNotNull().alias("removed"), "body")
    k = X.word_counts(c, ["removed"], "body").groupBy("word").agg(F.sum(F.when(F.col("removed"), F.col("n")).otherwise(0)).alias("removed"), F.sum(F.when(~F.col("removed"), F.col("n")).otherwise(0)).alias("kept"))
    t = k.agg(F.sum("removed").alias("ta"), F.sum("kept").alias("tb"))
    ratio = ((F.col("removed") + 1) / (F.col("ta") + 1)) / ((F.col("kept") + 1) / (F.col("tb") + 1))
    return k.filter("removed + kept >= 10").join(F.broadcast(t)).select("word", "removed", "kept", ratio.alias("ratio"))


@query(with_views(f", w AS (SELECT sub, {_WORDS} AS word FROM c WHERE sub IS NOT NULL), k AS (SELECT word, min(sub) AS sub FROM w GROUP BY 1 HAVING count(DISTINCT sub) = 1) SELECT sub, count(*) AS own_words FROM k GROUP BY 1"))
def unique_vocabulary(spark, d):
    w = X.word_counts(comments(spark, d).filter("sub IS NOT NULL"), ["sub"], "body")
    return w.groupBy("word").agg(F.min("sub").alias("sub"), F.count("*").alias("k")).filter("k = 1").groupBy("sub").agg(F.count("*").alias("own_words"))


@query(with_views("SELECT trim(regexp_replace(regexp_replace(lower(body), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS text, count(DISTINCT author) AS authors FROM c GROUP BY 1 HAVING length(text) >= 20 AND count(DISTINCT author) > 1"))
def shared_texts(spark, d):
    return X.shared_normal_texts(comments(spark, d))


@query()
def ngram_tfidf(spark, d):
    return X.tfidf(comments(spark, d).select("comment_id", "body"), "comment_id", "body")


@query(with_views(", f AS (SELECT author, post_id, sub, ts = min(ts) OVER (PARTITION BY author, sub) AS fresh FROM c WHERE ts IS NOT NULL AND sub IS NOT NULL), o AS (SELECT post_id, avg(fresh::INT) AS share FROM f GROUP BY 1) SELECT author, avg(share) AS outsider_share FROM (SELECT DISTINCT author, post_id FROM f) JOIN o USING (post_id) GROUP BY 1"))
def outsider_share(spark, d):
    """Mean share of first-time commenters in the threads of an account."""
    from pyspark.sql import Window

    c = comments(spark, d).filter("ts IS NOT NULL AND sub IS NOT NULL")
    f = c.select("author", "post_id", (F.col("ts") == F.min("ts").over(Window.partitionBy("author", "sub"))).cast("int").alias("fresh"))
    o = f.groupBy("post_id").agg(F.avg("fresh").alias("share"))
    return f.select("author", "post_id").distinct().join(o, "post_id").groupBy("author").agg(F.avg("share").alias("outsider_share"))


# statistics

_P = "SELECT post_id, score, num_comments_reported AS n, upvote_ratio AS r, role, sub, created_utc FROM p0"


@query(with_views(", v AS (SELECT score::DOUBLE AS v FROM p0 WHERE score IS NOT NULL), q AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM v) SELECT greatest(0, least(27, coalesce(floor((v - lo) / nullif((hi - lo) / 28, 0)), 0)))::INT AS bin, count(*) AS n FROM v, q GROUP BY 1"))
def histogram_clip(spark, d):
    return stats.clipped_histogram(all_posts(spark, d).select(F.col("score").cast("double").alias("score")), "score")


@query(with_views(", v AS (SELECT ln(1 + greatest(score, 0)) AS x, ln(1 + greatest(num_comments_reported, 0)) AS y FROM p0 WHERE score IS NOT NULL AND num_comments_reported IS NOT NULL), q AS (SELECT min(x) AS a, max(x) AS b, min(y) AS e, max(y) AS f FROM v) SELECT least(23, floor((x - a) / ((b - a) / 24)))::INT AS bx, least(23, floor((y - e) / ((f - e) / 24)))::INT AS by, count(*) AS n FROM v, q GROUP BY 1, 2"))
def hist2d(spark, d):
    p = all_posts(spark, d).dropna(subset=["score", "num_comments_reported"]).select(*[F.ln(1 + F.greatest(F.col(c), F.lit(0))).alias(a) for a, c in (("x", "score"), ("y", "num_comments_reported"))])
    return stats.histogram_2d(p, "x", "y")


@query(with_views(", k AS (SELECT score AS v, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM p0 WHERE score IS NOT NULL GROUP BY 1), t AS (SELECT * FROM k WHERE share >= 0.01 ORDER BY n DESC, v LIMIT 8), u AS (SELECT *, sum(share) OVER (ORDER BY n DESC, v) AS upto FROM t) SELECT v, n, share FROM u WHERE upto <= 0.5"))
def point_mass_strip(spark, d):
    return stats.point_masses(all_posts(spark, d), "score")


_RANKS = "(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2)"


@query(with_views(f", v AS (SELECT score AS x, num_comments_reported AS y FROM p0 WHERE score IS NOT NULL AND num_comments_reported IS NOT NULL), r AS (SELECT {_RANKS.format(x='x')} AS rx, {_RANKS.format(x='y')} AS ry FROM v) SELECT corr(rx, ry) AS rho, count(*) AS n FROM r"))
def spearman(spark, d):
    return stats.spearman(all_posts(spark, d), "post_id", "score", "num_comments_reported")


_AUC = with_views(f", v AS (SELECT score AS x, (role = 'top')::INT AS y FROM p0 WHERE score IS NOT NULL AND role IS NOT NULL), r AS (SELECT y, {_RANKS.format(x='x')} AS r FROM v), a AS (SELECT sum(r) FILTER (WHERE y = 1) AS s, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM r) ")


def _labelled(spark, d):
    return all_posts(spark, d).filter("role IS NOT NULL").select("post_id", "score", (F.col("role") == "top").cast("int").alias("y"), "sub", "created_utc")


@query(_AUC + "SELECT (s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) AS auc, n_pos, n_neg FROM a")
def auc_rank(spark, d):
    return stats.auc(_labelled(spark, d), "post_id", "y", "score")


@query(_AUC + "SELECT s - n_pos * (n_pos + 1) / 2 AS u, (s - n_pos * (n_pos + 1) / 2 - n_pos * n_neg / 2) / sqrt(n_pos * n_neg / 12.0::DOUBLE * (n_pos + n_neg + 1)) AS z FROM a")
def mann_whitney(spark, d):
    return stats.mann_whitney(_labelled(spark, d), "post_id", "y", "score")


@query(with_views(f", v AS (SELECT sub, {_RANKS.format(x='score')} AS r, count(*) OVER () AS n FROM p0 WHERE score IS NOT NULL), g AS (SELECT sub, sum(r) * sum(r) / count(*) AS q, max(n) AS n FROM v GROUP BY 1) SELECT 12 / (max(n) * (max(n) + 1.0::DOUBLE)) * sum(q) - 3 * (max(n) + 1) AS h, count(*) AS groups FROM g"))
def kruskal_wallis(spark, d):
    return stats.kruskal(all_posts(spark, d), "post_id", "sub", "score")


@query(with_views(", v AS (SELECT ln(1 + greatest(score, 0))::DOUBLE AS v FROM p0 WHERE score IS NOT NULL), m AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * count(*) ** -0.2 AS h FROM v), g AS (SELECT lo + (hi - lo) * i / 49 AS x, n, h FROM m, (SELECT unnest(range(50)) AS i)) SELECT x, sum(exp(-(((x - v) / h) ** 2) / 2)) / (max(n) * max(h) * 2.5066282746310002) AS density FROM g, v GROUP BY x"))
def kernel_density(spark, d):
    p = all_posts(spark, d).filter("score IS NOT NULL").select(F.ln(1 + F.greatest(F.col("score"), F.lit(0))).alias("v"))
    return stats.kernel_density(p, "v")


@query(with_views(", v AS (SELECT post_id, score, created_utc // 86400 AS day FROM p0 WHERE created_utc IS NOT NULL), g AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM v)) SELECT CASE WHEN i <= 0.6 * n THEN 'train' WHEN i <= (0.6 + 0.1) * n THEN 'purge' ELSE 'test' END AS part, count(*) AS n, count(score) AS n_scored FROM v JOIN g USING (day) GROUP BY 1"))
def chrono_split(spark, d):
    p = stats.chronological_split(all_posts(spark, d).filter("created_utc IS NOT NULL"), "created_utc")
    return p.groupBy("part").agg(F.count("*").alias("n"), F.count("score").alias("n_scored"))


@query("SELECT count(*) AS n, count(*) - count(DISTINCT comment_id) AS repeated_ids, count(*) FILTER (WHERE author IS NULL) AS null_author, count(*) FILTER (WHERE created_utc IS NULL OR created_utc <= 0) AS unknown_time, count(*) FILTER (WHERE created_utc >= 100000000000) AS in_ms, count(*) FILTER (WHERE body IN ('[deleted]', '[removed]')) AS tombstones, count(*) FILTER (WHERE meta_removal_type = '') AS empty_removal, count(*) FILTER (WHERE body_len <> length(body)) AS wrong_length FROM commenters")
def qc_counters(spark, d):
    c = table(spark, d, "commenters")
    return c.agg(
        F.count("*").alias("n"), (F.count("*") - F.countDistinct("comment_id")).alias("repeated_ids"), F.count_if(F.col("author").isNull()).alias("null_author"), F.count_if(F.col("created_utc").isNull() | (F.col("created_utc") <= 0)).alias("unknown_time"),
        F.count_if(F.col("created_utc") >= 100_000_000_000).alias("in_ms"), F.count_if(F.col("body").isin("[deleted]", "[removed]")).alias("tombstones"), F.count_if(F.col("meta_removal_type") == "").alias("empty_removal"), F.count_if(F.col("body_len") != F.length("body")).alias("wrong_length"),
    )


@query(with_views("SELECT sub, month, count(*) AS n_truncated FROM p0 WHERE num_comments_reported >= 10 AND n_comments_observed < 0.5 * num_comments_reported GROUP BY 1, 2"))
def truncated_threads(spark, d):
    return all_posts(spark, d).filter("num_comments_reported >= 10 AND n_comments_observed < 0.5D * num_comments_reported").groupBy("sub", "month").agg(F.count("*").alias("n_truncated"))


@query(with_views("SELECT post_id, count(*) AS n, count(DISTINCT author) AS n_authors, median(score) AS p50, max(score) AS most, max(depth) AS max_depth, avg(depth) AS mean_depth, avg(CASE WHEN depth = 0 THEN 1.0::DOUBLE ELSE 0 END) AS pct_toplevel, avg(CASE WHEN is_seed THEN 1.0::DOUBLE ELSE 0 END) AS bot_rate, avg(CASE WHEN body IN ('[deleted]', '[removed]') THEN 1.0::DOUBLE ELSE 0 END) AS tombstone_rate FROM c0 GROUP BY 1"))
def thread_metrics(spark, d):
    from weirstone.operators.accounts import rate

    return raw_comments(spark, d).groupBy("post_id").agg(
        F.count("*").alias("n"), F.countDistinct("author").alias("n_authors"), F.median("score").alias("p50"), F.max("score").alias("most"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"),
        rate(F.col("depth") == 0).alias("pct_toplevel"), rate(F.col("is_seed")).alias("bot_rate"), rate(F.col("body").isin("[deleted]", "[removed]")).alias("tombstone_rate"),
    )


@query(with_views(", x AS (SELECT post_id, incentive_tier, score FROM p0), s AS (SELECT incentive_tier, avg(score) AS m, stddev_pop(score) AS sd FROM x GROUP BY 1) SELECT coalesce(incentive_tier, 'none') AS tier, m AS mean_score, (sd - m) / nullif(sd + m, 0) AS burstiness FROM s"))
def segment_means(spark, d):
    from weirstone.functions.metrics import memoryless_burstiness

    s = all_posts(spark, d).groupBy("incentive_tier").agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("sd"))
    return s.select(F.coalesce("incentive_tier", F.lit("none")).alias("tier"), "mean_score", memoryless_burstiness(F.col("sd"), F.col("mean_score")).alias("burstiness"))
