"""Queries on cleaning and on the features of accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirstone.functions import metrics as M
from weirstone.operators import accounts as A
from weirstone.operators import ranks
from weirstone.plans.base import Registry, all_posts, comments, posts, raw_comments, with_views
from weirstone.session import written
from weirstone.sources.tables import SENTINELS, canonical_sub, latest_rows, table

query = Registry()


@query(with_views("SELECT 'comments' AS t, is_seed, is_gone, count(*) AS n FROM c0 GROUP BY 2, 3 UNION ALL SELECT 'posts', is_seed, is_gone, count(*) FROM p0 GROUP BY 2, 3"))
def seed_flags(spark, d):
    count = lambda df, t: df.groupBy("is_seed", "is_gone").agg(F.count("*").alias("n")).withColumn("t", F.lit(t))
    return count(raw_comments(spark, d), "comments").unionByName(count(all_posts(spark, d), "posts"))


@query(with_views("SELECT sub, month, count(*) AS n, count(DISTINCT author) AS n_authors, sum(score)::BIGINT AS total_score, count(ts) AS n_timed FROM c GROUP BY 1, 2"))
def dedup_by_tag(spark, d):
    return comments(spark, d).groupBy("sub", "month").agg(F.count("*").alias("n"), F.countDistinct("author").alias("n_authors"), F.sum("score").alias("total_score"), F.count("ts").alias("n_timed"))


@query("SELECT tags, count(*) AS n FROM (SELECT comment_id, array_to_string(list_sort(list(DISTINCT commenter_tag) FILTER (WHERE commenter_tag IS NOT NULL)), '+') AS tags FROM commenters WHERE comment_id IS NOT NULL GROUP BY 1) GROUP BY 1")
def tag_sets(spark, d):
    t = table(spark, d, "commenters").filter("comment_id IS NOT NULL").groupBy("comment_id").agg(F.array_join(F.sort_array(F.collect_set("commenter_tag")), "+").alias("tags"))
    return t.groupBy(F.when(F.col("tags") != "", F.col("tags")).alias("tags")).agg(F.count("*").alias("n"))


_STATS = """SELECT author, count(*) AS n_comments, count(DISTINCT sub) AS n_subs, count(DISTINCT post_id) AS n_threads, min(ts) AS first_seen, max(ts) AS last_seen, avg(score) AS mean_score,
 median(score) AS median_score, stddev_samp(score) AS sd_score, avg(CASE WHEN controversiality = 1 THEN 1.0::DOUBLE ELSE 0 END) AS controversial_rate, avg(CASE WHEN is_submitter THEN 1.0::DOUBLE ELSE 0 END) AS submitter_rate,
 avg(depth) AS mean_depth, avg(body_len) AS mean_body_len, avg(CASE WHEN meta_removal_type IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS removal_rate,
 avg(CASE WHEN meta_was_deleted_later THEN 1.0::DOUBLE ELSE 0 END) AS deleted_later_rate, bool_or(is_seed) AS ever_seed FROM c GROUP BY 1"""


@query(with_views(_STATS))
def account_stats(spark, d):
    return A.comment_stats(comments(spark, d)).drop("ordinal")


@query(with_views("SELECT author, count(*) AS n_posts, avg(score) AS mean_post_score FROM p GROUP BY 1"))
def account_posts(spark, d):
    return A.post_stats(posts(spark, d))


@query(with_views("SELECT author, count(*) AS n_distinct_threads, count(*) FILTER (WHERE k > 1) AS n_repeat_threads, avg(CASE WHEN k > 1 THEN 1.0::DOUBLE ELSE 0 END) AS repeat_rate FROM (SELECT author, post_id, count(*) AS k FROM c GROUP BY 1, 2) GROUP BY 1"))
def repeat_engagement(spark, d):
    return A.repeat_engagement(comments(spark, d))


@query(with_views("SELECT author, avg(submitter_reply_rate) AS own_post_reply_rate, count(*) AS n_own_posts FROM p WHERE n_comments_observed > 0 GROUP BY 1"))
def own_post_replies(spark, d):
    return A.own_post_replies(posts(spark, d))


@query(with_views(""", s AS (SELECT author, sub, avg(score) AS m, count(DISTINCT month) AS months FROM c GROUP BY 1, 2), r AS (SELECT author, count(*) FILTER (WHERE m < 0 AND months >= 2) AS n_returned, max(m) AS best, min(m) AS worst FROM s GROUP BY 1)
SELECT *, best - worst AS spread, n_returned >= 1 AND coalesce(best > 5, FALSE) AS silo FROM r"""))
def silo_pattern(spark, d):
    return A.reception(comments(spark, d))


@query(with_views("""SELECT c.author, count(*) FILTER (WHERE incentive_tier = 'high') AS n_high, count(*) FILTER (WHERE incentive_tier = 'medium') AS n_medium, count(*) FILTER (WHERE incentive_tier = 'low') AS n_low,
 count(DISTINCT c.sub) FILTER (WHERE incentive_tier = 'low') AS n_low_subs FROM c JOIN (SELECT post_id, sub, month, incentive_tier FROM p0) q ON c.post_id = q.post_id AND c.sub = q.sub AND c.month = q.month GROUP BY 1"""))
def tier_footprint(spark, d):
    return A.tier_footprint(comments(spark, d), all_posts(spark, d))


@query(with_views(", k AS (SELECT author, sub, count(*) AS k, sum(count(*)) OVER (PARTITION BY author) AS n FROM c GROUP BY 1, 2) SELECT author, sum(-(k / n) * log2(k / n)) AS entropy FROM k GROUP BY 1"))
def sub_entropy(spark, d):
    return A.category_entropy(comments(spark, d), "author", "sub")


@query(with_views(r"""SELECT author, regexp_matches(author, '^[A-Z][a-z]+[-_]?[A-Z][a-z0-9]+[-_]?\d{2,6}$') AS default_pattern, length(regexp_extract(author, '(\d+)$', 1)) AS digit_suffix,
 list_sum([-(len(list_filter(ch, lambda y: y = x)) / len(ch)) * log2(len(list_filter(ch, lambda y: y = x)) / len(ch)) FOR x IN list_distinct(ch)]) AS char_entropy
 FROM (SELECT DISTINCT author, string_split(author, '') AS ch FROM c)"""))
def username_shape(spark, d):
    return A.name_shape(comments(spark, d), "author")


_TIMING = with_views("""
, g AS (SELECT author, ts - lag(ts) OVER (PARTITION BY author ORDER BY ts) AS g FROM c WHERE ts IS NOT NULL),
s AS (SELECT author, count(g) AS n, avg(g) AS mu, stddev_pop(g) AS sigma, min(g) AS gmin, max(g) AS gmax, count(g) FILTER (WHERE g > 0) AS np, min(g) FILTER (WHERE g > 0) AS lo, max(g) FILTER (WHERE g > 0) AS hi,
  count(g) FILTER (WHERE g > 0 AND ((round_even(g / 60, 0) > 0 AND abs(g - round_even(g / 60, 0) * 60) <= 2) OR (round_even(g / 300, 0) > 0 AND abs(g - round_even(g / 300, 0) * 300) <= 2) OR (round_even(g / 900, 0) > 0 AND abs(g - round_even(g / 900, 0) * 900) <= 2))) AS hits
  FROM g GROUP BY 1 HAVING count(g) >= 4),
b AS (SELECT author, np, least(9, floor((log10(g) - log10(lo)) / ((log10(hi + 1) - log10(lo)) / 10))) AS b, count(*) AS k FROM g JOIN s USING (author) WHERE g > 0 AND lo < hi GROUP BY ALL),
e AS (SELECT author, sum(-(k / np) * log2(k / np)) / log2(10) AS e FROM b GROUP BY 1)
SELECT author, n AS n_gaps, CASE WHEN np >= 2 THEN CASE WHEN lo = hi THEN 0 ELSE e END END AS interval_entropy,
 CASE WHEN n >= 3 AND mu <> 0 THEN CASE WHEN gmin = gmax THEN -1 ELSE (sqrt(n + 1) * sigma / mu - sqrt(n - 1)) / ((sqrt(n + 1) - 2) * sigma / mu + sqrt(n - 1)) END END AS burstiness, hits / n AS quantization_rate
FROM s LEFT JOIN e USING (author)""")


@query(_TIMING)
def author_timing(spark, d):
    return A.timing(comments(spark, d), "author", "ts")


_ORDINAL = """SELECT author, max(CASE WHEN starts_with(author_fullname, 't2_') AND regexp_full_match(substr(author_fullname, 4), '[0-9A-Za-z]{1,12}')
 THEN list_reduce(list_transform(string_split(lower(substr(author_fullname, 4)), ''), lambda x: (strpos('0123456789abcdefghijklmnopqrstuvwxyz', x) - 1)::HUGEINT), lambda a, b: a * 36 + b)::BIGINT END) AS ordinal FROM c GROUP BY 1"""
_PARTS = ["account_posts", "repeat_engagement", "own_post_replies", "silo_pattern", "tier_footprint", "username_shape", "author_timing"]
_FEATURES = "WITH " + ", ".join([f"x0 AS ({with_views(_STATS)})", f"o AS ({with_views(_ORDINAL)})", f"en AS (SELECT author, entropy AS sub_entropy FROM ({query.sql['sub_entropy']}))"] + [f"x{i + 1} AS ({query.sql[n] if n != 'author_timing' else _TIMING})" for i, n in enumerate(_PARTS)])
_FEATURES += ", j AS (SELECT * FROM x0 LEFT JOIN o USING (author) LEFT JOIN en USING (author) " + " ".join(f"LEFT JOIN x{i + 1} USING (author)" for i in range(len(_PARTS))) + ")"
_SPAN = "greatest((last_seen - first_seen) / 86400, 0)"


@query(_FEATURES + f""" SELECT * REPLACE (coalesce(n_posts, 0) AS n_posts), {_SPAN} AS span_days, n_comments / greatest({_SPAN}, 1) AS comments_per_day, mean_score * n_comments / greatest({_SPAN}, 1) AS score_per_day,
 coalesce(n_low_subs, 0) = 0 AS hobby_absence FROM j""")
def account_features(spark, d):
    """All features of an account in one row. The cleaned comments are written once, without their texts, since nine branches read them."""
    c = written(comments(spark, d).select(*A.COLUMNS))
    return A.features(c, posts(spark, d), all_posts(spark, d))


MARKS = ["removal_rate", "deleted_later_rate", "thin_history_raw", "karma_extremeness_raw", "karma_per_post_extremeness_raw", "reception_spread"]
_LATEST = "row_number() OVER (PARTITION BY author ORDER BY computed_at DESC NULLS LAST, " + ", ".join(f"{m} DESC NULLS LAST" for m in MARKS) + ") = 1"
_MARK_SQL = f"""
WITH l AS (SELECT author, {", ".join(f"CASE WHEN isfinite({m}) THEN {m} END AS {m}" for m in MARKS)} FROM account_botmarkers WHERE author IS NOT NULL QUALIFY {_LATEST}),
u AS (UNPIVOT l ON {", ".join(MARKS)} INTO NAME marker VALUE v), r AS (SELECT author, marker, 100 * percent_rank() OVER (PARTITION BY marker ORDER BY v) AS pctl FROM u)
"""


def marker_ranks(spark, d):
    latest = latest_rows(table(spark, d, "account_botmarkers"), "author", "computed_at", MARKS)
    known = latest.select("author", *[F.when(~F.isnan(m) & (F.abs(m) != float("inf")), F.col(m)).alias(m) for m in MARKS])
    r = ranks.ranked(known, "author", MARKS)
    return r.select("author", F.element_at(F.array(*map(F.lit, MARKS)), F.col("s") + 1).alias("marker"), (100 * ranks.percent_rank()).alias("pctl"))


@query(_MARK_SQL + "SELECT * FROM r")
def percent_rank_markers(spark, d):
    """Percent ranks of six markers over all accounts, each among its known values."""
    return marker_ranks(spark, d)


@query(_MARK_SQL + "SELECT author, count(*) AS n_markers, CASE WHEN count(*) >= 3 THEN avg(pctl) END AS composite FROM r GROUP BY 1")
def marker_composite(spark, d):
    return marker_ranks(spark, d).groupBy("author").agg(F.count("*").alias("n_markers"), F.when(F.count("*") >= 3, F.avg("pctl")).alias("composite"))


@query(f"""WITH s AS ({with_views(_STATS)}), m AS (SELECT median(mean_score) AS m FROM s), q AS (SELECT median(abs(mean_score - m)) AS mad FROM s, m)
SELECT author, abs(mean_score - m) / nullif(mad, 0) AS extremeness FROM s, m, q""")
def mad_extremeness(spark, d):
    """Distance from the median in median absolute deviations."""
    s = A.comment_stats(comments(spark, d)).select("author", "mean_score")
    m = ranks.quantile_row(s, "mean_score", {"m": 0.5})
    away = s.join(F.broadcast(m)).select("author", F.abs(F.col("mean_score") - F.col("m")).alias("away"))
    mad = ranks.quantile_row(away, "away", {"mad": 0.5})
    return away.join(F.broadcast(mad)).select("author", F.try_divide("away", "mad").alias("extremeness"))


@query("SELECT max(n) AS most, count(*) AS authors, count(*) FILTER (WHERE n >= 2) AS repeaters, sum(n)::BIGINT AS total FROM (SELECT author, count(*) AS n FROM commenters WHERE author IS NOT NULL AND author <> '[deleted]' GROUP BY 1)")
def author_totals(spark, d):
    n = table(spark, d, "commenters").filter(F.col("author").isNotNull() & ~F.col("author").isin(*SENTINELS)).groupBy("author").agg(F.count("*").alias("n"))
    return n.agg(F.max("n").alias("most"), F.count("*").alias("authors"), F.count_if(F.col("n") >= 2).alias("repeaters"), F.sum("n").alias("total"))


@query(with_views(", t AS (SELECT author, sub, count(*) AS n FROM c GROUP BY 1, 2) SELECT author, sum(n * n) / (sum(n) * sum(n)) AS hhi, arg_max(sub, (n, sub)) AS main_sub FROM t GROUP BY 1"))
def footprint_hhi(spark, d):
    """Concentration of an account's comments over communities, and its main one (ties: the last name)."""
    t = comments(spark, d).groupBy("author", "sub").agg(F.count("*").alias("n"))
    return t.groupBy("author").agg((F.sum((F.col("n") * F.col("n")).cast("double")) / (F.sum("n") * F.sum("n"))).alias("hhi"), F.max_by("sub", F.struct("n", "sub")).alias("main_sub"))


@query("SELECT trim(regexp_replace(lower(trim(sub_name)), '^/?r/', '')) AS sub, subscribers, coalesce(category, 'Other') AS category, coalesce(incentive_tier, 'unknown') AS tier FROM communities")
def catalogue(spark, d):
    return table(spark, d, "communities").select(canonical_sub("sub_name").alias("sub"), "subscribers", F.coalesce("category", F.lit("Other")).alias("category"), F.coalesce("incentive_tier", F.lit("unknown")).alias("tier"))


@query("""WITH a AS (SELECT DISTINCT author, mean_comment_score AS x FROM account_comment_stats WHERE author IS NOT NULL AND mean_comment_score IS NOT NULL)
SELECT CASE WHEN x < 1 THEN 'under 1' WHEN x < 5 THEN '1-4' WHEN x < 10 THEN '5-9' ELSE '10+' END AS bucket, count(*) AS n, min(x) AS least, max(x) AS most FROM a GROUP BY 1""")
def score_buckets(spark, d):
    a = table(spark, d, "account_comment_stats").select("author", F.col("mean_comment_score").alias("x")).dropna().distinct()
    b = F.when(F.col("x") < 1, "under 1").when(F.col("x") < 5, "1-4").when(F.col("x") < 10, "5-9").otherwise("10+")
    return a.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))


@query("""SELECT post_id, score / (2 * upvote_ratio - 1) AS votes, score / (2 * upvote_ratio - 1) * (1 - upvote_ratio) AS downs, score / (2 * upvote_ratio - 1) * upvote_ratio AS ups
FROM (SELECT DISTINCT post_id, score, upvote_ratio FROM posts) WHERE upvote_ratio > 0.5 AND score > 0""")
def implied_votes(spark, d):
    p = table(spark, d, "posts").select("post_id", "score", "upvote_ratio").distinct()
    votes, downs, ups = M.implied_votes(F.col("score"), F.col("upvote_ratio"))
    return p.select("post_id", votes.alias("votes"), downs.alias("downs"), ups.alias("ups")).filter("votes IS NOT NULL")
