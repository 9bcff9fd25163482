"""Queries on samples, splits, strata, calendars, correlations and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirstone.operators import accounts as A
from weirstone.operators import ranks, screening, stats
from weirstone.operators import text as X
from weirstone.plans import research
from weirstone.plans.base import Registry, all_posts, comments, posts, with_views
from weirstone.session import shuffles_dropped, written
from weirstone.sources.tables import table

query = Registry()

_H = "md5('42:' || {0})"
_N = "('0x' || substr(md5('42:' || {0}), 1, 8))::UBIGINT"


# samples and splits


@query(with_views(f"SELECT post_id FROM p0 ORDER BY {_H.format('post_id')}, post_id LIMIT 200"))
def sampled_posts(spark, d):
    return stats.hash_sample(all_posts(spark, d).select("post_id"), "post_id", 200)


@query(with_views(f"SELECT sub, post_id FROM p0 WHERE sub IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sub ORDER BY {_H.format('post_id')}, post_id) <= 5"))
def sampled_by_community(spark, d):
    return stats.hash_sample(all_posts(spark, d).filter("sub IS NOT NULL").select("sub", "post_id"), "post_id", 5, ["sub"])


@query(with_views(f"SELECT sub, ({_N.format('sub')} % 5)::INT AS fold, count(*) AS n FROM p0 WHERE sub IS NOT NULL GROUP BY 1, 2"))
def community_folds(spark, d):
    """Folds that keep a community together."""
    return stats.folds(all_posts(spark, d).filter("sub IS NOT NULL"), "sub").groupBy("sub", "fold").agg(F.count("*").alias("n"))


_TIER = """
, tf AS (SELECT c.author, count(*) FILTER (WHERE incentive_tier = 'high') / count(*) AS h, count(*) FILTER (WHERE incentive_tier = 'medium') / count(*) AS m FROM c JOIN (SELECT post_id, sub, month, incentive_tier FROM p0) q
       ON c.post_id = q.post_id AND c.sub = q.sub AND c.month = q.month GROUP BY 1),
fs AS (SELECT author, min(ts) AS seen FROM c WHERE ts IS NOT NULL GROUP BY 1)
"""


@query(with_views(_TIER + f"""
, x AS (SELECT author, CASE WHEN h >= 0.5 THEN 'high' WHEN m >= 0.5 THEN 'medium' ELSE 'low_or_mixed' END AS tier, ntile(10) OVER (ORDER BY seen, author) AS decile FROM tf JOIN fs USING (author)),
y AS (SELECT *, row_number() OVER (PARTITION BY tier, decile ORDER BY {_H.format('author')}, author) AS r, floor(count(*) OVER (PARTITION BY tier, decile) / 3) AS t FROM x)
SELECT author, tier, decile, CASE WHEN r <= t THEN 1 WHEN r <= 2 * t THEN 2 ELSE 3 END AS part FROM y"""))
def three_parts(spark, d):
    """Accounts in three parts, balanced over the tier of their threads and the tenth of first sight."""
    c = comments(spark, d)
    f = A.tier_footprint(c, all_posts(spark, d))
    j = c.select("author", "post_id", "sub", "month").join(all_posts(spark, d).select("post_id", "sub", "month"), ["post_id", "sub", "month"])
    n = j.groupBy("author").agg(F.count("*").alias("k"))
    tier = F.when(F.col("n_high") / F.col("k") >= 0.5, "high").when(F.col("n_medium") / F.col("k") >= 0.5, "medium").otherwise("low_or_mixed")
    seen = c.filter("ts IS NOT NULL").groupBy("author").agg(F.min("ts").alias("seen"))
    x = screening.equal_strata(f.join(n, "author").select("author", tier.alias("tier")).join(seen, "author"), "author", "seen", 10, "decile")
    return stats.three_parts(x, "author", ["tier", "decile"]).select("author", "tier", "decile", "part")


@query(research._EDGES + f"""
, s AS (SELECT a1, a2, {_N.format('a1')} < 3006477107 AS x, {_N.format('a2')} < 3006477107 AS y FROM (SELECT DISTINCT a1, a2 FROM e))
SELECT a1, a2, CASE WHEN x THEN 'train' ELSE 'test' END AS side FROM s WHERE x = y""")
def pair_sides(spark, d):
    """Pairs whose accounts are on one side; pairs across are dropped."""
    return stats.disjoint_sides(research.edges(spark, d).select("a1", "a2").distinct(), "a1", "a2")


# strata and screens


@query(with_views("""
, v AS (SELECT post_id, score FROM p0 WHERE score IS NOT NULL), e AS (SELECT list_distinct([quantile_cont(score, i / 10) FOR i IN [1, 2, 3, 4, 5, 6, 7, 8, 9]]) AS e FROM v)
SELECT stratum, count(*) AS n, min(score) AS least, max(score) AS most FROM (SELECT score, len(list_filter(e, lambda q: q < score)) AS stratum FROM v, e) GROUP BY 1""".replace(
    "[quantile_cont(score, i / 10) FOR i IN [1, 2, 3, 4, 5, 6, 7, 8, 9]]", "quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])")))
def score_strata(spark, d):
    s = screening.strata(all_posts(spark, d).filter("score IS NOT NULL"), "score")
    return s.groupBy("stratum").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@query(with_views("SELECT author, ntile(25) OVER (ORDER BY seen, author) AS stratum FROM (SELECT author, min(ts) AS seen FROM c WHERE ts IS NOT NULL GROUP BY 1)"))
def first_sight_strata(spark, d):
    """25 strata of equally many accounts, by first sight."""
    seen = comments(spark, d).filter("ts IS NOT NULL").groupBy("author").agg(F.min("ts").alias("seen"))
    return screening.equal_strata(seen, "author", "seen", 25).select("author", "stratum")


@query(with_views("""
, s AS (SELECT author, count(*) AS n, avg(score) AS m, avg(depth) AS d FROM c GROUP BY 1)
SELECT 1 AS step, 'n >= 3' AS rule, count(*) FILTER (WHERE n >= 3) AS n FROM s UNION ALL SELECT 2, 'm <= 20', count(*) FILTER (WHERE n >= 3 AND m <= 20) FROM s
UNION ALL SELECT 3, 'd >= 1', count(*) FILTER (WHERE n >= 3 AND m <= 20 AND d >= 1) FROM s"""))
def boundary_steps(spark, d):
    s = comments(spark, d).groupBy("author").agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.avg("depth").alias("d"))
    return screening.boundary_rule(s, [("n", ">=", 3), ("m", "<=", 20), ("d", ">=", 1)])


_CURVE = """
, k AS (SELECT score AS x, count(*) FILTER (WHERE role = 'top') AS a, count(*) FILTER (WHERE role <> 'top') AS b FROM p0 WHERE score IS NOT NULL AND role IS NOT NULL GROUP BY 1),
cu AS (SELECT x::DOUBLE AS score, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER () AS pos, sum(b) OVER () AS neg, a FROM k WINDOW w AS (ORDER BY x DESC))
"""


def _labelled(spark, d) -> DataFrame:
    return all_posts(spark, d).filter("role IS NOT NULL").select("post_id", "score", (F.col("role") == "top").cast("int").alias("y"))


@query(with_views(_CURVE + "SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, pos::BIGINT AS pos, neg::BIGINT AS neg FROM cu"))
def precision_curve(spark, d):
    """True and false positives at each score, from the highest."""
    return screening.curve(_labelled(spark, d), "y", "score")


@query(with_views(_CURVE + "SELECT sum(a * tp / (tp + fp)) / max(pos) AS ap, coalesce(max(CASE WHEN fp <= 0.01 * neg THEN tp / pos END), 0) AS recall_at_1pct FROM cu"))
def average_precision(spark, d):
    return screening.average_precision(screening.curve(_labelled(spark, d), "y", "score"))


_PVALUES = """
, x AS (SELECT sub, count(*) AS n, avg(score) AS m FROM p0 WHERE sub IS NOT NULL AND score IS NOT NULL GROUP BY 1),
pv AS (SELECT sub, 1 / (1 + n + abs(m)) AS p FROM x), r AS (SELECT sub, p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS i, count(*) OVER () AS n FROM pv),
k AS (SELECT max(p) AS k FROM r WHERE p <= i / n * 0.05)
"""


@query(with_views(_PVALUES + "SELECT sub, p, coalesce(p <= k, FALSE) AS rejected FROM r, k"))
def discoveries(spark, d):
    """A false discovery rate over a made-up p of each community, which shows the procedure."""
    x = all_posts(spark, d).dropna(subset=["sub", "score"]).groupBy("sub").agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    return stats.benjamini_hochberg(x.select("sub", (1 / (1 + F.col("n") + F.abs("m"))).alias("p")), "sub", "p")


@query(with_views("""
, v AS (SELECT sub, post_id, num_comments_reported AS v, ln(1 + greatest(num_comments_reported, 0)) AS x FROM p0 WHERE sub IS NOT NULL AND num_comments_reported IS NOT NULL),
e AS (SELECT sub, min(x) AS lo, max(x) AS hi FROM v GROUP BY 1 HAVING count(*) >= 30),
b AS (SELECT sub, lo, hi, coalesce(least(49, floor((x - lo) / nullif((hi - lo) / 50, 0))), 0) AS b, count(*) AS k FROM v JOIN e USING (sub) GROUP BY ALL),
m AS (SELECT sub, exp(any_value(lo) + (arg_max(b, (k, -b)) + 0.5) * (any_value(hi) - any_value(lo)) / 50) - 1 AS mode FROM b GROUP BY 1)
SELECT post_id, v - mode AS vs_mode FROM v LEFT JOIN m USING (sub)"""))
def mode_distance(spark, d):
    p = all_posts(spark, d).filter("sub IS NOT NULL AND num_comments_reported IS NOT NULL").select("sub", "post_id", F.col("num_comments_reported").alias("v"))
    return screening.mode_distance(p, "sub", "v").select("post_id", "vs_mode")


@query(with_views("SELECT sub, count(*) FILTER (WHERE role = 'top') AS top, count(*) FILTER (WHERE role = 'random') AS random FROM p0 WHERE sub IS NOT NULL GROUP BY 1"))
def role_table(spark, d):
    return screening.cross_table(all_posts(spark, d).filter("sub IS NOT NULL"), "sub", "role", ["top", "random"])


@query(with_views("""
, x AS (SELECT (role = 'top')::INT AS g, coalesce(score > 50, FALSE) AS e FROM p0 WHERE role IS NOT NULL), r AS (SELECT avg(e::INT) FILTER (WHERE g = 1) AS a, avg(e::INT) FILTER (WHERE g = 0) AS b FROM x)
SELECT a AS rate_1, b AS rate_0, a / nullif(b, 0) AS ratio FROM r"""))
def score_rate_ratio(spark, d):
    p = all_posts(spark, d).filter("role IS NOT NULL").select((F.col("role") == "top").cast("int").alias("g"), F.coalesce(F.col("score") > 50, F.lit(False)).alias("e"))
    return screening.rate_ratio(p, "g", "e")


@query(with_views(f"""
, x AS (SELECT (role = 'top')::INT AS y, least(1, greatest(0, upvote_ratio)) AS s, {_N.format('post_id')} % 5 = 0 AS h FROM p0 WHERE role IS NOT NULL AND upvote_ratio IS NOT NULL),
a AS (SELECT avg(s) FILTER (WHERE y = 1 AND h) AS c, avg(y) AS naive, avg(s) AS m FROM x)
SELECT c, naive, least(m / nullif(c, 0), 1) AS corrected, coalesce(m / nullif(c, 0) > 1, TRUE) AS degenerate FROM a"""))
def unlabelled_share(spark, d):
    """Positives among the unlabelled, by the mean score of held-out positives."""
    p = all_posts(spark, d).filter("role IS NOT NULL AND upvote_ratio IS NOT NULL")
    p = p.select((F.col("role") == "top").cast("int").alias("y"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("upvote_ratio"))).alias("s"), (stats.hash_number("post_id") % 5 == 0).alias("h"))
    return screening.elkan_noto(p, "y", "s", "h")


# correlations and tests

COLUMNS = ["score", "num_comments_reported", "upvote_ratio", "n_comments_observed"]
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
_RK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2)"
_CORR = " UNION ALL ".join(
    f"SELECT '{COLUMNS[i]}' AS a, '{COLUMNS[j]}' AS b, CASE WHEN count(*) >= 100 THEN round(coalesce(corr(x, y), 0), 9) ELSE 0 END AS rho, count(*) AS n FROM"
    f" (SELECT {_RK.format(COLUMNS[i])} AS x, {_RK.format(COLUMNS[j])} AS y FROM p0 WHERE {COLUMNS[i]} IS NOT NULL AND {COLUMNS[j]} IS NOT NULL)"
    for i, j in _PAIRS
)


def _matrix(spark, d) -> DataFrame:
    return stats.rank_correlations(all_posts(spark, d), "post_id", COLUMNS).withColumn("rho", F.round("rho", 9))


@query(with_views(f", m AS ({_CORR}) SELECT * FROM m"))
def rank_matrix(spark, d):
    return _matrix(spark, d)


@query(with_views(f", m AS ({_CORR}), a AS (SELECT *, 'positive' AS side FROM m WHERE rho > 0 ORDER BY rho DESC, a, b LIMIT 3), b AS (SELECT *, 'negative' AS side FROM m WHERE rho < 0 ORDER BY rho, a, b LIMIT 3) SELECT * FROM a UNION ALL SELECT * FROM b"))
def strongest_correlations(spark, d):
    m = _matrix(spark, d)
    side = lambda df, o, s: df.orderBy(o, "a", "b").limit(3).withColumn("side", F.lit(s))
    return side(m.filter("rho > 0"), F.desc("rho"), "positive").unionByName(side(m.filter("rho < 0"), F.asc("rho"), "negative"))


@query(with_views("""
, v AS (SELECT role AS g, upvote_ratio AS v FROM p0 WHERE role IS NOT NULL AND upvote_ratio IS NOT NULL), s AS (SELECT g, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS w FROM v GROUP BY 1),
t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) AS s, sum(n * m * m) AS q, sum(w) AS w FROM s)
SELECT round((q - s * s / n) / (k - 1) / (w / (n - k)), 6) AS f, k AS groups, n::BIGINT AS n FROM t"""))
def ratio_anova(spark, d):
    return stats.anova(all_posts(spark, d).filter("role IS NOT NULL"), "role", "upvote_ratio").withColumn("f", F.round("f", 6))


@query(with_views("""
, k AS (SELECT score, count(*)::DOUBLE AS t FROM p0 WHERE score IS NOT NULL GROUP BY 1), t AS (SELECT sum(t) AS n, sum(t * t * t - t) AS ties FROM k)
SELECT n::BIGINT AS n, 1 - ties / nullif(n * n * n - n, 0) AS correction FROM t"""))
def tie_correction(spark, d):
    """What rank statistics over scores are divided by for their ties."""
    t = stats.tie_term(all_posts(spark, d), "score")
    return t.select(F.col("n").cast("bigint").alias("n"), (1 - F.try_divide(F.col("ties"), F.col("n") * F.col("n") * F.col("n") - F.col("n"))).alias("correction"))


@query(with_views("SELECT sub, month, count(score) AS n, min(score) AS least, quantile_cont(score, 0.1) AS p10, median(score) AS median, quantile_cont(score, 0.9) AS p90, max(score) AS most, avg(score) AS mean FROM p0 GROUP BY 1, 2"))
def score_summary(spark, d):
    return stats.summary(all_posts(spark, d), ["sub", "month"], "score")


@query(with_views("""
, v AS (SELECT ln(1 + greatest(score, 0)) AS x, ln(1 + greatest(num_comments_reported, 0)) AS y FROM p0 WHERE score IS NOT NULL AND num_comments_reported IS NOT NULL),
m AS (SELECT count(*)::DOUBLE AS n, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, stddev_samp(x) * count(*) ** (-1 / 6) AS hx, stddev_samp(y) * count(*) ** (-1 / 6) AS hy FROM v),
g AS (SELECT *, ax + (bx - ax) * i / 19 AS gx, ay + (by_ - ay) * j / 19 AS gy FROM m, range(20) a(i), range(20) b(j))
SELECT round(gx, 9) AS gx, round(gy, 9) AS gy, round(sum(exp(-(((gx - x) / hx) ** 2 + ((gy - y) / hy) ** 2) / 2)) / max(n * hx * hy * 6.283185307179586), 9) AS density FROM v, g GROUP BY gx, gy"""))
def density_2d(spark, d):
    p = all_posts(spark, d).dropna(subset=["score", "num_comments_reported"])
    log = lambda c: F.ln(1 + F.greatest(F.col(c), F.lit(0)))
    g = stats.density_2d(p.select(log("score").alias("x"), log("num_comments_reported").alias("y")), "x", "y")
    return g.select(*[F.round(c, 9).alias(c) for c in g.columns])


# pairs


@query(research._EDGES + ", q AS (SELECT quantile_cont(z, 0.99) AS q FROM e WHERE z IS NOT NULL) SELECT sub, a1, a2, n, z, coalesce(z >= q, FALSE) AS top_z FROM e, q")
def pair_pool(spark, d):
    """Pairs that met twice or more, those at or over the 99th percentile of z flagged."""
    e = research.edges(spark, d)
    return e.join(F.broadcast(e.agg(F.percentile("z", F.lit(0.99)).alias("q")))).select("sub", "a1", "a2", "n", "z", F.coalesce(F.col("z") >= F.col("q"), F.lit(False)).alias("top_z"))


@query(with_views(research._E + """
, f AS (SELECT post_id, author, min(ts) AS t FROM c WHERE ts IS NOT NULL GROUP BY 1, 2), q AS (SELECT DISTINCT a1, a2 FROM e),
g AS (SELECT a1, a2, median(abs(x.t - y.t)) AS gap FROM q JOIN f x ON x.author = a1 JOIN f y ON y.author = a2 AND y.post_id = x.post_id GROUP BY 1, 2), l AS (SELECT quantile_cont(gap, 0.05) AS l FROM g)
SELECT a1, a2, gap, gap <= l AS tight FROM g, l"""))
def tight_pairs(spark, d):
    """Pairs whose median gap is within the 5th percentile of all."""
    with shuffles_dropped(spark):
        g = written(research.arrival_gaps(spark, d).select("a1", "a2", F.col("median_gap").alias("gap")))
    return g.join(F.broadcast(g.agg(F.percentile("gap", F.lit(0.05)).alias("l")))).select("a1", "a2", "gap", (F.col("gap") <= F.col("l")).alias("tight"))


@query(with_views(research._E + """
, s AS (SELECT author, min(ts) AS seen FROM c WHERE ts IS NOT NULL GROUP BY 1), q AS (SELECT DISTINCT a1, a2 FROM e),
g AS (SELECT a1, a2, abs(x.seen - y.seen) / 86400 AS gap FROM q LEFT JOIN s x ON x.author = a1 LEFT JOIN s y ON y.author = a2)
SELECT a1, a2, 1 / (1 + ln(1 + coalesce(gap, max(gap) OVER ()))) AS cohort FROM g"""))
def cohort_similarity(spark, d):
    """Nearness of two accounts' first sight; unknown gaps count as the greatest."""
    s = comments(spark, d).filter("ts IS NOT NULL").groupBy("author").agg(F.min("ts").alias("seen"))
    side = lambda x: s.select(F.col("author").alias(f"a{x}"), F.col("seen").alias(f"s{x}"))
    g = research.edges(spark, d).select("a1", "a2").distinct().join(side(1), "a1", "left").join(side(2), "a2", "left").select("a1", "a2", (F.abs(F.col("s1") - F.col("s2")) / 86400).alias("gap"))
    most = g.agg(F.max("gap").alias("most"))  # one row
    return g.join(F.broadcast(most)).select("a1", "a2", (1 / (1 + F.log1p(F.coalesce("gap", "most")))).alias("cohort"))


# filters, calendars, texts


@query(with_views("""
SELECT author, count(*) AS n, count(DISTINCT domain) AS domains FROM (SELECT DISTINCT post_id, author, domain FROM posts)
WHERE author IS NOT NULL AND author NOT ILIKE '%bot%' AND author NOT ILIKE '%mod%' AND author <> '[deleted]' AND domain IS NOT NULL AND NOT starts_with(domain, 'self.') GROUP BY 1"""))
def linked_domains(spark, d):
    """Outside domains of accounts whose names don't speak of automation or moderation."""
    p = table(spark, d, "posts").select("post_id", "author", "domain").distinct()
    ok = F.col("author").isNotNull() & (F.col("author") != "[deleted]") & F.col("domain").isNotNull() & ~F.startswith("domain", F.lit("self."))
    for pattern in ("%bot%", "%mod%"):
        ok = ok & ~F.ilike("author", F.lit(pattern))
    return p.filter(ok).groupBy("author").agg(F.count("*").alias("n"), F.countDistinct("domain").alias("domains"))


@query(with_views("""
, l AS (SELECT max(month) AS m FROM c), k AS (SELECT unnest(generate_series((m || '-01')::DATE - INTERVAL 11 MONTH, (m || '-01')::DATE, INTERVAL 1 MONTH)) AS day FROM l),
b AS (SELECT strftime(day, '%Y-%m') AS month, epoch(day::TIMESTAMP)::BIGINT AS begin_at, epoch((day + INTERVAL 1 MONTH)::TIMESTAMP)::BIGINT - 1 AS end_at FROM k)
SELECT b.month, begin_at, end_at, count(c.comment_id) AS n FROM b LEFT JOIN c ON c.ts BETWEEN begin_at AND end_at GROUP BY 1, 2, 3"""))
def calendar(spark, d):
    """The last twelve months with their bounds in seconds and the comments written within them."""
    c = comments(spark, d)
    last = c.agg(F.to_date(F.concat(F.max("month"), F.lit("-01"))).alias("m"))  # one row
    b = last.select(F.explode(F.sequence(F.add_months("m", -11), F.col("m"), F.expr("INTERVAL 1 MONTH"))).alias("day"))
    seconds = lambda x: F.unix_date(x).cast("bigint") * 86400
    b = b.select(F.date_format("day", "yyyy-MM").alias("month"), seconds(F.col("day")).alias("begin_at"), (seconds(F.add_months("day", 1)) - 1).alias("end_at"))
    # a month of a comment's own time makes it an equi-join; comments outside the months leave before it
    at = c.filter("ts IS NOT NULL").groupBy(F.date_format(F.date_from_unix_date(F.floor(F.col("ts") / 86400).cast("int")), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return b.join(at, "month", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(with_views("SELECT ((ts // 3600) % 24 + 5) % 24 AS hour, count(*) AS n FROM c WHERE ts IS NOT NULL GROUP BY 1"))
def local_hours(spark, d):
    """Comments by hour at a fixed offset of five hours."""
    hour = F.expr("(ts div 3600) % 24 + 5") % 24
    return comments(spark, d).filter("ts IS NOT NULL").groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))


@query(with_views(f", w AS (SELECT sub, {research._WORDS} AS word FROM c WHERE sub IS NOT NULL), k AS (SELECT sub, word, count(*) AS n FROM w GROUP BY 1, 2) SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY sub ORDER BY n DESC, word) <= 20"))
def top_words(spark, d):
    from weirstone.operators.prevalence import top_per_group

    k = X.word_counts(comments(spark, d).filter("sub IS NOT NULL"), ["sub"], "body")
    return top_per_group(k, ["sub"], [F.desc("n"), F.col("word")], 20).drop("rn")


@query(with_views("""
, a AS (SELECT DISTINCT author FROM c), b AS (SELECT DISTINCT author FROM p), m AS (SELECT DISTINCT author FROM account_botmarkers WHERE author IS NOT NULL), t AS (SELECT author FROM c GROUP BY 1 HAVING count(*) < 3)
SELECT author FROM a JOIN b USING (author) JOIN m USING (author) WHERE author NOT IN (SELECT author FROM t)"""))
def known_everywhere(spark, d):
    """Accounts that comment, post and have markers, without thin ones."""
    c = comments(spark, d)
    n = c.groupBy("author").agg(F.count("*").alias("n"))
    out = n.select("author").join(posts(spark, d), "author", "left_semi").join(table(spark, d, "account_botmarkers"), "author", "left_semi")
    return out.join(n.filter("n < 3"), "author", "left_anti")


@query(with_views("""
, f AS (SELECT author, comment_id, body, row_number() OVER (PARTITION BY author ORDER BY ts NULLS LAST, comment_id) AS rn FROM c WHERE body IS NOT NULL QUALIFY rn <= 20)
SELECT author, length(string_agg(body, ' ' ORDER BY rn)) AS n_chars, md5(string_agg(body, ' ' ORDER BY rn)) AS digest FROM f GROUP BY 1"""))
def first_bodies(spark, d):
    """An account's first twenty texts in one, by length and digest."""
    from weirstone.operators.prevalence import top_per_group

    f = top_per_group(comments(spark, d).filter("body IS NOT NULL"), ["author"], [F.asc_nulls_last("ts"), F.col("comment_id")], 20)
    t = f.groupBy("author").agg(F.sort_array(F.collect_list(F.struct("rn", "body"))).alias("a")).select("author", F.array_join(F.transform("a", lambda x: x["body"]), " ").alias("t"))
    return t.select("author", F.length("t").cast("bigint").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(with_views("""
SELECT author, count(*) AS n, avg(score) * ln(1 + avg(body_len)) AS score_length, avg(score) * avg(depth) AS score_depth, max(is_submitter::INT) AS ever_submitter FROM c GROUP BY 1"""))
def interactions(spark, d):
    c = comments(spark, d).groupBy("author").agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("body_len").alias("b"), F.avg("depth").alias("d"), F.max(F.col("is_submitter").cast("int")).alias("ever_submitter"))
    return c.select("author", "n", (F.col("s") * F.log1p("b")).alias("score_length"), (F.col("s") * F.col("d")).alias("score_depth"), "ever_submitter")


# features for models


@query("""
WITH a AS (SELECT author, max(n_comments_sample) AS n, max(removal_rate) AS r, max(controversiality_rate) AS v, max(is_submitter_rate) AS s FROM account_comment_stats WHERE author IS NOT NULL GROUP BY 1),
t AS (""" + with_views("""SELECT c.author AS author, count(*) FILTER (WHERE incentive_tier = 'high') AS h, count(*) FILTER (WHERE incentive_tier = 'medium') AS m, count(*) FILTER (WHERE incentive_tier = 'low') AS l
  FROM c JOIN (SELECT post_id, sub, month, incentive_tier FROM p0) q ON c.post_id = q.post_id AND c.sub = q.sub AND c.month = q.month GROUP BY 1""") + """),
k AS (SELECT 'r' AS f, r AS x, count(*) AS k FROM a WHERE r IS NOT NULL GROUP BY 2 UNION ALL SELECT 'v', v, count(*) FROM a WHERE v IS NOT NULL GROUP BY 2 UNION ALL SELECT 's', s, count(*) FROM a WHERE s IS NOT NULL GROUP BY 2),
h AS (SELECT f, arg_max(x, (k, -x)) AS x, max(k) / sum(k) AS share FROM k GROUP BY 1)
SELECT author, t.h / nullif(n, 0) AS high_share, t.m / nullif(n, 0) AS medium_share, t.l / nullif(n, 0) AS low_share,
 CASE WHEN (SELECT share FROM h WHERE f = 'r') >= 0.25 THEN r IS NOT NULL AND r <> (SELECT x FROM h WHERE f = 'r') END AS r_hurdle,
 CASE WHEN (SELECT share FROM h WHERE f = 'v') >= 0.25 THEN v IS NOT NULL AND v <> (SELECT x FROM h WHERE f = 'v') END AS v_hurdle,
 CASE WHEN (SELECT share FROM h WHERE f = 's') >= 0.25 THEN s IS NOT NULL AND s <> (SELECT x FROM h WHERE f = 's') END AS s_hurdle FROM a LEFT JOIN t USING (author)""")
def sanitised_features(spark, d):
    """Tier shares, and an indicator for each feature of which one value holds a quarter of the known values or more."""
    s = table(spark, d, "account_comment_stats").filter("author IS NOT NULL").groupBy("author").agg(
        F.max("n_comments_sample").alias("n"), F.max("removal_rate").alias("r"), F.max("controversiality_rate").alias("v"), F.max("is_submitter_rate").alias("s")
    )
    t = A.tier_footprint(comments(spark, d), all_posts(spark, d)).select("author", *[F.col(f"n_{x}") for x in ("high", "medium", "low")])
    out = screening.hurdles(s, ["r", "v", "s"]).join(t, "author", "left")
    return out.select("author", *[F.try_divide(F.col(f"n_{x}").cast("double"), F.col("n").cast("double")).alias(f"{x}_share") for x in ("high", "medium", "low")], "r_hurdle", "v_hurdle", "s_hurdle")


@query(with_views("""
, v AS (SELECT ln(1 + greatest(score, 0)) AS x FROM p0 WHERE score IS NOT NULL), m AS (SELECT count(*)::DOUBLE AS n, stddev_samp(x) * count(*) ** -0.2 AS h, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM v),
g AS (SELECT lo + (hi - lo) * i / 49 AS g, i, h, n FROM m, range(50) a(i)), d AS (SELECT i, sum(exp(-(((g - x) / h) ** 2) / 2)) AS d FROM v, g GROUP BY 1)
SELECT round(min(d) / nullif(least(max(d) FILTER (WHERE i = 0), max(d) FILTER (WHERE i = 49)), 0), 9) AS ratio FROM d"""))
def valley_ratio(spark, d):
    """Density at the lowest point between the 10th and 90th percentile over the lower of the two ends: far under 1 means a real dip."""
    p = all_posts(spark, d).filter("score IS NOT NULL").select(F.ln(1 + F.greatest(F.col("score"), F.lit(0))).alias("x"))
    ends = p.agg(F.percentile("x", F.lit(0.1)).alias("lo"), F.percentile("x", F.lit(0.9)).alias("hi"))
    return screening.valley(p, "x", ends).withColumn("ratio", F.round("ratio", 9))
