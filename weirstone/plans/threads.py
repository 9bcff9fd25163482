"""Queries on threads and on what the threads of an account are like."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weirstone.operators import threads as T
from weirstone.operators.accounts import rate
from weirstone.plans.base import Registry, all_posts, comments, posts, raw_comments, with_views

query = Registry()


def parents(spark, d):
    """Each comment with the one it answers: the latest comment of its thread before it that stands one level higher."""
    c = raw_comments(spark, d).filter("ts IS NOT NULL AND depth IS NOT NULL AND post_id IS NOT NULL").select("post_id", "comment_id", "depth", "ts")
    w = Window.partitionBy("post_id", "level").orderBy("ts", "kind", "comment_id").rowsBetween(Window.unboundedPreceding, -1)
    both = c.select("post_id", "comment_id", F.col("depth").alias("level"), "ts", F.lit(0).alias("kind")).unionByName(
        c.filter("depth > 0").select("post_id", "comment_id", (F.col("depth") - 1).alias("level"), "ts", F.lit(1).alias("kind"))
    )
    last = F.last(F.when(F.col("kind") == 0, F.col("comment_id")), ignorenulls=True).over(w)
    found = both.withColumn("parent", last).filter("kind = 1").select("comment_id", F.coalesce("parent", F.lit("gone")).alias("parent"))
    return c.select("comment_id").join(found, "comment_id", "left")


@query(with_views("""
, x AS (SELECT post_id, comment_id, depth, ts FROM c0 WHERE ts IS NOT NULL AND depth IS NOT NULL AND post_id IS NOT NULL),
b AS (SELECT post_id, comment_id, depth AS level, ts, 0 AS kind FROM x UNION ALL SELECT post_id, comment_id, depth - 1, ts, 1 FROM x WHERE depth > 0),
l AS (SELECT comment_id, kind, last_value(CASE WHEN kind = 0 THEN comment_id END IGNORE NULLS)
        OVER (PARTITION BY post_id, level ORDER BY ts, kind, comment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM b),
q AS (SELECT x.comment_id, CASE WHEN l.comment_id IS NOT NULL THEN coalesce(l.parent, 'gone') END AS parent
      FROM x LEFT JOIN (SELECT * FROM l WHERE kind = 1) l USING (comment_id)),
r AS (WITH RECURSIVE t AS (
        SELECT comment_id, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS depth FROM q WHERE parent IS NULL OR parent NOT IN (SELECT comment_id FROM q)
        UNION ALL SELECT q.comment_id, t.depth + 1 FROM q JOIN t ON q.parent = t.comment_id) SELECT * FROM t)
SELECT comment_id, depth FROM r"""))
def parent_depths(spark, d):
    """Depth of every comment by its chain of parents."""
    return T.parent_depth(parents(spark, d), "comment_id", "parent")


@query(with_views("""
, x AS (SELECT comment_id, post_id, score, ts FROM c WHERE parent_is_post),
a AS (SELECT comment_id, post_id, row_number() OVER (PARTITION BY post_id ORDER BY score DESC NULLS LAST, comment_id) AS top_rank FROM x QUALIFY top_rank <= 10),
b AS (SELECT comment_id, post_id, row_number() OVER (PARTITION BY post_id ORDER BY ts, comment_id) AS first_rank FROM x WHERE ts IS NOT NULL QUALIFY first_rank <= 5)
SELECT comment_id, coalesce(a.post_id, b.post_id) AS post_id, top_rank, first_rank FROM a FULL JOIN b USING (comment_id)"""))
def reply_ranks(spark, d):
    return T.reply_ranks(comments(spark, d))


@query(with_views("""SELECT sub, month, post_id, row_number() OVER (PARTITION BY sub, month ORDER BY score DESC NULLS LAST, post_id) AS rn, rn <= 10 AS in_top
FROM p WHERE sub IS NOT NULL AND month IS NOT NULL QUALIFY rn <= 40"""))
def capped_posts(spark, d):
    return T.capped(posts(spark, d))


@query(with_views("""SELECT sub, month, post_id, row_number() OVER (PARTITION BY sub, month ORDER BY created_utc DESC, post_id) AS rn
FROM p WHERE sub IS NOT NULL AND month IS NOT NULL AND coalesce(role, '') <> 'top' AND created_utc > 0 QUALIFY rn <= 10"""))
def recent_posts(spark, d):
    return T.recent(posts(spark, d))


@query(with_views("""
, f AS (SELECT post_id, author, ts, row_number() OVER (PARTITION BY post_id ORDER BY ts, comment_id) AS rn FROM c WHERE ts IS NOT NULL QUALIFY rn <= 10),
g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY post_id ORDER BY rn) AS g FROM f)
SELECT post_id, array_to_string(list(g ORDER BY rn) FILTER (WHERE g IS NOT NULL), ',') AS gaps, array_to_string(list(author ORDER BY rn), ',') AS authors FROM g GROUP BY 1"""))
def first_arrivals(spark, d):
    """Gaps between a thread's first ten comments, and their authors, as texts."""
    f = T.first_gaps(comments(spark, d))
    gaps = F.array_join(F.transform("gaps", lambda x: x.cast("string")), ",")
    return f.select("post_id", F.when(F.size("gaps") > 0, gaps).alias("gaps"), F.array_join("authors", ",").alias("authors"))


_CONTEXT = ", ".join(f"CASE WHEN count(*) >= 5 THEN {f}({m}) END AS pc_{w}_{m}" for m in T.CONTEXT for w, f in (("mean", "avg"), ("max", "max")))


@query(with_views(f"""
, t AS (SELECT DISTINCT author, post_id FROM c)
SELECT author, count(*) AS pc_n_posts, {_CONTEXT}, CASE WHEN count(*) >= 5 THEN avg(ln(1 + subreddit_subscribers)) END AS pc_mean_log_subscribers
FROM t JOIN (SELECT * EXCLUDE (author) FROM p0) USING (post_id) GROUP BY 1"""))
def post_context(spark, d):
    return T.post_context(comments(spark, d), all_posts(spark, d))


@query(with_views("""
, m AS (SELECT sub, month, count(*) AS n FROM c WHERE sub IS NOT NULL AND month IS NOT NULL GROUP BY 1, 2),
r AS (SELECT sub, month, CASE WHEN n >= 1.5 * avg(n) OVER (PARTITION BY sub) THEN 'spike' ELSE 'calm' END AS regime FROM m)
SELECT c.author, avg(CASE WHEN regime = 'spike' THEN 1.0::DOUBLE ELSE 0 END) AS spike_share, count(*) AS n_tagged
FROM c JOIN (SELECT post_id, sub, month FROM p WHERE role = 'top') q ON q.post_id = c.post_id JOIN r ON r.sub = q.sub AND r.month = q.month GROUP BY 1"""))
def spike_share(spark, d):
    c = comments(spark, d)
    return T.spike_share(c, posts(spark, d), T.spike_months(c))


@query(with_views("SELECT author, avg(CASE WHEN meta_was_deleted_later THEN 1.0::DOUBLE ELSE 0 END) AS post_deleted_rate, count(*) AS n_posts FROM p GROUP BY 1"))
def post_deleted_rate(spark, d):
    return posts(spark, d).groupBy("author").agg(rate(F.col("meta_was_deleted_later")).alias("post_deleted_rate"), F.count("*").alias("n_posts"))


@query(with_views("""
, x AS (SELECT sub, comment_id, list_distinct(list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda w: w <> '')) AS ws FROM c WHERE sub IS NOT NULL AND body IS NOT NULL),
y AS (SELECT * FROM x WHERE len(ws) > 0), n AS (SELECT sub, count(*) AS n FROM y GROUP BY 1), w AS (SELECT sub, comment_id, len(ws) AS k, unnest(ws) AS w FROM y),
z AS (SELECT a.sub, a.comment_id AS x, b.comment_id AS y, count(*) AS i, max(a.k) AS ka, max(b.k) AS kb FROM w a JOIN w b ON a.sub = b.sub AND a.w = b.w AND a.comment_id < b.comment_id GROUP BY 1, 2, 3),
f AS (SELECT sub, count(*) AS n_pairs FROM z WHERE i * 5 > (ka + kb - i) * 3 GROUP BY 1)
SELECT sub, n, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_pairs, 0) * 2.0::DOUBLE / nullif(n * (n - 1), 0) AS rate FROM n LEFT JOIN f USING (sub)"""))
def similar_text_rate(spark, d):
    """Share of a community's pairs of comments whose word sets are similar by more than 0.6."""
    return T.similar_rate(comments(spark, d).filter("body IS NOT NULL"), "sub", "comment_id", "body")
