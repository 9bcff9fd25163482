"""Threads: depth by parents, ranks of replies, profiles, and what the threads of an account are like."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirstone.operators.accounts import rate
from weirstone.operators.prevalence import top_per_group
from weirstone.operators.similar import counted_pairs
from weirstone.session import checkpointed, shuffles_dropped, written

#: Levels that a chain of parents may have.
GUARD = 200


def parent_depth(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(``key``, depth): 0 for rows without a parent, 1 for rows whose parent isn't there, else the parent's depth + 1, at most ``GUARD``.

    Pointers are doubled, so a chain of n parents takes log2(n) joins. Chains that run in a circle end at the guard.
    """
    k = df.select(F.col(key).alias("k"), F.col(parent).alias("up")).filter("k IS NOT NULL").dropDuplicates(["k"])
    known = k.select(F.col("k").alias("up"), F.lit(True).alias("there"))
    start = k.join(known, "up", "left")
    # up: the ancestor reached so far, d: the steps to it; a chain is at its end when up is null
    state = start.select("k", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("d"))
    state = checkpointed(state)
    steps = 1
    while steps < GUARD and state.filter("up IS NOT NULL").head(1):
        far = state.select(F.col("k").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        state = checkpointed(state.join(far, "up", "left").select("k", F.col("up2").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")))
        steps *= 2
    return state.select(F.col("k").alias(key), F.least("d", F.lit(GUARD)).cast("bigint").alias("depth"))


def reply_ranks(c: DataFrame, top: int = 10, first: int = 5) -> DataFrame:
    """(comment_id, post_id, top_rank, first_rank) of direct replies: the ``top`` best by score and the ``first`` earliest of each thread; null beyond."""
    direct = c.filter("parent_is_post").select("comment_id", "post_id", "score", "ts")
    best = top_per_group(direct, ["post_id"], [F.desc_nulls_last("score"), F.col("comment_id")], top, "top_rank")
    soon = top_per_group(direct.filter("ts IS NOT NULL"), ["post_id"], [F.col("ts"), F.col("comment_id")], first, "first_rank")
    both = best.select("comment_id", "post_id", "top_rank").join(soon.select("comment_id", "post_id", "first_rank"), ["comment_id", "post_id"], "full")
    return both.select("comment_id", "post_id", F.col("top_rank").cast("bigint").alias("top_rank"), F.col("first_rank").cast("bigint").alias("first_rank"))


def capped(p: DataFrame, cap: int = 40, marked: int = 10) -> DataFrame:
    """(sub, month, post_id, rn, in_top): the ``cap`` best posts of each cell, the first ``marked`` flagged."""
    t = top_per_group(p.filter("sub IS NOT NULL AND month IS NOT NULL"), ["sub", "month"], [F.desc_nulls_last("score"), F.col("post_id")], cap)
    return t.select("sub", "month", "post_id", F.col("rn").cast("bigint").alias("rn"), (F.col("rn") <= marked).alias("in_top"))


def recent(p: DataFrame, n: int = 10) -> DataFrame:
    """(sub, month, post_id, rn): the latest ``n`` posts of each cell that aren't top posts."""
    other = p.filter("sub IS NOT NULL AND month IS NOT NULL AND coalesce(role, '') <> 'top' AND created_utc > 0")
    t = top_per_group(other, ["sub", "month"], [F.desc("created_utc"), F.col("post_id")], n)
    return t.select("sub", "month", "post_id", F.col("rn").cast("bigint").alias("rn"))


def first_gaps(c: DataFrame, n: int = 10) -> DataFrame:
    """(post_id, gaps, authors): the first ``n`` comments' gaps in seconds, and their authors, in order of time."""
    f = top_per_group(c.filter("ts IS NOT NULL"), ["post_id"], [F.col("ts"), F.col("comment_id")], n)
    a = f.groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("rn", "ts", "author"))).alias("a"))  # n rows at most
    times = F.transform("a", lambda x: x["ts"])
    gap = F.when(F.size("a") > 1, F.zip_with(F.slice(times, 2, n), F.slice(times, 1, F.size("a") - 1), lambda y, x: y - x)).otherwise(F.array().cast("array<bigint>"))
    return a.select("post_id", gap.alias("gaps"), F.transform("a", lambda x: x["author"]).alias("authors"))


#: Measures of a thread whose mean and maximum over an account's threads make the context family.
CONTEXT = ["score", "upvote_ratio", "num_comments_reported", "n_comments_observed"]


def post_context(c: DataFrame, p: DataFrame, gate: int = 5) -> DataFrame:
    """(author, pc_n_posts, pc_*): mean and maximum of the measures of the distinct threads an account commented in, and mean log1p of subscribers.

    Under ``gate`` threads the columns are null; the account stays.
    """
    t = c.select("author", "post_id").distinct().join(p.select("post_id", "subreddit_subscribers", *CONTEXT), "post_id")
    n = F.count("*")
    shown = lambda x: F.when(n >= gate, x)
    cols = [shown(f(m)).alias(f"pc_{w}_{m}") for m in CONTEXT for w, f in (("mean", F.avg), ("max", F.max))]
    return t.groupBy("author").agg(n.alias("pc_n_posts"), *cols, shown(F.avg(F.log1p("subreddit_subscribers"))).alias("pc_mean_log_subscribers"))


def spike_months(c: DataFrame, times: float = 1.5) -> DataFrame:
    """(sub, month, regime): 'spike' where a community's comments are ``times`` its monthly mean or more, else 'calm'."""
    m = c.filter("sub IS NOT NULL AND month IS NOT NULL").groupBy("sub", "month").agg(F.count("*").alias("n"))
    mean = F.avg("n").over(Window.partitionBy("sub"))  # one row a month
    return m.withColumn("mean", mean).select("sub", "month", F.when(F.col("n") >= times * F.col("mean"), "spike").otherwise("calm").alias("regime"))


def spike_share(c: DataFrame, p: DataFrame, regimes: DataFrame) -> DataFrame:
    """(author, spike_share, n_tagged) over comments below top posts, by the regime of the post's community and month."""
    tagged = c.select("author", "post_id").join(p.filter("role = 'top'").select("post_id", "sub", "month"), "post_id").join(regimes, ["sub", "month"])
    return tagged.groupBy("author").agg(rate(F.col("regime") == "spike").alias("spike_share"), F.count("*").alias("n_tagged"))


def similar_rate(df: DataFrame, group: str, key: str, text: str, num: int = 3, den: int = 5) -> DataFrame:
    """(group, n, n_pairs, rate): texts of a group, pairs of them whose word sets are similar by more than num / den, and their share of all pairs of texts with words.

    Pairs are met in the cells of their rarest words only, never all against all, and are counted where they are met; a key has one text.
    """
    ws = F.array_distinct(F.filter(F.split(F.lower(F.col(text)), r"[^a-z0-9]+"), lambda w: w != ""))
    with shuffles_dropped(df.sparkSession):
        rows = df.select(F.col(group).alias("g"), F.col(key).isNotNull().alias("known"), F.transform(ws, lambda w: F.xxhash64(w)).alias("ws"))
        rows = written(rows.filter(F.col("g").isNotNull() & (F.size("ws") > 0)))
        n = rows.groupBy("g").agg(F.count("*").alias("n"))
        found = counted_pairs(rows.filter("known").select("g", "ws"), n, num, den)
    out = n.join(found, "g", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    return out.select(F.col("g").alias(group), "n", "n_pairs", F.try_divide(F.col("n_pairs") * 2.0, F.col("n") * (F.col("n") - 1)).alias("rate"))
