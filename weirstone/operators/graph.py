"""The account pair graph: shared threads, null model, degrees, arrival gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.functions import metrics as M
from weirstone.session import shuffles_dropped, written


def pair_edges(presence: DataFrame, scope: str, basket: str, item: str, least: int = 2) -> DataFrame:
    """(scope, a1, a2, n, d1, d2, t, z): pairs that share ``least`` baskets, with the hypergeometric z of n.

    Presence is made distinct first, and an item in fewer than ``least`` baskets is left out before the self-join, which it can't pass.
    The join is on the basket; adaptive execution splits large ones.
    """
    m = presence.select(F.col(scope).alias("s"), F.col(basket).alias("p"), F.col(item).alias("x")).dropna().distinct()
    t = m.select("s", "p").distinct().groupBy("s").agg(F.count("*").alias("t"))
    d = m.groupBy("s", "x").agg(F.count("*").alias("d"))
    a = m.join(d.filter(F.col("d") >= least), ["s", "x"])
    j = a.select("s", "p", F.col("x").alias("a1"), F.col("d").alias("d1")).join(a.select("s", "p", F.col("x").alias("a2"), F.col("d").alias("d2")), ["s", "p"]).filter("a1 < a2")
    e = j.groupBy("s", "a1", "a2", "d1", "d2").agg(F.count("*").alias("n")).filter(F.col("n") >= least).join(t, "s")
    _, _, z = M.hypergeometric(F.col("n"), F.col("d1"), F.col("d2"), F.col("t"))
    return e.select(F.col("s").alias(scope), "a1", "a2", "n", "d1", "d2", "t", z.alias("z"))


def degrees(edges: DataFrame) -> DataFrame:
    """(author, degree, strength, hhi) over both directions of every edge."""
    both = edges.select(F.col("a1").alias("author"), F.col("a2").alias("other"), "n").unionByName(edges.select(F.col("a2").alias("author"), F.col("a1").alias("other"), "n"))
    per = both.groupBy("author", "other").agg(F.sum("n").alias("n"))
    return per.groupBy("author").agg(F.count("*").alias("degree"), F.sum("n").alias("strength"), (F.sum((F.col("n") * F.col("n")).cast("double")) / (F.sum("n") * F.sum("n"))).alias("hhi"))


def collapse(edges: DataFrame, scope: str) -> DataFrame:
    """One row for each pair: all shared baskets, and the scope with the greatest z (ties: the last name)."""
    return edges.groupBy("a1", "a2").agg(F.sum("n").alias("n"), F.max_by(scope, F.struct("z", scope)).alias("best"), F.max("z").alias("z"))


def arrival_gaps(c: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a1, a2, shared, median_gap, min_gap): seconds between the first comments of a pair in their shared threads.

    A pair is looked for from the account with fewer threads, so that one in very many threads doesn't give a row for each of them and each of its pairs.
    """
    with shuffles_dropped(c.sparkSession):
        first = written(c.filter("ts IS NOT NULL").groupBy("post_id", "author").agg(F.min("ts").alias("t")))
    n = first.groupBy("author").agg(F.count("*").alias("n"))
    side = lambda k: n.select(F.col("author").alias(f"a{k}"), F.col("n").alias(f"n{k}"))
    fewer = F.col("n1") <= F.col("n2")
    ask = pairs.select("a1", "a2").join(side(1), "a1").join(side(2), "a2").select("a1", "a2", F.when(fewer, F.col("a1")).otherwise(F.col("a2")).alias("x"), F.when(fewer, F.col("a2")).otherwise(F.col("a1")).alias("y"))
    one = ask.join(first.select(F.col("author").alias("x"), "post_id", F.col("t").alias("t1")), "x").select("y", "post_id", "a1", "a2", "t1")
    two = one.join(first.select(F.col("author").alias("y"), "post_id", F.col("t").alias("t2")), ["y", "post_id"])
    gap = F.abs(F.col("t1") - F.col("t2"))
    return two.groupBy("a1", "a2").agg(F.count("*").alias("shared"), F.median(gap).alias("median_gap"), F.min(gap).alias("min_gap"))


def daily_correlation(c: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a1, a2, r): correlation of two accounts' daily counts over all days from the first to the last, from sums alone (absent days are zeros)."""
    day = c.filter("ts IS NOT NULL").select("author", F.floor(F.col("ts") / 86400).alias("day"))
    n = day.groupBy("author", "day").agg(F.count("*").alias("x"))
    total = day.agg((F.max("day") - F.min("day") + 1).alias("days"))
    s = n.groupBy("author").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    side = lambda k: s.select(F.col("author").alias(f"a{k}"), F.col("s").alias(f"s{k}"), F.col("q").alias(f"q{k}"))
    base = pairs.select("a1", "a2").join(side(1), "a1").join(side(2), "a2")
    xy = pairs.select("a1", "a2").join(n.select(F.col("author").alias("a1"), "day", F.col("x").alias("x1")), "a1").join(n.select(F.col("author").alias("a2"), "day", F.col("x").alias("x2")), ["a2", "day"])
    xy = xy.groupBy("a1", "a2").agg(F.sum(F.col("x1") * F.col("x2")).alias("xy"))
    j = base.join(xy, ["a1", "a2"], "left").join(F.broadcast(total))
    d = F.col("days").cast("double")
    num = d * F.coalesce("xy", F.lit(0)) - F.col("s1") * F.col("s2")
    den = F.sqrt((d * F.col("q1") - F.col("s1") * F.col("s1")) * (d * F.col("q2") - F.col("s2") * F.col("s2")))
    return j.select("a1", "a2", F.try_divide(num, den).alias("r"))


def reciprocity(replies: DataFrame, sender: str, receiver: str) -> DataFrame:
    """(edges, returned, reciprocity) over distinct directed edges without loops."""
    e = replies.select(F.col(sender).alias("a"), F.col(receiver).alias("b")).dropna().filter("a <> b").distinct()
    back = e.select(F.col("a").alias("b"), F.col("b").alias("a"), F.lit(1).alias("hit"))
    return e.join(back, ["a", "b"], "left").agg(F.count("*").alias("edges"), F.count("hit").alias("returned"), F.try_divide(F.count("hit"), F.count("*")).alias("reciprocity"))
