"""Items that appear together: pair counts and association scores by basket collapsing.

Identical de-duplicated baskets are collapsed into one weighted basket, pairs are enumerated once for each distinct
basket, and the weights are summed. What keeps it whole and spread at scale:

* An item in fewer than ``min_n`` baskets can't be in a pair of ``min_n``, and one in more than t / ``min_lift`` baskets can't reach
  that lift with anyone (n <= min(d1, d2)). Both are dropped before baskets are built; it changes no result.
* A basket of more than ``hot`` remaining items is never collected or enumerated. For a pair that also shares a smaller basket, the shared hot
  baskets are counted by joining its items' rows of hot baskets. A pair that only shares hot ones has to share ``min_n`` of them, so it shares one outside
  the ``min_n`` - 1 largest of each item; those candidates come from a join in blocks of ``hot`` items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirstone.session import written


def cooccurrence(df: DataFrame, item: str, basket: str, scope: str, min_n: int = 1, min_lift: float = 0.0, hot: int = 512) -> DataFrame:
    """Pairs (``scope``, a1, a2, n, d1, d2, t, lift, conviction), a1 < a2, of items that share n >= ``min_n`` baskets of one scope.

    d1 and d2 are the items' distinct baskets, t all distinct baskets of the scope, lift is n t / (d1 d2), conviction of a1 to a2 is
    (1 - d2 / t) / (1 - n / d1), null where n = d1. Pairs below ``min_lift`` are left out. Repeated rows count once, rows with a null
    in one of the three columns not at all, other columns aren't read. An empty table gives no rows.
    """
    m = df.select(F.col(scope).alias("s"), F.col(basket).alias("p"), F.col(item).alias("x")).dropna().distinct()
    total = m.select("s", "p").distinct().groupBy("s").agg(F.count("*").alias("t"))
    degree = m.groupBy("s", "x").agg(F.count("*").alias("d")).join(total, "s")
    degree = degree.filter((F.col("d") >= min_n) & (F.col("d") * min_lift <= F.col("t")))
    act = written(m.join(degree, ["s", "x"]))  # read by every branch below

    size = act.groupBy("s", "p").agg(F.count("*").alias("k"))
    big = size.filter(F.col("k") > hot)
    hots = act.join(big, ["s", "p"])
    marks = hots.groupBy("s", "x").agg(F.count("*").alias("h"))

    cold = act.join(big, ["s", "p"], "left_anti").join(marks, ["s", "x"], "left").select("s", "t", "p", F.struct("x", "d", F.coalesce("h", F.lit(0)).alias("h")).alias("i"))
    weighted = cold.groupBy("s", "t", "p").agg(F.sort_array(F.collect_list("i")).alias("items")).filter(F.size("items") > 1).groupBy("s", "t", "items").agg(F.count("*").alias("w"))
    first = weighted.select("s", "t", "w", "items", F.posexplode("items").alias("at", "a"))
    pairs = first.select("s", "t", "w", "a", F.explode(F.slice("items", F.col("at") + 2, hot)).alias("b"))
    small = pairs.groupBy("s", "t", F.col("a.x").alias("a1"), F.col("b.x").alias("a2"), F.col("a.d").alias("d1"), F.col("b.d").alias("d2"), (F.least("a.h", "b.h") > 0).alias("both")).agg(F.sum("w").alias("n"))

    # pairs that may meet in hot baskets only
    largest = F.row_number().over(Window.partitionBy("s", "x").orderBy(F.desc("k"), "p"))
    often = hots.withColumn("largest", largest).filter(F.col("largest") >= min_n)
    blocks = F.ceil(F.col("k") / hot).cast("int")
    own = F.pmod(F.xxhash64("x"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    left = often.select("s", "t", "p", F.col("x").alias("a1"), F.col("d").alias("d1"), own.alias("i"), every.alias("j"))
    right = often.select("s", "p", F.col("x").alias("a2"), F.col("d").alias("d2"), every.alias("i"), own.alias("j"))
    met = left.join(right, ["s", "p", "i", "j"]).filter("a1 < a2").select("s", "t", "a1", "a2", "d1", "d2").distinct()

    plain = small.filter("NOT both").select("s", "t", "a1", "a2", "d1", "d2", "n")
    mixed = small.filter("both").drop("both").unionByName(met.withColumn("n", F.lit(0).cast("bigint")))
    mixed = mixed.groupBy("s", "t", "a1", "a2", "d1", "d2").agg(F.sum("n").alias("n"))
    # the hot baskets that a pair shares, counted row by row: no list of an item's baskets is ever built
    shared = mixed.select("s", "a1", "a2").join(hots.select("s", F.col("x").alias("a1"), "p"), ["s", "a1"]).join(hots.select("s", F.col("x").alias("a2"), "p"), ["s", "a2", "p"])
    shared = shared.groupBy("s", "a1", "a2").agg(F.count("*").alias("m"))
    mixed = mixed.join(shared, ["s", "a1", "a2"], "left").withColumn("n", F.col("n") + F.coalesce("m", F.lit(0)))
    out = plain.unionByName(mixed.select(plain.columns)).filter((F.col("n") >= min_n) & (F.col("n") * F.col("t") >= F.col("d1") * F.col("d2") * min_lift))
    lift = F.col("n").cast("double") * F.col("t") / (F.col("d1").cast("double") * F.col("d2"))
    conviction = F.try_divide(1 - F.col("d2") / F.col("t"), 1 - F.col("n") / F.col("d1"))
    return out.select(F.col("s").alias(scope), "a1", "a2", "n", "d1", "d2", "t", lift.alias("lift"), conviction.alias("conviction"))
