"""One ranking from several scores: outranking net flows on percentiles.

Each score is replaced by the item's place in it (the share of known values that are lower), which no outlier and no scale can stretch. On the
places a preference function compares every two items: 0 up to a difference of ``indifference``, 1 from ``strict`` on, linear
between. An item's flow in a score is the mean preference over all others minus the mean preference of all others over it, its net flow
the weighted mean over its known scores.

No pair is formed. With the places sorted, the sums over all others are prefix counts and prefix sums read at four shifted positions. The
sorted order is cut into ranges: sums inside each range, plus the totals of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirstone.operators.ranks import places, ranges_for
from weirstone.session import written


def flows(placed: DataFrame, indifference: float, strict: float, ranges: int) -> DataFrame:
    """(s, v, c, place, flow) of the distinct values of :func:`weirstone.operators.ranks.places`."""
    p = placed.select("s", "v", "c", "n", (F.col("lower") / F.col("n")).alias("place"))
    none, far = F.lit(0.0), F.lit(None).cast("double")
    data = p.select("s", "v", "n", F.col("place").alias("at"), F.lit(0).alias("kind"), F.col("c").cast("double").alias("c"), (F.col("c") * F.col("place")).alias("cx"), far.alias("place"))
    shifts = {1: -strict, 2: -indifference, 3: indifference, 4: strict}
    asks = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("place") + d).alias("at")) for k, d in shifts.items()]))
    query = p.select("s", "v", "n", "place", asks.alias("a")).select("s", "v", "n", "a.at", "a.kind", none.alias("c"), none.alias("cx"), "place")
    both = data.unionByName(query).withColumn("range", F.greatest(F.lit(0), F.least(F.lit(ranges), F.floor(F.col("at") * ranges))).cast("int"))
    totals = both.filter("kind = 0").groupBy("s", "range").agg(F.sum("c").alias("tc"), F.sum("cx").alias("tx"))
    grid = both.select("s", "range").distinct().join(totals, ["s", "range"], "left")
    before = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most ranges + 1 rows
    base = grid.select("s", "range", F.coalesce(F.sum("tc").over(before), none).alias("bc"), F.coalesce(F.sum("tx").over(before), none).alias("bx"))
    upto = Window.partitionBy("s", "range").orderBy("at", "kind", "v").rowsBetween(Window.unboundedPreceding, 0)
    sums = both.withColumns({"ic": F.sum("c").over(upto), "ix": F.sum("cx").over(upto)}).filter("kind > 0").join(base, ["s", "range"])
    sums = sums.select("s", "v", "n", "place", "kind", (F.col("ic") + F.col("bc")).alias("C"), (F.col("ix") + F.col("bx")).alias("X"))
    get = lambda k, x: F.max(F.when(F.col("kind") == k, F.col(x)))
    wide = sums.groupBy("s", "v", "n", "place").agg(*[get(k, x).alias(f"{x}{k}") for k in shifts for x in ("C", "X")])
    band = strict - indifference
    c, x = (lambda k: F.col(f"C{k}")), (lambda k: F.col(f"X{k}"))
    won = c(1) + ((F.col("place") - indifference) * (c(2) - c(1)) - (x(2) - x(1))) / band
    lost = (F.col("n") - c(4)) + ((x(4) - x(3)) - (F.col("place") + indifference) * (c(4) - c(3))) / band
    return wide.select("s", "v", "place", ((won - lost) / F.greatest(F.col("n") - 1, F.lit(1))).alias("flow"))


def net_flow(df: DataFrame, key: str, scores: dict[str, float], indifference: float = 0.05, strict: float = 0.5, ranges: int | None = None) -> DataFrame:
    """(``key``, net_flow, n_scores, and place_i, flow_i and least_i of the i-th score) of every item with a known score.

    ``scores`` gives each column's weight; ``strict`` must be over ``indifference``. A value is known if not null, NaN or infinite; an item's flow is
    the weighted mean over its known scores, and an item without any has no row. least_i is the least difference of flow and place that occurs in score i,
    so that place + least_i is a lower bound of the flow. ``key`` must be unique; rows where it is null are left out. Ties share a place. An empty table gives no rows.
    """
    names = list(scores)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(c).cast("double").alias("v")) for i, c in enumerate(names)]))
    long = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), each.alias("e")).select("k", "e.s", (F.col("e.v") + 0.0).alias("v"))
    long = long.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))
    placed = written(places(long.select("s", "v"), ranges))
    value = written(flows(placed, indifference, strict, ranges or ranges_for(placed.count())))
    least = value.groupBy("s").agg(F.min(F.col("flow") - F.col("place")).alias("least"))  # one row a score
    # a value held by a third of the rows makes a skewed join, which adaptive execution splits; the other side has one row for a value
    found = long.join(value.join(F.broadcast(least), "s"), ["s", "v"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in scores.values()]), F.col("s") + 1)
    pick = lambda x, i: F.max(F.when(F.col("s") == i, F.col(x)))
    out = found.groupBy("k").agg(
        (F.sum(F.col("flow") * weight) / F.sum(weight)).alias("net_flow"), F.count("*").alias("n_scores"),
        *[pick(x, i).alias(f"{x}_{i}") for i in range(len(names)) for x in ("place", "flow", "least")],
    )
    return out.withColumnRenamed("k", key)
