"""Screening of features: strata, boundary rules, curves, trends, positive-unlabelled estimates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirstone.operators import ranks
from weirstone.session import written


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """All months from ``first`` to ``last`` as 'YYYY-MM'."""
    at = lambda m: F.to_date(F.lit(f"{m}-01"))
    days = spark.range(1).select(F.explode(F.sequence(at(first), at(last), F.expr("INTERVAL 1 MONTH"))).alias("d"))
    return days.select(F.date_format("d", "yyyy-MM").alias("month"))


def strata(df: DataFrame, value: str, k: int = 10, name: str = "stratum") -> DataFrame:
    """Adds the value's quantile stratum from 0; equal values stay together, and equal edges are merged."""
    q = ranks.quantiles(df, [value], [i / k for i in range(1, k)])
    edges = q.agg(F.array_sort(F.collect_set("v")).alias("_e"))  # k - 1 values
    v = F.col(value)
    return df.join(F.broadcast(edges)).withColumn(name, F.when(v.isNotNull(), F.size(F.filter("_e", lambda e: e < v)))).drop("_e")


def equal_strata(df: DataFrame, key: str, value: str, k: int, name: str = "stratum") -> DataFrame:
    """Adds the stratum from 1 to ``k`` of equally many rows in the order of value and key, the first ones larger by one where they don't divide.

    The order is cut into ranges and the ranges' totals are added, so no task sees all rows.
    """
    rows = df.filter(F.col(value).isNotNull())
    part = written(rows.repartitionByRange(ranks.ranges_for(rows.count()), value, key).withColumn("_part", F.spark_partition_id()))
    totals = part.groupBy("_part").agg(F.count("*").alias("_k"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.select("_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_base"), F.sum("_k").over(Window.partitionBy()).alias("_n"))
    at = F.col("_base") + F.row_number().over(Window.partitionBy("_part").orderBy(value, key)) - 1
    j = part.join(F.broadcast(totals), "_part").withColumn("_at", at)
    size, more = F.floor(F.col("_n") / k), F.col("_n") % k
    head = more * (size + 1)
    stratum = F.when(F.col("_at") < head, F.floor(F.col("_at") / (size + 1))).otherwise(more + F.floor(F.try_divide(F.col("_at") - head, size)))
    return j.withColumn(name, (stratum + 1).cast("bigint")).drop("_part", "_base", "_n", "_at")


def hurdles(df: DataFrame, cols: list[str], share: float = 0.25) -> DataFrame:
    """Adds ``c_hurdle`` for each column: whether a value is known and not the most frequent one, where that holds ``share`` of the known values or more; else null."""
    out = df
    for c in cols:
        k = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_k"))
        mode = k.agg(F.max_by(c, F.struct("_k", (-F.col(c)).alias("_m"))).alias("_mode"), (F.max("_k") / F.sum("_k")).alias("_share"))  # one row
        held = F.when(F.col("_share") >= share, F.coalesce(F.col(c) != F.col("_mode"), F.lit(False)))
        out = out.join(F.broadcast(mode)).withColumn(f"{c}_hurdle", held).drop("_mode", "_share")
    return out


def valley(df: DataFrame, value: str, ends: DataFrame, points: int = 50) -> DataFrame:
    """(ratio): the least density on a grid between ``lo`` and ``hi`` of the one-row ``ends``, over the lower of the densities at both."""
    k = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("w"))
    m = df.agg((F.stddev_samp(value) * F.pow(F.count(value).cast("double"), F.lit(-0.2))).alias("h"))
    i = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1))).alias("i", "g")
    grid = ends.join(F.broadcast(m)).select("h", i)
    z = (F.col("g") - F.col("v")) / F.col("h")
    d = k.join(F.broadcast(grid)).groupBy("i").agg(F.sum(F.col("w") * F.exp(-z * z / 2)).alias("d"))  # a grid of ``points`` rows
    at = lambda n: F.max(F.when(F.col("i") == n, F.col("d")))
    return d.agg(F.try_divide(F.min("d"), F.least(at(0), at(points - 1))).alias("ratio"))


def cross_table(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts with 0 where nothing is."""
    return df.groupBy(row).pivot(column, values).count().fillna(0, subset=values)


def boundary_rule(df: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """(step, rule, n): rows left after each further rule (column, '>=' or '<=', limit); a null fails its rule. One pass for all steps."""
    cond: Column = F.lit(True)
    steps = []
    for c, op, limit in rules:
        test = F.col(c) >= limit if op == ">=" else F.col(c) <= limit
        cond = cond & F.coalesce(test, F.lit(False))
        steps.append(F.count_if(cond))
    arr = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(f"{c} {op} {limit:g}").alias("rule"), n.alias("n")) for i, ((c, op, limit), n) in enumerate(zip(rules, steps))])
    return df.agg(arr.alias("a")).select(F.inline("a"))


def curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, tp, fp, pos, neg) at each distinct score, from the highest; by prefix counts within ranges."""
    k = df.select(F.col(label).alias("y"), F.col(score).cast("double").alias("x")).dropna()
    both = k.select(F.lit(0).alias("s"), (-F.col("x")).alias("v")).unionByName(k.filter("y = 1").select(F.lit(1).alias("s"), (-F.col("x")).alias("v")))
    p = ranks.places(both).select("s", "v", (F.col("lower") + F.col("c")).alias("upto"), "n")
    all_, pos = p.filter("s = 0"), p.filter("s = 1").select("v", F.col("upto").alias("tp_at"), F.col("n").alias("pos"))
    j = all_.join(pos, "v", "left")
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    n_pos = p.filter("s = 1").agg(F.max("n").alias("n_pos"))
    j = j.join(F.broadcast(n_pos)).withColumn("tp", F.coalesce(F.max("tp_at").over(w), F.lit(0)))
    return j.select((-F.col("v")).alias("score"), "tp", (F.col("upto") - F.col("tp")).alias("fp"), F.col("n_pos").alias("pos"), (F.col("n") - F.col("n_pos")).alias("neg"))


def average_precision(points: DataFrame) -> DataFrame:
    """(ap, recall_at_1pct) from a :func:`curve`."""
    before = F.coalesce(F.lag("tp").over(Window.orderBy(F.desc("score"))), F.lit(0))
    p = points.withColumn("gain", (F.col("tp") - before) * F.col("tp") / (F.col("tp") + F.col("fp")))
    return p.agg((F.sum("gain") / F.max("pos")).alias("ap"), F.coalesce(F.max(F.when(F.col("fp") <= 0.01 * F.col("neg"), F.col("tp") / F.col("pos"))), F.lit(0.0)).alias("recall_at_1pct"))


def elkan_noto(scored: DataFrame, label: str, score: str, holdout: str) -> DataFrame:
    """(c, naive, corrected, degenerate): positives among the unlabelled. c is the mean score of held-out positives; the corrected share is the mean score divided by it."""
    c = F.avg(F.when((F.col(label) == 1) & F.col(holdout), F.col(score)))
    naive = F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0))
    fixed = F.try_divide(F.avg(score), c)
    return scored.agg(c.alias("c"), naive.alias("naive"), F.least(fixed, F.lit(1.0)).alias("corrected"), F.coalesce(fixed > 1, F.lit(True)).alias("degenerate"))


def rate_ratio(df: DataFrame, group: str, event: str) -> DataFrame:
    """(rate_1, rate_0, ratio) of an event in two groups."""
    at = lambda g: F.avg(F.when(F.col(group) == g, F.when(F.col(event), 1.0).otherwise(0.0)))
    return df.agg(at(1).alias("rate_1"), at(0).alias("rate_0"), F.try_divide(at(1), at(0)).alias("ratio"))


def student_tail(t: float, df: int) -> float:
    """Two-sided tail of Student's t, by the incomplete beta function's continued fraction."""
    if not math.isfinite(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return float(x >= 1)

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def trends(df: DataFrame, groups: list[str], order: str, value: str, level: float = 0.15) -> DataFrame:
    """(groups, n, slope, p, worsening) of each group's values over their order; p from Student's t, computed for each group's few sums."""
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import DoubleType

    x = df.filter(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(Window.partitionBy(*groups).orderBy(order)))
    fit = x.groupBy(*groups).agg(F.count("*").alias("n"), F.regr_slope(value, "_i").alias("slope"), F.regr_r2(value, "_i").alias("_r2"))
    t = F.sqrt(F.try_divide(F.col("_r2") * (F.col("n") - 2), 1 - F.col("_r2")))

    @pandas_udf(DoubleType())
    def tail(t, n):  # noqa: ANN001
        return t.combine(n, lambda a, b: student_tail(a, int(b) - 2) if b > 2 and a == a else None)

    out = fit.withColumn("p", tail(t, "n"))
    return out.select(*groups, "n", "slope", "p", ((F.col("slope") > 0) & F.coalesce(F.col("p") < level, F.lit(False))).alias("worsening"))


def mode_distance(df: DataFrame, group: str, value: str, bins: int = 50, least: int = 30) -> DataFrame:
    """Adds ``vs_mode``: the value less the middle of its group's fullest bin of log1p values; null for groups under ``least``."""
    lv = F.log1p(F.greatest(F.col(value), F.lit(0)))
    g = df.filter(F.col(value).isNotNull()).select(group, lv.alias("_x"))
    ends = g.groupBy(group).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_n")).filter(F.col("_n") >= least)
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("_x") - F.col("_lo"), width))), F.lit(0))
    k = g.join(ends, group).groupBy(group, "_lo", "_hi", at.alias("_b")).agg(F.count("*").alias("_k"))
    mode = k.groupBy(group, "_lo", "_hi").agg(F.max_by("_b", F.struct("_k", (-F.col("_b")).alias("_m"))).alias("_b"))
    mid = mode.select(group, F.expm1(F.col("_lo") + (F.col("_b") + 0.5) * width).alias("_mode"))
    return df.join(mid, group, "left").withColumn("vs_mode", F.col(value) - F.col("_mode")).drop("_mode")
