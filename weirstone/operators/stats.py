"""Statistics over ranks, histograms and densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstone.functions import metrics as M
from weirstone.operators import ranks


def auc(df: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """(auc, n_pos, n_neg): area under the ROC curve by the rank sum, ties at half."""
    r = ranks.ranked(df.select(key, score), key, [score]).select(key, ranks.average_rank().alias("_r"))
    j = df.select(key, label).join(r, key)
    pos = F.col(label) == 1
    a = j.agg(F.sum(F.when(pos, F.col("_r"))).alias("s"), F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"))
    u = F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return a.select(F.try_divide(u, (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"), "n_pos", "n_neg")


def spearman(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(rho, n) of the rows with both values."""
    both = df.select(key, a, b).dropna()
    r = ranks.ranked(both, key, [a, b]).groupBy(key).agg(*[F.max(F.when(F.col("s") == i, ranks.average_rank())).alias(f"r{i}") for i in (0, 1)])
    return r.agg(M.pearson("r0", "r1").alias("rho"), F.count("*").alias("n"))


def mann_whitney(df: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """(u, z) of group 1 against the others, with the tie correction left out of z."""
    a = auc(df, key, group, value)
    n1, n2 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    u = F.col("auc") * n1 * n2
    return a.select(u.alias("u"), F.try_divide(u - n1 * n2 / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)).alias("z"))


def kruskal(df: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """(h, groups): the Kruskal-Wallis statistic without tie correction."""
    r = ranks.ranked(df.select(key, value), key, [value]).select(key, ranks.average_rank().alias("r"), "n")
    g = df.select(key, group).join(r, key).groupBy(group).agg((F.sum("r") * F.sum("r") / F.count("*")).alias("q"), F.max("n").cast("double").alias("n"))
    n = F.max("n")
    return g.agg((12 / (n * (n + 1)) * F.sum("q") - 3 * (n + 1)).alias("h"), F.count("*").alias("groups"))


def clipped_histogram(df: DataFrame, value: str, bins: int = 28, low: float = 0.01, high: float = 0.99, shade: str | None = None, least: int = 20) -> DataFrame:
    """(bin, n[, mean]) over equal bins between two percentiles, the last bin closed; values beyond stand in the outer bins. A bin's mean of ``shade`` is null below ``least`` rows."""
    v = df.filter(F.col(value).isNotNull())
    ends = ranks.quantile_row(v, value, {"lo": low, "hi": high})
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col(value) - F.col("lo")) / width), F.lit(0)))).cast("int")
    g = v.join(F.broadcast(ends)).withColumn("bin", at).groupBy("bin")
    return g.agg(F.count("*").alias("n"), *([F.when(F.count(shade) >= least, F.avg(shade)).alias("mean")] if shade else []))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 24) -> DataFrame:
    """(bx, by, n) over equal bins of both ranges."""
    v = df.select(x, y).dropna()
    ends = v.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in (x, y) for f in (F.min, F.max)])
    at = lambda c: F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col(c) - F.col(f"min_{c}")) / F.nullif((F.col(f"max_{c}") - F.col(f"min_{c}")) / bins, F.lit(0.0))), F.lit(0))).cast("int")
    return v.join(F.broadcast(ends)).groupBy(at(x).alias("bx"), at(y).alias("by")).agg(F.count("*").alias("n"))


def point_masses(df: DataFrame, value: str, share: float = 0.01, most: int = 8, total: float = 0.5) -> DataFrame:
    """(v, n, share): the most frequent values that each hold ``share`` of the rows, at most ``most``, while they hold no more than ``total`` together."""
    k = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    all_ = k.agg(F.sum("n").alias("all"))
    top = k.join(F.broadcast(all_)).withColumn("share", F.col("n") / F.col("all")).filter(F.col("share") >= share).orderBy(F.desc("n"), "v").limit(most)
    upto = F.sum("share").over(Window.orderBy(F.desc("n"), "v").rowsBetween(Window.unboundedPreceding, 0))  # at most ``most`` rows
    return top.withColumn("upto", upto).filter(F.col("upto") <= total).select("v", "n", "share")


def kernel_density(df: DataFrame, value: str, points: int = 50) -> DataFrame:
    """(x, density): Gaussian kernels of Scott's width on an even grid; equal values are one weighted kernel."""
    k = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("w"))
    m = df.filter(F.col(value).isNotNull()).agg(F.count("*").cast("double").alias("n"), F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.stddev_samp(value).alias("sd"))
    grid = m.filter("hi > lo").select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1))).alias("x"))
    h = F.col("sd") * F.pow("n", F.lit(-0.2))
    z = (F.col("x") - F.col("v")) / h
    j = k.join(F.broadcast(grid))  # a grid of ``points`` rows
    return j.groupBy("x").agg((F.sum(F.col("w") * F.exp(-z * z / 2)) / F.max(F.col("n") * h * 2.5066282746310002)).alias("density"))


def benjamini_hochberg(df: DataFrame, key: str, p: str, level: float = 0.05) -> DataFrame:
    """(key, p, rejected) under a false discovery rate."""
    r = ranks.ranked(df, key, [p]).select(key, F.col("v").alias("_p"), (F.col("lower") + F.col("c")).alias("_i"), F.col("n").alias("_n"))
    limit = r.filter(F.col("_p") <= F.col("_i") / F.col("_n") * level).agg(F.max("_p").alias("_cut"))
    return r.join(F.broadcast(limit)).select(key, F.col("_p").alias("p"), F.coalesce(F.col("_p") <= F.col("_cut"), F.lit(False)).alias("rejected"))


def chronological_split(df: DataFrame, ts: str, train: float = 0.6, purge: float = 0.1) -> DataFrame:
    """Adds ``part``: train, purge or test by day, cut where the days reach the shares of all days."""
    day = df.withColumn("_day", F.floor(F.col(ts) / 86400))
    days = day.select("_day").distinct()
    w = Window.orderBy("_day")  # one row a day
    parts = days.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy())})
    part = F.when(F.col("_i") <= train * F.col("_n"), "train").when(F.col("_i") <= (train + purge) * F.col("_n"), "purge").otherwise("test")
    return day.join(parts.select("_day", part.alias("part")), "_day").drop("_day")


def hash_order(key: str, seed: int = 42) -> Column:
    """A text that orders rows at random, the same wherever it is computed: the MD5 digest of the seed and the key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def hash_number(key: str, seed: int = 42) -> Column:
    """An integer of 32 random bits of the key."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("bigint")


def hash_sample(df: DataFrame, key: str, n: int, strata: list[str] | None = None, seed: int = 42) -> DataFrame:
    """``n`` rows, or ``n`` of each stratum, by a hash of the key: the same ones whatever the order or layout.

    Only the best ``n`` of each task are sorted together (a limit over an order, or a limit per group), so a large stratum sends ``n`` rows a task.
    """
    if not strata:
        return df.orderBy(hash_order(key, seed), key).limit(n)
    rn = F.row_number().over(Window.partitionBy(*strata).orderBy(hash_order(key, seed), key))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` from 0 to k - 1 by a hash of the key, so a group stays together."""
    return df.withColumn("fold", (hash_number(key, seed) % k).cast("int"))


def three_parts(df: DataFrame, key: str, strata: list[str], seed: int = 42) -> DataFrame:
    """Adds ``part``, 1 to 3: thirds of each stratum in hash order; the last one takes what is left over."""
    order = Window.partitionBy(*strata).orderBy(hash_order(key, seed), key)
    third = F.floor(F.count("*").over(Window.partitionBy(*strata)) / 3)
    rn = F.row_number().over(order)
    return df.withColumns({"_rn": rn, "_t": third}).withColumn("part", F.when(F.col("_rn") <= F.col("_t"), 1).when(F.col("_rn") <= 2 * F.col("_t"), 2).otherwise(3)).drop("_rn", "_t")


def disjoint_sides(pairs: DataFrame, a: str, b: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """Adds ``side`` (train or test) to pairs both of whose members are on one side; pairs across the sides are dropped."""
    train = lambda c: hash_number(c, seed) < int(share * 2**32)
    return pairs.filter(train(a) == train(b)).withColumn("side", F.when(train(a), "train").otherwise("test"))


def summary(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, n, least, p10, median, p90, most, mean)."""
    at = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = df.groupBy(*groups).agg(F.count(value).alias("n"), F.min(value).alias("least"), at.alias("_q"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    return g.select(*groups, "n", "least", *[F.col("_q")[i].alias(x) for i, x in enumerate(("p10", "median", "p90"))], "most", "mean")


def rank_correlations(df: DataFrame, key: str, cols: list[str], least: int = 100) -> DataFrame:
    """(a, b, rho, n) of every two columns over the rows that have both, ranked anew for each pair; 0 for fewer than ``least`` rows or no spread.

    All pairs are ranked in one pass: each is two series of its own.
    """
    two = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    name = lambda k, x: f"v{k}_{x}"
    both = lambda i, j: F.col(cols[i]).isNotNull() & F.col(cols[j]).isNotNull()
    wide = df.select(key, *[F.when(both(i, j), F.col(cols[(i, j)[x]]).cast("double")).alias(name(k, x)) for k, (i, j) in enumerate(two) for x in (0, 1)])
    r = ranks.ranked(wide, key, [name(k, x) for k in range(len(two)) for x in (0, 1)])
    r = r.select(key, F.floor(F.col("s") / 2).alias("k"), (F.col("s") % 2).alias("x"), ranks.average_rank().alias("r"))
    p = r.groupBy(key, "k").agg(*[F.max(F.when(F.col("x") == i, F.col("r"))).alias(f"r{i}") for i in (0, 1)])
    c = p.groupBy("k").agg(M.pearson("r0", "r1").alias("rho"), F.count("*").alias("n"))
    at = lambda x: F.element_at(F.array(*[F.lit(cols[t[x]]) for t in two]), F.col("k").cast("int") + 1)
    return c.select(at(0).alias("a"), at(1).alias("b"), F.when(F.col("n") >= least, F.coalesce("rho", F.lit(0.0))).otherwise(0.0).alias("rho"), "n")


def tie_term(df: DataFrame, value: str) -> DataFrame:
    """(n, ties): the number of values and the sum of t^3 - t over groups of t equal ones, for tie corrections."""
    k = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").cast("double").alias("t"))
    return k.agg(F.sum("t").alias("n"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """(f, groups, n): one-way analysis of variance."""
    g = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("w"))
    t = g.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum("w").alias("w"))
    between = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("groups") - 1)
    return t.select(F.try_divide(between, F.col("w") / (F.col("n") - F.col("groups"))).alias("f"), "groups", F.col("n").cast("bigint").alias("n"))


def density_2d(df: DataFrame, x: str, y: str, points: int = 20) -> DataFrame:
    """(gx, gy, density): a product of Gaussian kernels of Scott's width on an even grid; equal pairs are one weighted kernel, and the grid is a parameter."""
    v = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    k = v.groupBy("x", "y").agg(F.count("*").alias("w"))
    m = v.agg(F.count("*").cast("double").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max, F.stddev_samp)])
    line = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col(f"min_{c}") + (F.col(f"max_{c}") - F.col(f"min_{c}")) * i / (points - 1)))
    grid = m.select("*", line("x").alias("gx")).select("*", line("y").alias("gy"))
    h = lambda c: F.col(f"stddev_samp_{c}") * F.pow("n", F.lit(-1 / 6))
    z = lambda c: (F.col(f"g{c}") - F.col(c)) / h(c)
    j = k.join(F.broadcast(grid))  # points squared rows
    return j.groupBy("gx", "gy").agg((F.sum(F.col("w") * F.exp(-(z("x") * z("x") + z("y") * z("y")) / 2)) / F.max(F.col("n") * h("x") * h("y") * 6.283185307179586)).alias("density"))
