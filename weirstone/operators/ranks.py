"""Ranks over a whole table without a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstone.session import written

#: Distinct values in a range of the sort.
RANGE = 500_000


def ranges_for(n: int) -> int:
    """The number of ranges for ``n`` distinct values, so that a range's size doesn't grow with the data."""
    return max(8, -(-n // RANGE))


def places(values: DataFrame, ranges: int | None = None) -> DataFrame:
    """(s, v, c, lower, n) of rows (s, v): each distinct value of series s with its rows, the rows below it and all rows.

    Equal values are collapsed before they are sorted, and the sorting is by range; the ranges' totals are one row each.
    """
    distinct = written(values.groupBy("s", "v").agg(F.count("*").alias("c")))
    ordered = written(distinct.repartitionByRange(ranges or ranges_for(distinct.count()), "s", "v").select("*", F.spark_partition_id().alias("part")))
    totals = ordered.groupBy("s", "part").agg(F.sum("c").alias("k"))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("s", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"), F.sum("k").over(Window.partitionBy("s")).alias("n"))
    inside = Window.partitionBy("s", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ordered.withColumn("inner", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    return ranked.join(totals, ["s", "part"]).select("s", "v", "c", (F.col("base") + F.col("inner")).alias("lower"), "n")


def ranked(df: DataFrame, key: str, cols: list[str], ranges: int | None = None) -> DataFrame:
    """(key, s, v, c, lower, n) for every row and column, s being the column's number. Nulls are no values."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)]))
    long = df.select(F.col(key), each.alias("e")).select(key, "e.s", "e.v").filter(F.col("v").isNotNull())
    return long.join(places(long.select("s", "v"), ranges), ["s", "v"])


def percent_rank() -> Column:
    """(rank - 1) / (n - 1), 0 for a single row."""
    return F.coalesce(F.try_divide(F.col("lower").cast("double"), F.col("n") - 1), F.lit(0.0))


def average_rank() -> Column:
    """Rank from 1 with ties at their mean."""
    return F.col("lower") + (F.col("c") + 1) / 2


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(s, q, v): exact interpolated quantiles of the columns, s being the column's number. Nulls are no values; a column without any has no rows.

    The values are ranked by :func:`places`, so none of it needs all distinct values in one task, as a percentile aggregate does; the two values around each
    rank are picked out of the ranked table.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    p = places(df.select(each.alias("e")).select("e.s", "e.v").filter(F.col("v").isNotNull()))
    ask = F.explode(F.array(*[F.lit(float(q)) for q in shares]))
    p = p.select("s", "v", "c", "lower", "n", ask.alias("q")).withColumn("at", (F.col("n") - 1) * F.col("q"))
    holds = lambda r: F.when((F.col("lower") <= r) & (r < F.col("lower") + F.col("c")), F.col("v"))
    near = p.filter((F.col("lower") <= F.ceil("at")) & (F.floor("at") < F.col("lower") + F.col("c")))
    ends = near.groupBy("s", "q").agg(F.max(holds(F.floor("at"))).alias("a"), F.max(holds(F.ceil("at"))).alias("b"), F.max("at").alias("at"))
    part = F.col("at") - F.floor("at")
    return ends.select("s", "q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part).alias("v"))


def quantile_row(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row with a column for each share, named by the keys."""
    q = quantiles(df, [column], list(shares.values()))
    return q.agg(*[F.max(F.when(F.col("q") == x, F.col("v"))).alias(name) for name, x in shares.items()])


def medians(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """One row with the median of each column, named prefix and column."""
    q = quantiles(df, columns, [0.5])
    return q.agg(*[F.max(F.when(F.col("s") == i, F.col("v"))).alias(f"{prefix}{c}") for i, c in enumerate(columns)])
