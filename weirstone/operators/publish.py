"""Append-only publishing: frozen bands, months written once, history from what was published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None if nothing is there. A table that is there and can't be read is an error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.parquet(path) if there else None


def frozen_bands(spark: SparkSession, path: str, cells: DataFrame, value: str, version: str) -> DataFrame:
    """Bands by role at the 50th, 80th and 95th percentile, computed once and read ever after.

    With fewer than 20 cells they are 20, 40 and 70. n counts cells with a value.
    """
    if (old := read_if_there(spark, path)) is not None:
        return old
    few = F.count(value) < 20
    at = lambda q, x: F.when(few, float(x)).otherwise(F.percentile(value, F.lit(q)))
    b = cells.groupBy("role").agg(F.count(value).alias("n"), at(0.5, 20).alias("moderate"), at(0.8, 40).alias("high"), at(0.95, 70).alias("critical"), F.min("month").alias("since"), F.max("month").alias("until"))
    b.withColumn("version", F.lit(version)).write.mode("error").parquet(path)
    return spark.read.parquet(path)


def severity(cells: DataFrame, bands: DataFrame, value: str) -> DataFrame:
    """Adds ``severity`` by each role's bands; null for a null value."""
    v = F.col(value)
    b = F.broadcast(bands.select("role", "moderate", "high", "critical"))  # one row a role
    s = F.when(v >= F.col("critical"), "critical").when(v >= F.col("high"), "high").when(v >= F.col("moderate"), "moderate").when(v.isNotNull(), "low")
    return cells.join(b, "role", "left").withColumn("severity", s).drop("moderate", "high", "critical")


def role_blocks(cells: DataFrame, value: str) -> DataFrame:
    """Cells without a value count no accounts and have no severity."""
    none = F.col(value).isNull()
    return cells.withColumns({"n": F.when(none, 0).otherwise(F.col("n")), "severity": F.when(~none, F.col("severity"))})


def publish(spark: SparkSession, path: str, cells: DataFrame, series: str, on: str) -> int:
    """Appends the months of ``cells`` that the series hasn't published; gives their number. Published months are never rewritten."""
    fresh = cells.filter(F.col("month").isNotNull())
    if (old := read_if_there(spark, path)) is not None:
        fresh = fresh.join(F.broadcast(old.filter(F.col("series") == series).select("month").distinct()), "month", "left_anti")  # one row a month
    months = fresh.select("month").distinct().count()
    if months:
        fresh.withColumns({"series": F.lit(series), "first_published": F.lit(on)}).write.mode("append").parquet(path)
    return months


def manifest(published: DataFrame) -> DataFrame:
    return published.groupBy("series", "month").agg(F.min("first_published").alias("first_published"), F.count("*").alias("cells"))


def month_documents(published: DataFrame) -> DataFrame:
    """(series, month, document): a month as one JSON text, community by community and role by role in order."""
    cell = F.struct("n", "n_scored", "coverage_pct", "pct_high_risk", "mean_score", "severity")
    subs = published.groupBy("series", "month", "sub").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", cell)))).alias("roles"))  # three roles
    doc = subs.groupBy("series", "month").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sub", F.to_json("roles"))))).alias("subreddits"))  # a catalogue of communities
    return doc.select("series", "month", F.to_json(F.struct("month", F.col("series").alias("series_version"), "subreddits")).alias("document"))


def changes(published: DataFrame, value: str) -> DataFrame:
    """Each cell's change to the published month before and three before."""
    w = Window.partitionBy("series", "role", "sub").orderBy("month")
    v: Column = F.col(value)
    return published.withColumns({"delta": v - F.lag(v).over(w), "delta3": v - F.lag(v, 3).over(w)})


def inconsistencies(published: DataFrame, bands: DataFrame, value: str) -> DataFrame:
    """Published cells that break a rule: severity against the bands, rates outside 0 to 100, repeated cells, scored over all."""
    again = severity(published.drop("severity"), bands, value).select("series", "month", "sub", "role", F.col("severity").alias("due"))
    key = ["series", "month", "sub", "role"]
    j = published.join(again.distinct(), key)
    why = F.when(~F.col("severity").eqNullSafe(F.col("due")), "severity").when(~F.col(value).between(0, 100), "range").when(F.col(value).isNotNull() & (F.col("n_scored") > F.col("n")), "scored")
    one = j.select(*key, why.alias("why")).filter("why IS NOT NULL")
    two = published.groupBy(*key).agg(F.count("*").alias("k")).filter("k > 1").select(*key, F.lit("repeated").alias("why"))
    return one.unionByName(two)


def repair(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of each key in ``new`` replaced by those of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def narrative(published: DataFrame, value: str) -> DataFrame:
    """(month, headline): the mean of a month and its change, as a sentence."""
    m = published.filter("role = 'combined'").groupBy("month").agg(F.avg(value).alias("v"), F.count(value).alias("n"))
    delta = F.col("v") - F.lag("v").over(Window.orderBy("month"))  # one row a month
    text = F.when(F.col("delta").isNull(), F.format_string("%.1f %% on average over %d communities", "v", "n")).otherwise(F.format_string("%.1f %% on average over %d communities, %+.1f points", "v", "n", "delta"))
    return m.withColumn("delta", delta).select("month", text.alias("headline"))


