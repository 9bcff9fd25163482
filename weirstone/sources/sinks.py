"""Writers: tables, single CSV files, partitioned months with a latest copy, appends that skip known keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.operators.publish import read_if_there


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def one_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for small results only, since one task writes it."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def by_month(df: DataFrame, path: str, month: str = "month") -> None:
    """A folder for each month; months in ``df`` are replaced, others stay."""
    df.repartition(month).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def latest_month(df: DataFrame, path: str, month: str = "month") -> None:
    """A copy of the greatest month."""
    last = df.agg(F.max(month).alias(month))
    df.join(F.broadcast(last), month, "left_semi").write.mode("overwrite").parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the table doesn't have yet, one for each key."""
    fresh = df.dropDuplicates(keys)
    if (old := read_if_there(df.sparkSession, path)) is not None:
        fresh = fresh.join(old.select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)


def documents(df: DataFrame, path: str, key: str, fields: list[str]) -> None:
    """One JSON text for each row, with its key."""
    df.select(key, F.to_json(F.struct(*fields)).alias("document")).write.mode("overwrite").parquet(path)
