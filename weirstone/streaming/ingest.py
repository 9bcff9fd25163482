"""Incremental ingest: de-duplication, monthly counts once they settle, append-only publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(stream: DataFrame, key: str, ts: str, lateness: str = "5 days") -> DataFrame:
    """The first row of each key; keys are remembered for ``lateness``."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], length: str = "1 day", lateness: str = "5 days") -> DataFrame:
    """(start, keys, n) of each window once no event of it can come any more."""
    w = F.window(ts, length)
    return stream.withWatermark(ts, lateness).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def month_of(ts: str) -> F.Column:
    """Calendar months aren't windows of one length; group on this."""
    return F.date_format(ts, "yyyy-MM")


def append_once(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Appends rows whose keys aren't in the table yet. A batch that runs again after a failure adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        from weirstone.operators.publish import read_if_there

        fresh = batch.dropDuplicates(keys)
        if (old := read_if_there(batch.sparkSession, path)) is not None:
            fresh = fresh.join(old.select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def land(stream: DataFrame, path: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Writes a stream as Parquet, all that is there now, exactly once."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (w.partitionBy(partition) if partition else w).start()
