"""The event roll-ups over streams. Each equals its batch form once the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; the session's zone is taken for times without one."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def daily_stream(events: DataFrame, ts: str, kind: str, late: str = "1 day") -> DataFrame:
    """(day, kind, n) in tumbling days; events later than `late` are left out."""
    counted = _timed(events, ts).withWatermark(ts, late).groupBy(F.window(ts, "1 day"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.to_date("window.start").alias("day"), kind, "n")


def weekly_stream(events: DataFrame, ts: str, kind: str, late: str = "1 day") -> DataFrame:
    """(starts, kind, n) in weeks from Monday: the epoch was a Thursday."""
    counted = _timed(events, ts).withWatermark(ts, late).groupBy(F.window(ts, "7 days", startTime="4 days"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.to_date("window.start").alias("starts"), kind, "n")


def first_seen(events: DataFrame, ts: str, content: str, late: str = "1 day") -> DataFrame:
    """Each content once within the watermark's delay, by its hash."""
    return _timed(events, ts).withColumn("checksum", F.sha2(content, 256)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["checksum"])


def upsert_into(path: str, keys: list[str], order: str):
    """A function for `foreachBatch` that keeps the latest row by `order` of each key in the Parquet table at `path`.

    Versions are folders named by batch; readers take the newest one that is complete, and a batch that is run again
    writes its own folder anew.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if not number else batch.unionByName(spark.read.parquet(f"{path}/version={number - 1}").drop("version"))
        columns = [c for c in rows.columns if c not in keys]
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*keys, "r.*")
        latest.write.mode("overwrite").parquet(f"{path}/version={number}")

    return merge
