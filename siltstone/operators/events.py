"""The event log: roll-ups by day and ISO week, and what is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def week_key(ts: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("yearofweek"), ts), F.extract(F.lit("week"), ts))


def daily(events: DataFrame, ts: str, kind: str) -> DataFrame:
    return events.groupBy(F.to_date(ts).alias("day"), kind).agg(F.count("*").alias("n"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))


def weekly(events: DataFrame, ts: str, kind: str) -> DataFrame:
    return events.groupBy(week_key(F.col(ts)).alias("week"), F.to_date(F.date_trunc("week", ts)).alias("starts"), kind).agg(F.count("*").alias("n"))


def commands_touched(events: DataFrame, ts: str, kind: str) -> DataFrame:
    """(day, commands): each day's distinct kinds in order, joined by commas."""
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("commands"))


def due(state: DataFrame, as_of: Column) -> DataFrame:
    """Per scope (scope, exists, captured_key, pending_key): whether it is due or pending on a day or in a week."""
    key = F.when(F.col("scope") == "weekly", week_key(as_of)).otherwise(F.date_format(as_of, "yyyy-MM-dd"))
    pending = F.coalesce(F.col("pending_key") == key, F.lit(False))
    return state.withColumns({"key": key, "pending": pending, "due": ~pending & (~F.col("exists") | ~F.col("captured_key").eqNullSafe(key))})


def append_day(events: DataFrame, path: str) -> None:
    """Write events by day; the days at hand are written anew and others stay, so a repeated run changes nothing."""
    (events.withColumn("day", F.to_date("at")).repartition("day").write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path))
