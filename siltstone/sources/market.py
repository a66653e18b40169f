"""Market data payloads of three vendors as observations (date, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import strip


def _column(payload: Column, names: Column, header: str, fallback: int | None = None) -> Column:
    place = F.array_position(names, header)
    return F.when(place > 0, place).otherwise(F.lit(fallback)) if fallback is not None else F.when(place > 0, place)


def csv_observations(payloads: DataFrame, value_header: str, fallback: int | None = None) -> DataFrame:
    """(series_id, date, value) from CSV texts (series_id, payload): columns by header, values that are no numbers left out."""
    lines = F.filter(F.transform(F.split("payload", r"\r?\n"), strip), lambda x: x != "")
    names = F.transform(F.split(F.lower(lines[0]), ","), strip)
    rows = payloads.select("series_id", F.explode(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))).alias("line"), _column(F.col("payload"), names, "date").alias("d"), _column(F.col("payload"), names, value_header, fallback).alias("v"))
    cells = F.split("line", ",")
    parsed = rows.select("series_id", F.try_to_date(strip(F.get(cells, F.col("d").cast("int") - 1))).alias("date"), strip(F.get(cells, F.col("v").cast("int") - 1)).try_cast("double").alias("value"))
    return parsed.where("date is not null and value is not null and not isnan(value) and abs(value) < double('Infinity')")


def stooq(payloads: DataFrame) -> DataFrame:
    return csv_observations(payloads, "close")


def fred(payloads: DataFrame) -> DataFrame:
    """The second column holds the values where no header says so."""
    return csv_observations(payloads, "value", 2)


_CHART = "struct<chart: struct<result: array<struct<timestamp: array<bigint>, indicators: struct<adjclose: array<struct<adjclose: array<double>>>, quote: array<struct<close: array<double>>>>>>>>"


def yahoo(payloads: DataFrame) -> DataFrame:
    """Adjusted closes where there are any, else closes."""
    result = F.from_json("payload", _CHART)["chart"]["result"][0]
    adjusted, close = F.get(result["indicators"]["adjclose"], F.lit(0))["adjclose"], F.get(result["indicators"]["quote"], F.lit(0))["close"]
    values = F.when(F.exists(adjusted, lambda x: x.isNotNull()), adjusted).otherwise(close)
    pairs = payloads.select("series_id", F.explode(F.arrays_zip(result["timestamp"].alias("t"), values.alias("v"))).alias("p"))
    return pairs.select("series_id", F.to_date(F.timestamp_seconds("p.t")).alias("date"), F.col("p.v").alias("value")).where("date is not null and value is not null")


PARSERS = {"stooq": stooq, "fred": fred, "yahoo-chart": yahoo}


def observations(payloads: DataFrame) -> DataFrame:
    """Observations of payloads (series_id, vendor, payload), each by its vendor's parser."""
    parts = [parse(payloads.where(F.col("vendor") == name)) for name, parse in PARSERS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def with_history(fresh: DataFrame, cached: DataFrame) -> DataFrame:
    """Fresh observations, and cached ones of the series that have none."""
    return fresh.unionByName(cached.join(fresh.select("series_id").distinct(), "series_id", "left_anti"))
