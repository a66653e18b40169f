"""Scenario profiles and series by request, in the order that was asked for, and the tables that report their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import slug
from siltstone.operators.watch import percent

# The profile where none matches, and what a run takes by default.
FALLBACK = "global-risk-regime"
DEFAULT_PATHS, DEFAULT_HORIZONS = 100_000, [5, 21, 63, 126]


def series_key(value: Column) -> Column:
    return F.upper(F.trim(F.coalesce(value, F.lit(""))))


def resolved_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """(request, profile) from requests (request, profile, seed) and profiles (id, title, seq).

    The profile named by id or title is taken, else the one that the seed names, else the fallback, else the first. Names meet
    as slugs, in two equi-joins; of several profiles with a name the first holds. The defaults are one row.
    """
    ids = profiles.select(slug(F.coalesce(F.nullif("id", F.lit("")), "title")).alias("id"), slug(F.col("title")).alias("title"), "seq")
    names = ids.select("id", "seq", F.explode(F.array_distinct(F.array("id", "title"))).alias("name"))
    names = names.groupBy("name").agg(F.min_by("id", "seq").alias("found"))
    default = ids.agg(F.coalesce(F.min(F.when(F.col("id") == FALLBACK, F.col("id"))), F.min_by("id", "seq")).alias("default"))
    side = lambda c: names.select(F.col("name").alias(f"{c}_name"), F.col("found").alias(f"{c}_found"))
    rows = requests.select("request", *[slug(F.coalesce(c, F.lit(""))).alias(c) for c in ("profile", "seed")])
    rows = rows.join(side("profile"), F.col("profile") == F.col("profile_name"), "left").join(side("seed"), F.col("seed") == F.col("seed_name"), "left")
    return rows.crossJoin(F.broadcast(default)).select("request", F.coalesce("profile_found", "seed_found", "default").alias("profile"))  # one row


def resolved_series(requests: DataFrame, profiles: DataFrame, catalog: DataFrame) -> DataFrame:
    """(request, place, series): the catalog's series of each request (request, profile, series), in its order.

    A request's own list comes first, else its profile's (id, series), else the whole catalog (series_id, seq) in its order.
    Ids are compared without case; unknown ones are left out, repeated ones stay. Places count what is left, from 1. A request
    of which nothing is left has no row.
    """
    held = catalog.groupBy(series_key(F.col("series_id")).alias("key")).agg(F.min_by("series_id", "seq").alias("series"), F.min("seq").alias("seq"))
    lists = profiles.select(F.col("id").alias("of"), F.col("series").alias("listed"))
    filled = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    asked = requests.join(lists, F.col("profile") == F.col("of"), "left").select("request", filled(F.col("series")).alias("own"), filled(F.col("listed")).alias("listed"))
    asked = asked.select("request", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("listed")).alias("ids"))
    named = asked.select("request", F.posexplode("ids").alias("at", "id")).join(held.drop("seq"), series_key(F.col("id")) == F.col("key")).select("request", "at", "series")
    # requests without a list take the catalog, which is written by hand and one row here
    full = held.agg(F.sort_array(F.collect_list(F.struct(F.col("seq").alias("at"), "series"))).alias("full"))
    whole = asked.where(F.size("ids") == 0).select("request").crossJoin(F.broadcast(full)).select("request", F.explode("full").alias("f")).select("request", "f.at", "f.series")
    every = named.unionByName(whole)
    placed = every.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("at", "series"))).alias("rows"))
    return placed.select("request", F.posexplode("rows").alias("place", "r")).select("request", (F.col("place") + 1).alias("place"), "r.series")


# The heads of the tables.
SERIES_HEAD = ["| Series | Mean | Median | Prob Up | P10 | P90 |", "| --- | ---: | ---: | ---: | ---: | ---: |"]
NO_SERIES = "| n/a | n/a | n/a | n/a | n/a | n/a |"


def horizon_tables(wanted: DataFrame, stats: DataFrame) -> DataFrame:
    """(request, table): the statistics (series, mean, median, p_up, p10, p90) of each request's series as a table in its order."""
    cells = [F.col("series"), *[percent(F.col(c)) for c in ("mean", "median", "p_up", "p10", "p90")]]
    lines = stats.select("series", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    rows = wanted.join(lines, "series", "left").groupBy("request").agg(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("place", "line")))).alias("r"))
    body = F.when(F.size("r") > 0, F.transform("r", lambda x: x["line"])).otherwise(F.array(F.lit(NO_SERIES)))
    return rows.select("request", F.array_join(F.concat(F.array(*map(F.lit, SERIES_HEAD)), body), "\n").alias("table"))


def ranked_lines(values: DataFrame, by: str) -> DataFrame:
    """(by, lines): labels (by, label, probability) as a list from the likeliest on; equal ones by label."""
    rows = values.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("probability")).alias("order"), "label", percent(F.col("probability")).alias("shown")))).alias("r"))
    return rows.select(by, F.array_join(F.transform("r", lambda x: F.concat(F.lit("- "), x["label"], F.lit(": "), x["shown"])), "\n").alias("lines"))
