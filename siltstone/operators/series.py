"""Time series as long tables: panels, returns, rolling features, runs and durations.

Series are few and dates unbounded in theory, so windows partition by series (or entity) and stay in long form until a
model needs vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_values(observations: DataFrame, order: str) -> DataFrame:
    """(series_id, date, value): usable values, the last by `order` for each series and date."""
    usable = observations.where("series_id is not null and date is not null and value is not null and not isnan(value)")
    return usable.groupBy("series_id", "date").agg(F.max_by("value", order).alias("value"))


def merged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Observations of both, the newer table's where both have a date."""
    return latest_values(before.withColumn("newer", F.lit(0)).unionByName(after.withColumn("newer", F.lit(1))), "newer")


def panel(observations: DataFrame, fill: int = 5) -> DataFrame:
    """(series_id, date, value) on the union of all dates, values carried forward over at most `fill` rows."""
    ids, dates = observations.select("series_id").distinct(), observations.select("date").distinct()
    # the grid is series times dates, which is the panel itself
    grid = dates.crossJoin(F.broadcast(ids)).join(observations, ["series_id", "date"], "left")
    carried = F.last("value", ignorenulls=True).over(Window.partitionBy("series_id").orderBy("date").rowsBetween(-fill, 0))
    return grid.withColumn("value", carried)


def returns(filled: DataFrame) -> DataFrame:
    """(series_id, date, ret): log returns between neighbouring rows, on the dates where every series has one."""
    w = Window.partitionBy("series_id").orderBy("date")
    r = filled.withColumn("ret", F.ln("value") - F.lag(F.ln("value")).over(w))
    n = filled.select("series_id").distinct().agg(F.count("*").alias("n_series"))
    whole = r.where("ret is not null").groupBy("date").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).where("n = n_series").select("date")
    return r.select("series_id", "date", "ret").join(whole, "date", "left_semi")


def rolling(rows: DataFrame, group: str, order: str, value: str, means: tuple[int, ...] = (5, 21), deviations: tuple[int, ...] = (21,)) -> DataFrame:
    """Adds m{n} and v{n}: means and sample deviations over the last n rows, null until there are n."""
    out = rows
    for n, name, f in [(n, f"m{n}", F.avg) for n in means] + [(n, f"v{n}", F.stddev_samp) for n in deviations]:
        w = Window.partitionBy(group).orderBy(order).rowsBetween(1 - n, 0)
        out = out.withColumn(name, F.when(F.count(value).over(w) == n, f(value).over(w)))
    return out


def composites(rets: DataFrame, bridge: DataFrame) -> DataFrame:
    """(composite, date, ret): the mean return of a composite's members; `bridge` (composite, series_id) is small."""
    return rets.join(bridge, "series_id").groupBy("composite", "date").agg(F.avg("ret").alias("ret"))


def runs(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """(group, run, label, n): contiguous runs of a label in order, numbered from 1."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = rows.withColumn("_starts", F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(group, "run").agg(F.first(label).alias(label), F.count("*").alias("n"))


def transitions(run_rows: DataFrame, group: str, label: str) -> DataFrame:
    """(label, next_label, n): how often a run of one label is followed by one of another."""
    following = F.lead(label).over(Window.partitionBy(group).orderBy("run"))
    return run_rows.withColumn("next_label", following).where("next_label is not null").groupBy(F.col(label).alias("label"), "next_label").agg(F.count("*").alias("n"))


def leave_probabilities(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, next_label, p): one added to every change between two labels, rows summing to 1."""
    pairs = labels.select(F.col("label")).crossJoin(labels.select(F.col("label").alias("next_label"))).where("label <> next_label")
    smoothed = pairs.join(counts, ["label", "next_label"], "left").withColumn("k", F.coalesce("n", F.lit(0)) + 1.0)
    return smoothed.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy("label"))).select("label", "next_label", "p")


def hazards(run_rows: DataFrame, label: str, low: float = 0.02, high: float = 0.95) -> DataFrame:
    """(label, n, pmf, survival, hazard): smoothed durations up to each label's longest run."""
    counts = run_rows.groupBy(F.col(label).alias("label"), "n").agg(F.count("*").alias("k"))
    longest = counts.groupBy("label").agg(F.max("n").alias("longest"))
    grid = longest.select("label", F.explode(F.sequence(F.lit(1).cast("long"), F.col("longest"))).alias("n"))
    filled = grid.join(counts, ["label", "n"], "left").withColumn("k", F.coalesce("k", F.lit(0)) + 1.0)
    pmf = filled.withColumn("pmf", F.col("k") / F.sum("k").over(Window.partitionBy("label")))
    survival = F.sum("pmf").over(Window.partitionBy("label").orderBy("n").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = pmf.withColumn("survival", survival)
    return out.withColumn("hazard", F.least(F.greatest(F.col("pmf") / F.greatest(F.col("survival"), F.lit(1e-9)), F.lit(low)), F.lit(high))).drop("k")


def current_run(rows: DataFrame, order: str, label: str) -> DataFrame:
    """(label, n): the label of the last row and the number of rows since another label."""
    last = rows.agg(F.max_by(label, order).alias("current"))
    joined = rows.crossJoin(F.broadcast(last))
    other = joined.where(F.col(label) != F.col("current")).agg(F.max(order).alias("other"))
    return joined.crossJoin(F.broadcast(other)).where(F.col("other").isNull() | (F.col(order) > F.col("other"))).groupBy(F.col("current").alias("label")).agg(F.count("*").alias("n"))


def horizon_stats(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, median, share above 0, four quantiles and expected shortfall (mean of values up to the 5% quantile)."""
    q = values.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.array(*[F.lit(p) for p in (0.05, 0.1, 0.5, 0.9, 0.95)])).alias("q"), F.avg((F.col(value) > 0).cast("int")).alias("p_up"))
    tail = values.join(q.select(*group, F.col("q")[0].alias("floor")), group).where(F.col(value) <= F.col("floor")).groupBy(*group).agg(F.avg(value).alias("shortfall"))
    named = [F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p10", "median", "p90", "p95"))]
    return q.join(tail, group).select(*group, "n", "mean", "p_up", *named, "shortfall")


def excess_kurtosis(g2: Column, n: Column) -> Column:
    """The bias-corrected excess kurtosis from Spark's population one."""
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
