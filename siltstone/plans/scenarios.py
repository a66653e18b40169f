"""Queries of requested profiles and series, over customers as requests and nations as series."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import profiles
from siltstone.plans.tables import table


def _requests(spark, sf_dir):
    """Customers ask for a region by their segment's or name's luck, and for up to three nations by number, some of them unknown."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = lambda n: F.concat(F.lit(" nation_"), (n % 29).cast("string"), F.lit(" "))
    series = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(name(k), name(k * 7 + 3), name(k))).otherwise(F.array(name(k * 5 + 1), name(k + 2)))
    return c.select(k.alias("request"), F.when(k % 3 == 0, F.concat(F.lit("region "), (k % 7).cast("string"))).alias("profile"), F.concat(F.lit("REGION_"), (k % 11).cast("string")).alias("seed"), series.alias("series"))


def _catalog(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.upper(F.replace("n_name", F.lit("#"), F.lit("_"))).alias("series_id"), F.col("n_nationkey").cast("long").alias("seq"), F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("region"))


def _profiles(spark, sf_dir):
    """Regions but one, which has no list: their nations backwards."""
    lists = _catalog(spark, sf_dir).where("region <> 'region-3'").groupBy("region").agg(F.sort_array(F.collect_list(F.struct((-F.col("seq")).alias("at"), "series_id"))).alias("s"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("region"), F.col("r_regionkey").cast("long").alias("seq"))
    return r.join(lists, "region", "left").select(F.col("region").alias("id"), F.concat(F.lit("Region: "), (F.col("seq") + 5).cast("string")).alias("title"), "seq", F.transform("s", lambda x: x["series_id"]).alias("series"))


def _resolved(spark, sf_dir):
    asked, own = _requests(spark, sf_dir), _profiles(spark, sf_dir)
    found = profiles.resolved_profiles(asked, own)
    return found, profiles.resolved_series(asked.select("request", "series").join(found, "request"), own, _catalog(spark, sf_dir))


def requested_profiles(spark, sf_dir):
    return profiles.resolved_profiles(_requests(spark, sf_dir), _profiles(spark, sf_dir))


def requested_series(spark, sf_dir):
    """The series of every request in the order that it asked for them."""
    return _resolved(spark, sf_dir)[1].select("request", F.col("place").cast("long").alias("place"), "series")


def requested_tables(spark, sf_dir):
    """Tables of customers' balances by nation, for every request; balances in ten thousands stand for returns."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    value = F.round(F.col("c_acctbal")) / 65536
    q = lambda p: F.percentile(value, F.lit(p))
    stats = c.groupBy(F.upper(F.replace("n_name", F.lit("#"), F.lit("_"))).alias("series")).agg(q(0.5).alias("mean"), q(0.5).alias("median"), F.avg((F.col("c_acctbal") > 0).cast("int")).alias("p_up"), q(0.1).alias("p10"), q(0.9).alias("p90"))
    return profiles.horizon_tables(_resolved(spark, sf_dir)[1], stats)


_WORLD = """q AS (SELECT c_custkey AS request, CASE WHEN c_custkey % 3 = 0 THEN 'region-' || (c_custkey % 7) ELSE '' END AS profile, 'region-' || (c_custkey % 11) AS seed, c_custkey % 4 AS kind, [c_custkey, c_custkey * 7 + 3, c_custkey] AS a, [c_custkey * 5 + 1, c_custkey + 2] AS b FROM customer),
n AS (SELECT upper(replace(n_name, '#', '_')) AS series, n_nationkey AS seq, n_regionkey AS region FROM nation),
p AS (SELECT request, kind, a, b, coalesce((SELECT r_regionkey FROM region WHERE 'region-' || r_regionkey = q.profile OR 'region-' || (r_regionkey + 5) = q.profile), (SELECT r_regionkey FROM region WHERE 'region-' || r_regionkey = q.seed OR 'region-' || (r_regionkey + 5) = q.seed), 0) AS region FROM q),
w AS (SELECT request, i AS nth, 'NATION_' || (x % 29) AS series FROM (SELECT request, unnest(CASE WHEN kind = 1 THEN a ELSE b END) AS x, generate_subscripts(CASE WHEN kind = 1 THEN a ELSE b END, 1) AS i FROM p WHERE kind <> 0) UNION ALL SELECT request, CASE WHEN p.region = 3 THEN seq ELSE -seq END, series FROM p JOIN n ON p.region = n.region OR p.region = 3 WHERE kind = 0),
s AS (SELECT request, row_number() OVER (PARTITION BY request ORDER BY nth) AS place, series FROM w WHERE series IN (SELECT series FROM n))"""
_PROFILES = f"WITH {_WORLD} SELECT request, 'region-' || region AS profile FROM p"
_SERIES = f"WITH {_WORLD} SELECT request, place, series FROM s"
_pct = lambda e: f"printf('%.1f%%', {e} * 100)"
_TABLES = f"""WITH {_WORLD}, v AS (SELECT upper(replace(n_name, '#', '_')) AS series, quantile_cont(round(c_acctbal) / 65536::DOUBLE, [0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS q, avg(CAST(c_acctbal > 0 AS INT)) AS up FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
l AS (SELECT series, '| ' || series || ' | ' || {_pct('q[2]')} || ' | ' || {_pct('q[2]')} || ' | ' || {_pct('up')} || ' | ' || {_pct('q[1]')} || ' | ' || {_pct('q[3]')} || ' |' AS line FROM v)
SELECT request, '{profiles.SERIES_HEAD[0]}' || chr(10) || '{profiles.SERIES_HEAD[1]}' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY place), '{profiles.NO_SERIES}') AS "table" FROM s LEFT JOIN l USING (series) GROUP BY request"""

QUERIES = {"requested_profiles": (requested_profiles, _PROFILES), "requested_series": (requested_series, _SERIES), "requested_tables": (requested_tables, _TABLES)}
