"""Rules of conduct: which apply in a context, which of two in conflict wins, and what is left.

A rule set is written by hand and small; contexts are a list of commands. The joins below are equi-joins on reference
keys and on (context, path), so they hold for any size all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import slug
from siltstone.operators.retrieval import is_retired

# Ranks of strengths and of sources.
STRENGTH = {"hard": 3, "default": 2, "soft": 1}
BASIS = {"learned-from-postmortem": 3, "observed": 2, "declared": 1}
CHECKS = ("bias", "anti-pattern")


def ranked(value: Column, ranks: dict[str, int], other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))]), value), F.lit(ranks[other]))


def priority(value: Column) -> Column:
    """A whole number from 1 to 5; 3 where there is none."""
    return F.least(F.greatest(F.round(F.coalesce(F.try_to_number(value.cast("string"), F.lit("999")), F.lit(3))).cast("int"), F.lit(1)), F.lit(5))


def matches(status: Column, scope: Column, applies: Column, command: Column, applicability: Column) -> Column:
    wide = command.isNull() | (command == "global") | F.array_contains(scope, "global") | F.array_contains(scope, command)
    return ~is_retired(status) & wide & (F.array_contains(applies, "global") | F.arrays_overlap(applies, applicability))


def in_context(rules: DataFrame, contexts: DataFrame) -> DataFrame:
    """Rules (path, title, status, priority, strength, scope, applies, basis, ...) that match each context (context, command, applicability).

    The contexts, a fixed list of commands, are broadcast; each rule row becomes the contexts that it matches.
    """
    held = F.broadcast(contexts.agg(F.collect_list(F.struct("context", "command", "applicability")).alias("contexts")))
    fits = F.filter("contexts", lambda c: matches(F.col("status"), F.col("scope"), F.col("applies"), c["command"], c["applicability"]))
    out = rules.crossJoin(held).select(*rules.columns, F.explode(fits).alias("c")).select(*rules.columns, "c.*")
    # higher comes first; where ranks are equal, the lesser title does
    exact = F.exists("applicability", lambda a: (a != "global") & F.array_contains(F.col("applies"), a))
    specific = F.when(F.array_contains("scope", F.col("command")), 2).when(F.array_contains("scope", "global"), 1).otherwise(0)
    rank = F.struct(F.col("priority").alias("p"), ranked(F.col("strength"), STRENGTH, "default").alias("s"), specific.alias("c"), F.when(exact, 2).when(F.array_contains("applies", "global"), 1).otherwise(0).alias("a"), ranked(F.col("basis"), BASIS, "declared").alias("b"))
    return out.withColumn("rank", rank)


def conflicts(matched: DataFrame) -> DataFrame:
    """(context, winner, loser, relation): each pair that names the other as conflicting or superseded, once."""
    keys = F.array(F.lower("title"), slug(F.col("title")), F.lower("path"), F.lower(F.regexp_extract("path", r"([^/]+)$", 1)), F.lower(F.regexp_extract("path", r"([^/]+?)(\.md)?$", 1)))
    named = matched.select("context", "path", "title", "rank", "seq", F.explode(F.array_distinct(keys)).alias("key")).groupBy("context", "key").agg(F.min_by(F.struct("path", "title", "rank"), "seq").alias("target"))
    ref = lambda c, r: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lower(F.trim(x)).alias("key"), F.lit(r).alias("relation")))
    refs = matched.select("context", "path", "title", "rank", "seq", F.posexplode(F.concat(ref(F.col("conflicts_with"), "conflicts_with"), ref(F.col("supersedes"), "supersedes"))).alias("place", "r")).select("*", "r.key", "r.relation")
    met = refs.join(named, ["context", "key"]).where("path <> target.path")
    # a null title is the least
    first = F.struct("title", "path") < F.struct("target.title", "target.path")
    win = (F.col("rank") > F.col("target.rank")) | ((F.col("rank") == F.col("target.rank")) & first)
    pairs = met.select("context", F.least("path", "target.path").alias("a"), F.greatest("path", "target.path").alias("b"), F.when(win, F.col("path")).otherwise(F.col("target.path")).alias("winner"), F.when(win, F.col("target.path")).otherwise(F.col("path")).alias("loser"), "relation", F.struct("seq", "place").alias("order"))
    return pairs.groupBy("context", "a", "b").agg(F.min_by(F.struct("winner", "loser", "relation"), "order").alias("p")).select("context", "p.*")


def resolve(rules: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active rules with their class and place in each context, conflicts). A rule that lost can still beat another."""
    # a file of few splits would put the keys of all rules together in one task
    matched = in_context(rules.repartition(_ranges(rules), "path"), contexts)
    met = conflicts(matched)
    left = matched.join(met.select("context", F.col("loser").alias("path")).distinct(), ["context", "path"], "left_anti")
    kind = F.when(F.col("schema").isin(*CHECKS), "bias_check").when(F.col("strength") == "hard", "hard_rule").otherwise("soft_preference")
    order = [F.desc("priority"), F.desc(ranked(F.col("strength"), STRENGTH, "default")), F.col("title"), F.col("path")]
    return placed(left.withColumn("kind", kind).drop("rank"), ["context", "kind"], order), met


def _ranges(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def placed(rows: DataFrame, groups: list[str], order: list[Column], place: str = "place") -> DataFrame:
    """`rows` with their place from 1 in each group. A few groups may hold all rows, so these are dealt out by ranges, numbered
    there, and moved on by what the ranges before hold."""
    # the ranges are kept, as both the numbers and the counts go by them; a given number of them is not put together again
    dealt = rows.repartitionByRange(_ranges(rows), *groups, *order).withColumn("slot", F.spark_partition_id()).cache()
    before = Window.partitionBy(*groups).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy(*groups, "slot").agg(F.count("*").alias("n")).select(*[F.col(g).alias(f"of_{g}") for g in groups], F.col("slot").alias("of_slot"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = dealt.withColumn(place, F.row_number().over(Window.partitionBy("slot", *groups).orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*groups, "slot")]
    return numbered.join(F.broadcast(held), same).withColumn(place, F.col(place) + F.col("before")).select(*rows.columns, place)


def stale_reviews(rules: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("reviewed_at")) / 86400)
    return rules.withColumn("age_days", age).where((F.col("review_trigger") != "") & (F.col("age_days") >= days))
