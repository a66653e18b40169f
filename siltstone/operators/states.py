"""States and decisions: label votes, overlays, subject resolution and snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import concept_label


def state_label(positive: Column, negative: Column, contested: Column) -> Column:
    """A vote over claims: contested first, then a lead of two, else mixed."""
    return F.when(contested >= F.greatest(F.lit(2), positive, negative), "contested").when(positive >= negative + 2, "constructive").when(negative >= positive + 2, "fragile").otherwise("mixed")


def evidence_confidence(n: Column) -> Column:
    return F.when(n >= 8, "high").when(n >= 5, "medium-high").when(n >= 3, "medium").when(n >= 1, "low").otherwise("unknown")


def votes(claims: DataFrame, subject: str) -> DataFrame:
    """Per subject the counts by polarity, the label and the confidence of its claims (polarity, status)."""
    count = lambda c: F.sum(c.cast("int")).cast("long")
    grouped = claims.groupBy(subject).agg(count(F.col("polarity") == "positive").alias("n_positive"), count(F.col("polarity") == "negative").alias("n_negative"), count(F.col("status") == "contested").alias("n_contested"), F.count("*").alias("n_claims"))
    return grouped.withColumns({"state_label": state_label(F.col("n_positive"), F.col("n_negative"), F.col("n_contested")), "confidence": evidence_confidence(F.least("n_claims", F.lit(10)))})


def phrase_score(subject: Column, phrase: Column) -> Column:
    """How well a phrase names a subject: equal, within it, or around it."""
    s, p = concept_label(subject), concept_label(phrase)
    return F.when((s == "") | (p == ""), 0).when(s == p, 1000 + F.length(p)).when(s.contains(p), 600 + F.length(p)).when(p.contains(s), 400 + F.length(s)).otherwise(0)


def resolve_subjects(subjects: DataFrame, phrases: DataFrame) -> DataFrame:
    """(subject, title, score): the best profile of each subject; `phrases` (title, phrase) is the table of profiles.

    Equality and containment are found through shared words: both sides meet on the words of their labels, so subjects
    never meet phrases that have no word in common with them.
    """
    s = subjects.select("subject", F.explode(F.array_distinct(F.split(concept_label(F.col("subject")), " "))).alias("word"))
    p = phrases.select("title", "phrase", F.explode(F.array_distinct(F.split(concept_label(F.col("phrase")), " "))).alias("word"))
    met = s.join(p, "word").select("subject", "title", "phrase").distinct().withColumn("score", phrase_score(F.col("subject"), F.col("phrase"))).where("score > 0")
    best = Window.partitionBy("subject").orderBy(F.desc("score"), "title", "phrase")
    return met.withColumn("place", F.row_number().over(best)).where("place = 1").select("subject", "title", "score")


def overlay(states: DataFrame, biases: DataFrame) -> DataFrame:
    """(subject, series, bias): basis points by (subject, label), `mixed` where the label has none, times intensity.

    Intensity is 1 plus the lead of one side over all claims, between 0.5 and 1.75.
    """
    lead = F.abs(F.col("n_positive") - F.col("n_negative")) / F.greatest(F.col("n_claims"), F.lit(1))
    s = states.withColumn("intensity", F.least(F.greatest(1.0 + lead, F.lit(0.5)), F.lit(1.75)))
    own = biases.select("subject", "state_label").distinct().withColumn("has", F.lit(True))
    s = s.join(own, ["subject", "state_label"], "left").withColumn("used", F.when(F.col("has"), F.col("state_label")).otherwise("mixed"))
    b = biases.withColumnRenamed("state_label", "used")
    return s.join(b, ["subject", "used"]).groupBy("subject", "series").agg(F.sum(F.col("bps") * F.col("intensity")).alias("bias"))


def set_diff(rows: DataFrame, group: str, item: str, before: Column, after: Column) -> DataFrame:
    """Per group the numbers of items carried, added and removed between two selections of rows."""
    seen = rows.where(before | after).groupBy(group, item).agg(F.max(before.cast("int")).alias("was"), F.max(after.cast("int")).alias("is"))
    count = lambda c: F.sum(c.cast("int")).cast("long")
    return seen.groupBy(group).agg(count((F.col("was") == 1) & (F.col("is") == 1)).alias("n_carried"), count((F.col("was") == 0) & (F.col("is") == 1)).alias("n_added"), count((F.col("was") == 1) & (F.col("is") == 0)).alias("n_removed"))


def recurring_themes(results: DataFrame, subject: list[str], words: Column, n: int = 6) -> DataFrame:
    """The commonest words of the results beside those of the subject."""
    return results.select(F.explode(words).alias("word")).where(~F.col("word").isin(subject or [""])).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)
