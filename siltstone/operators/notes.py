"""Catalog of notes: link graph, tag roll-ups, freshness, and data-quality rules as one pass per rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import concept_label, pinned, slug, strip, wiki_links

# Path prefixes of the kinds of notes.
KINDS = {
    "wiki/source-notes/": "source-note", "wiki/concepts/": "concept", "wiki/entities/": "entity", "wiki/claims/": "claim", "wiki/states/": "state",
    "wiki/regimes/": "regime", "wiki/decisions/": "decision", "wiki/probabilities/": "probability", "wiki/theses/": "thesis", "wiki/synthesis/": "synthesis",
    "wiki/questions/": "question", "wiki/timelines/": "timeline", "wiki/surveillance/": "surveillance", "wiki/watch-profiles/": "watch-profile",
    "wiki/reports/": "report", "wiki/self/": "self-note", "wiki/drafts/": "draft", "wiki/_indices/": "index", "wiki/_maps/": "map",
}


def note_kind(path: Column) -> Column:
    out = F.lit("note")
    for prefix, kind in KINDS.items():
        out = F.when(path.startswith(prefix), kind).otherwise(out)
    return out


def aliases(notes: DataFrame) -> DataFrame:
    """(alias, path): a note's path without extension, without its first folder, and its stem; the last scanned wins."""
    whole = F.lower(F.regexp_replace("path", r"(?i)\.md$", ""))
    names = F.array_distinct(F.array(whole, F.regexp_replace(whole, "^wiki/", ""), F.regexp_extract(whole, "([^/]+)$", 1)))
    rows = notes.select("path", "seq", F.explode(names).alias("alias"))
    return rows.groupBy("alias").agg(F.max_by("path", F.struct("seq", "path")).alias("path"))


def resolved_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links (src, target) with their `path`, null where nothing has that name."""
    return links.join(names.withColumnRenamed("alias", "target"), "target", "left")


def note_links(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("path").alias("src"), F.explode(wiki_links(F.col("body"))).alias("raw")).select("src", F.lower("raw").alias("target")).distinct()


def backlinks(resolved: DataFrame) -> DataFrame:
    """(path, n_sources, sources): distinct linking notes in order; a note's links to itself do not count."""
    rows = resolved.where("path is not null and path <> src").select("path", "src").distinct()
    return rows.groupBy("path").agg(F.count("*").alias("n_sources"), F.sort_array(F.collect_list("src")).alias("sources"))


def broken_links(resolved: DataFrame) -> DataFrame:
    return resolved.where("path is null").select("src", "target").distinct()


def orphans(notes: DataFrame, linked: DataFrame) -> DataFrame:
    return notes.join(linked.select("path"), "path", "left_anti")


def tag_rollup(tags: DataFrame) -> DataFrame:
    """From (note, tag): key, count with repeats, number of spellings and of notes. Over one spelling is drift."""
    keyed = tags.select("note", strip(F.col("tag")).alias("label")).where("label <> ''").withColumn("tag_key", slug(F.col("label")))
    return keyed.groupBy("tag_key").agg(F.count("*").alias("n_uses"), F.countDistinct("label").alias("n_labels"), F.countDistinct("note").alias("n_notes"))


def freshness(age_days: Column, threshold: Column) -> Column:
    return F.when(age_days.isNull(), "undated").when(age_days > threshold, "stale").otherwise("fresh")


def age_days(date: Column, as_of: Column) -> Column:
    """Whole days from a date to `as_of`; never the clock."""
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(date)) / 86400)


def first_date(*dates: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(d) for d in dates])


def open_threads(body: Column) -> Column:
    """Bullets that name an open question; placeholders are none."""
    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), strip), lambda x: x.rlike(r"^[-*]\s+"))
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^[-*]\s+", "")), lambda x: ~x.rlike(r"(?i)^(none|no|not yet|add|review)\b"))


def issues(rows: DataFrame, rules: list[tuple[str, str, Column]], key: str) -> DataFrame:
    """(severity, rule, key) of every rule that a row breaks: one scan, one array of broken rules, one explode."""
    broken = F.array(*[F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))) for severity, rule, test in rules])
    found = rows.select(F.col(key).cast("string").alias("item"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("issue"))
    return found.select("issue.severity", "issue.rule", "item")


def term_notes(notes: DataFrame, terms: DataFrame, limit: int = 8) -> DataFrame:
    """(label, path, rank): notes whose text holds a term as whole words, the first `limit` paths per term.

    The terms are an ontology, one row of a few hundred labels; each note is read once and keeps those that it contains.
    """
    held = F.broadcast(terms.select(concept_label(F.col("term")).alias("label")).agg(F.sort_array(F.collect_set("label")).alias("labels")))
    padded = pinned(notes.select("path", "text"), padded=F.concat(F.lit(" "), concept_label(F.col("text")), F.lit(" "))).select("path", "padded")
    found = F.filter("labels", lambda t: F.col("padded").contains(F.concat(F.lit(" "), t, F.lit(" "))))
    hits = padded.crossJoin(held).select("path", F.explode(found).alias("label")).distinct()
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("path"))).where(F.col("rank") <= limit)
