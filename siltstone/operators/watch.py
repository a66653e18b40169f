"""What is watched, looked up and reported: profiles, targets by name, section plans, gaps, events, scenario labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import plain_markdown, slug, squeeze


def exact_profiles(subjects: DataFrame, profiles: DataFrame) -> DataFrame:
    """(subject, path): the first profile whose title or alias has the subject's slug."""
    names = profiles.select("path", F.explode(F.array_distinct(F.transform(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>"))), slug))).alias("k")).where("k <> ''")
    first = names.groupBy("k").agg(F.min("path").alias("path"))
    return subjects.select("subject", slug(F.col("subject")).alias("k")).join(first, "k").select("subject", "path")


LISTS = ("aliases", "entities", "concepts", "risk_triggers")
DEFAULTS = {"status": "active", "priority": "medium", "cadence": "ad-hoc"}


def updated_profiles(held: DataFrame, given: DataFrame) -> DataFrame:
    """Profiles by slug of their title: lists are united in order, other fields take what is given, else held, else a default."""
    side = lambda df, s: df.select(slug(F.col("title")).alias("k"), *[F.col(c).alias(f"{s}_{c}") for c in ("title", *LISTS, *DEFAULTS)])
    both = side(held, "h").join(side(given, "g"), "k", "full_outer")
    none = F.array().cast("array<string>")
    united = lambda c: F.array_distinct(F.filter(F.concat(F.coalesce(f"h_{c}", none), F.coalesce(f"g_{c}", none)), lambda v: v != ""))
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    fields = [F.coalesce(said(f"g_{c}"), said(f"h_{c}"), F.lit(d)).alias(c) for c, d in DEFAULTS.items()]
    return both.select("k", F.coalesce("g_title", "h_title").alias("title"), *[united(c).alias(c) for c in LISTS], *fields)


def active_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.where(F.coalesce("status", F.lit("active")) != "inactive")


def best_targets(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """(asked, path, score, ambiguous): the candidate that fits each name best.

    A whole path fits best, then a stem, title or slug, then the end of a path, then any part of path or title. Names are
    a handful (what a user typed), so they are broadcast; each candidate is read once.
    """
    low = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\\", "/")))
    names = asked.select("asked", low(F.col("asked")).alias("q")).where("q <> ''")
    path, title, q = low(F.col("path")), low(F.col("title")), F.col("q")
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), r"\.md$", "")
    whole = (path == q) | (path == F.concat(q, F.lit(".md")))
    named = (stem == q) | (title == q) | (slug(F.col("title")) == q)
    ending = path.endswith(F.concat(F.lit("/"), q)) | path.endswith(F.concat(F.lit("/"), q, F.lit(".md")))
    score = F.when(whole, 100).when(named, 90).when(ending, 80).when(path.contains(q) | title.contains(q), 60)
    found = candidates.select("path", "title").join(F.broadcast(names), score.isNotNull()).select("asked", "path", score.alias("score"))
    best = found.groupBy("asked").agg(F.max("score").alias("score"))
    return found.join(best, ["asked", "score"]).groupBy("asked", "score").agg(F.min("path").alias("path"), (F.count("*") > 1).alias("ambiguous")).select("asked", "path", "score", "ambiguous")


# What asks for a report over everything.
BROAD = ("investment summary", "current investment summary", "all ingested research", "all corpus", "entire corpus", "whole corpus")


def is_broad(topic: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(topic, F.lit(""))))
    return F.exists(F.array(*map(F.lit, BROAD)), lambda b: low.contains(b))


def section_priority(score: Column, title: Column, path: Column, document_class: Column, pattern: str, takes_charts: bool) -> Column:
    """A result's worth within a section: titles on its subject and source notes gain, charts lose unless it lives on them."""
    chart = F.lower(F.trim(F.coalesce(document_class, F.lit("")))) == "chartpack_or_visual"
    return score + F.when(title.rlike(f"(?i){pattern}"), 12).otherwise(0) + F.when(path.startswith("wiki/source-notes/"), 3).otherwise(0) + F.when(chart, 2 if takes_charts else -10).otherwise(0)


def section_results(ranked: DataFrame, limit: int = 5, least: int = 3) -> DataFrame:
    """(section, path, place) from (section, path, score, is_evidence): evidence first; where under `least` pieces of it are
    found, canonical and raw notes take part, too."""
    n = ranked.groupBy("section").agg(F.count_if("is_evidence").alias("n"))
    rows = ranked.join(n, "section").where(F.col("is_evidence") | (F.col("n") < least))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("score"), "path"))).where(F.col("place") <= limit).select("section", "path", "place")


def coverage(sections: DataFrame, results: DataFrame, thin: int = 3) -> DataFrame:
    """(section, n_results, n_reviewed, n_provisional, state): sections without results are uncovered, with few thin."""
    counts = results.groupBy("section").agg(F.count("*").alias("n_results"), F.count_if("reviewed").alias("n_reviewed"), F.count_if(~F.col("reviewed")).alias("n_provisional"))
    out = sections.select("section").join(counts, "section", "left").na.fill(0, ["n_results", "n_reviewed", "n_provisional"])
    return out.withColumn("state", F.when(F.col("n_results") == 0, "uncovered").when(F.col("n_results") < thin, "thin").otherwise("covered"))


def state_gaps(counts: DataFrame) -> DataFrame:
    """(subject, gaps) from (subject, n_claims, n_evidence, escalated, watched, n_stale): what a state page lacks."""
    found = F.array(F.when(F.col("n_claims") < 3, "claims"), F.when(F.col("n_evidence") < 3, "evidence"), F.when(F.col("escalated"), "route"), F.when(~F.col("watched"), "watch"), F.when(F.col("n_stale") > 0, "stale"))
    return counts.select("subject", F.filter(found, lambda g: g.isNotNull()).alias("gaps"))


def lead_claims(claims: DataFrame, by: str, limit: int = 4) -> DataFrame:
    """(by, id, place, role): contested claims and negative ones flip a state or count against it; contested ones go first."""
    role = F.when(F.col("status") == "contested", "contested").when(F.col("polarity") == "negative", "negative")
    rows = claims.withColumn("role", role).where("role is not null")
    place = F.row_number().over(Window.partitionBy(by).orderBy("role", F.desc("score"), "id"))
    return rows.select(by, "id", place.alias("place"), "role").where(F.col("place") <= limit)


# Openings of capture remarks that are no claims of a broad report.
REMARKS = "direct capture created|page-by-page|initial batch capture authored|review notes? from capture|text was extracted locally|pdfplumber|direct single-document capture used|review chart-heavy sections"


def report_claims(found: DataFrame, limit: int = 12, remarks: str = REMARKS) -> DataFrame:
    """The first `limit` of ranked claims (claim_text, claim_score, id) that are no remarks on capturing."""
    text = F.trim(F.coalesce("claim_text", F.lit("")))
    return found.where((text != "") & ~text.rlike(f"(?i){remarks}")).orderBy(F.desc("claim_score"), "id").limit(limit)


def compact_line(line: Column) -> Column:
    """Without bullet, number and marks, in single spaces."""
    return squeeze(plain_markdown(F.regexp_replace(F.regexp_replace(line, r"^\s*[-*]\s+", ""), r"^\s*\d+\.\s+", "")))


def compact_lines(text: Column, limit: int) -> Column:
    """The first distinct compact lines of a text."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), compact_line)
    return F.slice(F.array_distinct(F.filter(lines, lambda x: x != "")), 1, limit)


# Commands that leave no event, and what the others say; {n} is a count, {topic} and {path} may be absent.
SILENT = "help memory-status memory-refresh capture-memory doctor lint search watch-list claim-diff state-diff".split()
PACKS = "ask deck surveil watch why-believe state-refresh regime-brief meeting-brief decision-note red-team what-changed-for-markets reflect principles postmortem".split()
SAYS = {
    "ingest": "Ingested {n} file(s) into the knowledge base.",
    "self-ingest": "Ingested {n} self-note(s) into the self-model corpus.",
    "compile": "Recompiled maintained knowledge surfaces across notes, claims, states, and indices.",
    "pdf-pack": "Prepared a PDF vision pack for {n} document(s).",
    "capture-pdf": "Captured PDF handoff output and ingested {n} document(s).",
    "capture-research": "Captured research handoff and ingested {n} source(s).",
    "frontier-pack": "Prepared a frontier pack{ for topic}.",
    "capture-frontier": "Captured frontier-authored output{ to path}.",
    "capture-authored": "Captured authored output{ to path}.",
    "report": "Prepared a report pack{ for topic}.",
    "capture-report": "Captured a canonical report{ to path}.",
    "watch-refresh": "Refreshed watch surveillance{ and wrote path}.",
    "claims-refresh": "Refreshed the claim ledger with {n} claim(s).",
}


def event_summary(command: Column, n: Column, topic: Column, path: Column) -> Column:
    """What an event says of its command; null for commands that leave none."""
    count = F.coalesce(n, F.lit(0)).cast("long").cast("string")
    part = lambda before, value: F.when(F.coalesce(F.trim(value), F.lit("")) != "", F.concat(F.lit(before), F.trim(value))).otherwise("")
    parts = {"{n}": count, "{ for topic}": part(" for ", topic), "{ to path}": part(" to ", path), "{ and wrote path}": part(" and wrote ", path)}
    out = F.when(command.isin(PACKS), F.concat(F.lit("Prepared a "), command, F.lit(" authored pack"), parts["{ for topic}"], F.lit(".")))
    for name, text in SAYS.items():
        value = F.lit(text)
        for mark, said in parts.items():
            if mark in text:
                before, after = text.split(mark)
                value = F.concat(F.lit(before), said, F.lit(after))
        out = out.when(command == name, value)
    return out


def recent(events: DataFrame, order: list[str], limit: int = 5) -> DataFrame:
    """The last events, latest first."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(limit)


def model_confidence(history_days: Column, n_missing: Column) -> Column:
    days = F.coalesce(history_days, F.lit(0))
    return F.when((days >= 756) & (F.coalesce(n_missing, F.lit(0)) == 0), "high").when(days >= 504, "medium-high").when(days >= 252, "medium").otherwise("low")


def percent(value: Column, digits: int = 1) -> Column:
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.format_string(f"%.{digits}f%%", value * 100)).otherwise("n/a")


def basis_points(value: Column) -> Column:
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.format_string("%.1f bp/day", value)).otherwise("n/a")


def largest_biases(biases: DataFrame, by: str, limit: int = 10) -> DataFrame:
    """The series of largest absolute bias of each subject, with their `place`."""
    return biases.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.abs("bias")), "series"))).where(F.col("place") <= limit)


def regime_means(values: DataFrame) -> DataFrame:
    """(regime, series_id, mean) from (regime, series_id, value)."""
    return values.groupBy("regime", "series_id").agg(F.avg("value").alias("mean"))


def checked_series(wanted: DataFrame, cached: DataFrame, least: int = 4) -> DataFrame:
    """(profile, series, missing, usable): the wanted series of each profile that are cached, in order, and those that are not."""
    rows = wanted.join(cached.select(F.col("series_id").alias("series"), F.lit(True).alias("here")), "series", "left")
    side = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("series"))))
    out = rows.groupBy("profile").agg(side(F.col("here").isNotNull()).alias("series"), side(F.col("here").isNull()).alias("missing"))
    return out.withColumn("usable", F.size("series") >= least)
