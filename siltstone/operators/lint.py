"""Data-quality rules over notes: those that a row breaks by itself in one projection, the others by one join each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ingest import SENSITIVE

# Kinds of notes by the start of their path.
KINDS = {
    "wiki/source-notes/": "source-note", "wiki/drafts/": "draft-note", "wiki/claims/": "claim-page", "wiki/concepts/": "concept-page", "wiki/entities/": "entity-page",
    "wiki/states/": "state-page", "wiki/regimes/": "regime-page", "wiki/decisions/": "decision-note", "wiki/probabilities/": "probability-page",
    "wiki/memory/daily/": "daily-memory-log", "wiki/memory/weekly/": "weekly-review-page", "wiki/theses/": "thesis-page", "wiki/synthesis/": "synthesis-note",
    "wiki/watch-profiles/": "watch-profile", "wiki/surveillance/": "surveillance-page", "wiki/questions/": "question-page", "wiki/self/principles/": "principle-note",
    "wiki/self/constitution/": "constitution-note", "wiki/self/modes/": "mode-note", "wiki/self/preferences/": "preference-note", "wiki/self/heuristics/": "heuristic-note",
    "wiki/self/anti-patterns/": "anti-pattern-note", "wiki/self/decision-rules/": "decision-rule-note", "wiki/self/portfolio-philosophy/": "portfolio-philosophy-note",
}
# Fields that every kind needs, and more of some.
ALWAYS = ("id", "kind", "title", "status")
SURE = ("confidence",)
NEEDS = {
    "source-note": ("source_type", "ingested_at", "raw_path", "metadata_path"), "concept-page": (), "entity-page": ("entity_type",),
    "claim-page": ("claim_type", "origin_note_path", "confidence", "confidence_score"), "state-page": ("state_label", "confidence"), "regime-page": SURE, "decision-note": SURE,
    "probability-page": ("as_of_date", "profile_id", "confidence"), "draft-note": ("stage", "source_note_path"), "synthesis-note": (), "thesis-page": (),
    "watch-profile": ("priority", "cadence"), "question-page": SURE, "surveillance-page": (), "constitution-note": SURE, "mode-note": SURE, "preference-note": SURE,
    "principle-note": SURE, "heuristic-note": SURE, "anti-pattern-note": SURE, "decision-rule-note": SURE, "portfolio-philosophy-note": SURE,
    "daily-memory-log": ("date", "event_count"), "memory-context-page": ("memory_date", "refresh_basis"), "weekly-review-page": ("week_key", "week_start"),
}
# Sections that kinds must fill.
SECTIONS = {
    "thesis-page": ("Tripwires / Falsifiers",), "principle-note": ("What Would Falsify It",), "portfolio-philosophy-note": ("What Would Falsify It",),
    "state-page": ("Managed Snapshot", "Managed Counter-Arguments", "Managed Data Gaps"), "decision-note": ("Managed Strongest Counter-Case", "Managed Data Gaps"),
    "claim-page": ("Data Gaps / What Would Strengthen It", "Counter-Arguments / Weakening Evidence"),
}
REFERENCES = ("raw_path", "extracted_text_path", "metadata_path", "table_preview_path", "figure_note_path")
ORPHAN_KINDS = ("concept-page", "entity-page", "claim-page", "state-page", "decision-note", "thesis-page", "synthesis-note", "source-note")
RETIRED = ("inactive", "obsolete", "retired", "superseded")
VISUAL_REVIEWS = ("visual_reviewed", "visual-and-text-reviewed", "operator_reviewed")


def kind_of(path: Column) -> Column:
    """Null for index pages and elsewhere."""
    out = F.when(path.rlike(r"/(?:index|README)\.md$") | (path == "wiki/claims/contested.md"), F.lit(None).cast("string"))
    for prefix, kind in KINDS.items():
        out = out.when(path.startswith(prefix), kind)
    return out


def filled(body: Column, heading: str) -> Column:
    """Whether a `## heading` has text under it."""
    safe = "".join(c if c.isalnum() or c == " " else "\\" + c for c in heading)
    return F.regexp_extract(F.coalesce(body, F.lit("")), rf"(?ims)^##\s+{safe}[ \t]*$(.*?)(?=^##\s|\z)", 1).rlike(r"\S")


def _issue(severity: str, rule: str, test: Column, detail: Column | None = None) -> Column:
    said = F.coalesce(detail, F.lit("")) if detail is not None else F.lit("")
    return F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), said.alias("detail")))


def own_issues(notes: DataFrame) -> DataFrame:
    """(severity, rule, path, detail) from (path, kind, fields as a map of strings, body, n_labels, content)."""
    field = lambda name: F.lower(F.trim(F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))))
    has, source = F.col("kind").isNotNull(), F.col("kind") == "source-note"
    review, status = field("review_status"), field("status")
    visual = review.isin(*VISUAL_REVIEWS) | field("review_method").rlike("visual|page image|chart review|rendered pages")
    tests = [_issue("error", "missing frontmatter", has & (F.size("fields") == 0))]
    lacks = lambda name: F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit("")) == ""
    for name in dict.fromkeys([*ALWAYS, *[n for more in NEEDS.values() for n in more]]):
        kinds = [k for k, more in NEEDS.items() if name in ALWAYS or name in more]
        tests.append(_issue("warning", "missing field", F.col("kind").isin(kinds) & lacks(name), F.lit(name)))
    for label, pattern in SENSITIVE.items():
        tests.append(_issue("warning", "sensitive content", F.col("content").rlike(pattern), F.lit(label)))
    tests += [
        _issue("warning", "flagged as sensitive", source & (field("sensitive_data_flagged") == "true")),
        _issue("info", "no concepts or entities", source & (F.col("n_labels") == 0)),
        _issue("warning", "no document class", source & (field("document_class") == "")),
        _issue("info", "no draft note", source & (field("draft_workspace_path") == "")),
        _issue("info", "provisional handoff", source & (field("capture_source") == "codex_pdf_vision_handoff") & (review.isin("", "unreviewed") | (status == "draft"))),
        _issue("warning", "no visual review", source & (field("document_class") == "chartpack_or_visual") & ~visual),
        _issue("warning", "reviewed but draft", source & ~review.isin("", "unreviewed") & (status == "draft")),
        _issue("warning", "low confidence", (F.col("kind") == "claim-page") & (F.coalesce(field("confidence_score").try_cast("double"), F.lit(0.0)) < 0.3)),
    ]
    for kind, headings in SECTIONS.items():
        tests += [_issue("warning", "empty section", (F.col("kind") == kind) & ~filled(F.col("body"), h), F.lit(h)) for h in headings]
    # arrays of a few tests each: one array of all would outgrow what a generated method may hold
    found = F.flatten(F.array(*[F.filter(F.array(*tests[i : i + 8]), lambda x: x.isNotNull()) for i in range(0, len(tests), 8)]))
    return notes.where(~status.isin(*RETIRED)).select("path", F.explode(found).alias("i")).select("i.severity", "i.rule", "path", "i.detail")


def reference_issues(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Source notes' fields that name a file which is not there; `files` has path and whether it holds secrets (`flagged`)."""
    refs = F.filter(F.transform(F.array(*map(F.lit, REFERENCES)), lambda n: F.struct(n.alias("field"), F.try_element_at("fields", n).alias("target"))), lambda r: F.coalesce(r["target"], F.lit("")) != "")
    rows = notes.where((F.col("kind") == "source-note") & ~F.lower(F.coalesce(F.try_element_at("fields", F.lit("status")), F.lit(""))).isin(*RETIRED)).select("path", F.explode(refs).alias("r")).select("path", "r.*")
    met = rows.join(files.select(F.col("path").alias("target"), "flagged"), "target", "left")
    missing = met.where("flagged is null").select(F.lit("error").alias("severity"), F.lit("missing file").alias("rule"), "path", F.col("field").alias("detail"))
    return missing.unionByName(met.where(F.col("flagged") & F.col("field").isin("raw_path", "extracted_text_path", "metadata_path")).select(F.lit("warning").alias("severity"), F.lit("sensitive file").alias("rule"), "path", F.col("field").alias("detail")))


def graph_issues(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Broken links, and notes of linkable kinds that nothing links to; `resolved` has src, target, path."""
    live = notes.where(~F.lower(F.coalesce(F.try_element_at("fields", F.lit("status")), F.lit(""))).isin(*RETIRED))
    broken = resolved.where("path is null").select(F.col("src").alias("path"), "target").distinct().join(live.select("path"), "path", "left_semi")
    linked = resolved.where("path is not null and path <> src").select("path").distinct()
    lonely = live.where(F.col("kind").isin(*ORPHAN_KINDS)).join(linked, "path", "left_anti")
    out = broken.select(F.lit("warning").alias("severity"), F.lit("broken link").alias("rule"), "path", F.col("target").alias("detail"))
    return out.unionByName(lonely.select(F.lit("info").alias("severity"), F.lit("no inbound link").alias("rule"), "path", F.lit("").alias("detail")))


def age_issues(notes: DataFrame) -> DataFrame:
    """Stale notes, and those among them with open threads, from (path, kind, age_days, threshold, n_threads)."""
    stale = notes.where(F.col("age_days") > F.col("threshold"))
    severity = F.when(F.col("kind") == "draft-note", "info").otherwise("warning")
    both = F.filter(F.array(F.struct(severity.alias("severity"), F.lit("stale").alias("rule"), F.col("age_days").cast("string").alias("detail")), F.when(F.col("n_threads") > 0, F.struct(F.lit("warning").alias("severity"), F.lit("stale with open threads").alias("rule"), F.col("n_threads").cast("string").alias("detail")))), lambda x: x.isNotNull())
    return stale.select("path", F.explode(both).alias("i")).select("i.severity", "i.rule", "path", "i.detail")


def tag_issues(rollup: DataFrame) -> DataFrame:
    """Tags that are spelled in several ways."""
    return rollup.where("n_labels > 1").select(F.lit("warning").alias("severity"), F.lit("tag drift").alias("rule"), F.lit("wiki/_indices/tags.md").alias("path"), F.col("tag_key").alias("detail"))
