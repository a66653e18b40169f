"""Notes on oneself and small lookups: schemas, applicability, budgets, routing, the latest logs, sections by heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import section, slug, squeeze
from siltstone.operators.ingest import document_class

# Schemas by words of a text, in the order in which they are tried.
SCHEMA_WORDS = {
    "postmortem": ("postmortem", "what went wrong"), "bias": ("bias", "blind spot"), "anti-pattern": ("anti-pattern", "avoid this"), "communication-style": ("communication", "tone", "how to write"),
    "decision-rule": ("decision rule", "sizing rule"), "portfolio-philosophy": ("portfolio", "diversification", "satellite"), "heuristic": ("heuristic", "rule of thumb", "when in doubt"),
    "preference": ("preference",), "mode": ("mode",),
}
# Schemas by folder.
SCHEMA_FOLDERS = {
    "principles": "constitution", "heuristics": "heuristic", "anti-patterns": "anti-pattern", "decision-rules": "decision-rule", "portfolio-philosophy": "portfolio-philosophy",
    "postmortems": "postmortem", "bias-watch": "bias", "communication-style": "communication-style", "constitution": "constitution", "modes": "mode", "preferences": "preference",
}
# topics' hints, and where commands apply.
HINTS = {
    "trading": "trade|trading|entry|exit|stop|second leg|breakout|setup|momentum", "macro": "macro|regime|inflation|rates|yield|oil|energy|geopolitical|growth|recession",
    "valuation": "valuation|wacc|dcf|multiple|terminal value|intrinsic value", "coding": "code|coding|repo|refactor|test|implementation|bug",
}
_BROAD, _SHORT, _ALL = ("investment", "macro", "valuation", "writing"), ("investment", "macro", "writing"), ("global", "writing")
APPLIES = {
    "ask": _ALL, "report": _BROAD, "decision-note": _BROAD, "meeting-brief": _BROAD, "red-team": _BROAD, "state-refresh": _BROAD, "regime-brief": _BROAD,
    "probability-brief": ("investment", "macro", "valuation", "trading", "writing"), "what-changed-for-markets": _SHORT, "why-believe": _BROAD, "deck": _SHORT, "surveil": _SHORT,
    "watch": _SHORT, "reflect": _ALL, "principles": _ALL, "postmortem": _ALL, "frontier-pack": _BROAD,
}
# Budgets by mode of a question.
BUDGETS = {"index": "L0", "map": "L1", "brief": "L1", "deep": "L3", "red_team": "L3"}


def inferred_schema(path: Column, text: Column, explicit: Column) -> Column:
    """What is said, else what the folder says, else the first schema whose words occur, else constitution."""
    low = F.lower(F.concat_ws("\n", F.regexp_extract(path, "([^/]+)$", 1), text))
    folder = F.regexp_extract(path, "^wiki/self/([^/]+)/", 1)
    said = F.lower(F.trim(F.coalesce(explicit, F.lit(""))))
    out = F.when(said.isin(*dict.fromkeys(SCHEMA_FOLDERS.values())), said)
    for name, schema in SCHEMA_FOLDERS.items():
        out = out.when(folder == name, schema)
    for schema, words in SCHEMA_WORDS.items():
        out = out.when(F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w)), schema)
    return out.otherwise("constitution")


def applicability(command: Column, topic: Column) -> Column:
    """Where a command applies, what its topic hints at, and everywhere."""
    base = F.coalesce(F.element_at(F.create_map(*[x for k, v in APPLIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), command), F.array(*map(F.lit, _ALL)))
    low = F.lower(F.coalesce(topic, F.lit("")))
    hints = F.filter(F.array(*[F.when(low.rlike(p), name) for name, p in HINTS.items()]), lambda h: h.isNotNull())
    return F.array_distinct(F.concat(base, hints, F.array(F.lit("global"))))


def budget(mode: Column, asked: Column | None = None) -> Column:
    """The budget that is asked for where it is one, else the mode's."""
    own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in BUDGETS.items() for x in p]), F.lower(F.trim(F.coalesce(mode, F.lit(""))))), F.lit("L2"))
    if asked is None:
        return own
    said = F.upper(F.trim(F.coalesce(asked, F.lit(""))))
    return F.when(said.isin("L0", "L1", "L2", "L3"), said).otherwise(own)


def routed(notes: DataFrame) -> DataFrame:
    """Notes (title, source_type, text, document_class, draft_path, id) with the class and the draft's path filled where they lack."""
    own = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    found = document_class(F.coalesce(own("source_type"), F.lit("note")), F.concat_ws("\n", "title", "text"))
    stem = F.coalesce(F.nullif(F.substring(slug(F.col("title")), 1, 80), F.lit("")), F.col("id"))
    return notes.withColumns({"document_class": F.coalesce(own("document_class"), found), "draft_path": F.coalesce(own("draft_path"), F.concat(F.lit("wiki/drafts/append-review/"), stem, F.lit(".md")))})


def latest_names(files: DataFrame, pattern: str, limit: int = 1) -> DataFrame:
    """The last files by name whose name fits: dated logs, weekly reviews, snapshots."""
    return files.where(F.regexp_extract("path", "([^/]+)$", 1).rlike(f"(?i){pattern}")).orderBy(F.desc("path")).limit(limit)


def section_heads(body: Column, headings: list[str], size: int = 600) -> Column:
    """heading: the head of its text in one line, for headings that have any."""
    each = F.array(*[F.struct(F.lit(h).alias("key"), F.substring(squeeze(section(body, h)), 1, size).alias("value")) for h in headings])
    return F.map_from_entries(F.filter(each, lambda e: e["value"] != ""))
