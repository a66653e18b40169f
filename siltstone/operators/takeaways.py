"""Takeaways: the bullets and sentences of notes and extracted texts, cleaned, once each, and digests made of them.

Lines are not walked one by one: stop lines become blank, skipped lines go, blocks end at blank lines and are cut before each
bullet, and what a bullet does not open is dropped. All of it is array expressions on the row, so no text moves; work grows with
the text's length, as no pattern looks back or repeats a group. Where only the first takeaways count, bullets and sentences are
cleaned one by one until there are enough, and a source that comes second is read only if the first one left room.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import contains_any, pinned, section, strip, truncated

# How text is put right before it is cut, by pattern and replacement, in order.
MARKUP = (
    (r"(?s)```.*?```", " "), (r"`([^`]+)`", "$1"), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"), (r"\[\[([^\]]+)\]\]", "$1"), (r"\[([^\]]+)\]\(([^)]+)\)", "$1"),
    (r"(?m)^>\s*", ""), (r"(?m)^#+\s*", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"[_~]", ""), (r"\r", ""), (r"\n{2,}", "\n\n"),
)
REPAIRS = ((r"â€¢", "- "), (r"â–ª|▪", "- "), (r"â€¦", "..."), (r"â€“|â€”", "-"), (r"â€˜|â€™", "'"), (r"â€œ|â€", '"'), (r"Â", ""), ("\u00a0", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "))
FIRMS = r"[A-Z][A-Za-z&.'-]+(?:\s+[A-Z][A-Za-z&.'-]+){0,5}\s+(?:Inc\.|Corp\.|Corporation|Company|Limited|Ltd\.|Holdings|Group|Technologies|Systems|N\.V\.|SE|Co\.\s*Ltd\.)"
LEADS = (
    (r"^[-*•]\s*", ""), (r"(?i)^Summary\s*", ""), (r"(?i)^com\s+", ""), (r"(?i)Positive \(\+\) or Negative \(-\) Implications", ""), (r"\(\+\)\s*", ""), (r"\(-\)\s*", ""), (r"â–ª|▪", ""),
    (rf"\.\s+{FIRMS}\.?\s+", ". "), (rf"\b{FIRMS}\b(?:\s*\([A-Z.]+\))?", ""), (r"^\.\.\.", ""), (r"\.\.\.$", ""), (r"\s+", " "),
)
TAIL = rf"\s+{FIRMS}\.?$"
IGNORED = (
    r"^Reviewed\b", "reviewed against the extracted text", "use this note for grounded qualitative synthesis", "revisit the raw pdf", "batch-authored by codex", "initial batch capture authored",
    "add image, table, or figure-specific notes", "what concepts should this source strengthen", "what is still ambiguous or unverified", "what is the strongest counter-reading", "metadata path:", "extraction status:",
    "extraction method:", "^key takeaways$", "review lens:", "preserve the raw source as the anchor of truth", "^power bi desktop$", "^thematic research$", "^marketing communication", "^for professional investors only",
    "^distribution:", "^disclaimer:", r"@.+\.", "not intended to be investment advice", "these categorizations represent the current good-faith views",
)
STOPS = (r"^chart \d+:", r"^sources?:", r"^disclaimer:", r"^distribution:", r"page \d+$")
SKIPS = (r"^Positive \(\+\) or Negative \(-\) Implications", r"^\([+-]\)")


def _in_turn(text: Column, rules: tuple) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), rules, text)


def _where(values: Column, holds: str, rules: tuple) -> Column:
    """The rules in turn on each value that holds a character which one of them needs; others are as they would be left."""
    return F.transform(values, lambda v: F.when(v.rlike(holds), _in_turn(v, rules)).otherwise(v))


# How many of the repairs are of broken characters, and what these and marks cannot do without.
BROKEN, BROKEN_HOLD, MARKUP_HOLD = 8, "[âÂ▪\u00a0]", r"[`\[>#*_~\r\n]"


def _normal(values: Column) -> Column:
    return F.transform(_where(values, BROKEN_HOLD, REPAIRS[:BROKEN]), lambda v: F.trim(_in_turn(v, REPAIRS[BROKEN:])))


def normalised(text: Column) -> Column:
    """Broken characters put right, blanks and blank lines reduced."""
    return F.get(_normal(F.array(F.coalesce(text, F.lit("")))), 0)


# What is ignored wherever it stands, as plain text, and by a pattern.
_TOLD = [i for i in IGNORED if i.replace(" ", "").replace("-", "").replace(":", "").isalpha()]
_SHOWN = [i.removeprefix("^") for i in IGNORED if i.startswith("^")]
_OTHER = [i for i in IGNORED if i not in _TOLD and not i.startswith("^")]
_SAID = "(?i)^(?:" + "|".join(_SHOWN) + ")|" + "|".join(_OTHER)


def _ignored(value: Column, low: Column) -> Column:
    """Whether one of IGNORED is in a value: the plain ones are only tried if the lower-case value contains one."""
    return value.rlike(_SAID) | (contains_any(low, [t.lower() for t in _TOLD]) & value.rlike("(?i)" + "|".join(_TOLD)))


def cleaned(values: Column) -> Column:
    """Each takeaway without marks, leads and firms' names, cut to two sentences and ended by a stop; the empty ones go."""
    plain = F.transform(_normal(_where(F.transform(values, lambda v: F.coalesce(v, F.lit(""))), MARKUP_HOLD, MARKUP)), lambda v: F.trim(_in_turn(v, LEADS)))
    pairs = F.transform(plain, lambda v: F.struct(v.alias("v"), F.lower(v).alias("low")))
    said = F.transform(F.filter(pairs, lambda p: (p["v"] != "") & ~_ignored(p["v"], p["low"])), lambda p: p["v"])
    two = F.transform(said, lambda v: F.coalesce(F.nullif(F.array_join(F.slice(F.regexp_extract_all(v, F.lit(r"([^.!?]+[.!?]?)"), F.lit(1)), 1, 2), " "), F.lit("")), v))
    short = F.transform(two, lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"\s+", " "), TAIL, "")))
    return F.transform(short, lambda v: F.when(v.rlike(r"[.!?]$"), v).otherwise(F.concat(v, F.lit("."))))


def _bullets(text: Column, mark: str) -> Column:
    """The stretches of a text with trimmed lines that a bullet opens, up to the next bullet or blank line, each in one line."""
    parts = F.flatten(F.transform(F.split(text, r"\n{2,}"), lambda b: F.split(b, rf"\n(?={mark}[^\S\n])")))
    opened = F.filter(parts, lambda p: p.rlike(rf"^\n?{mark}[^\S\n]"))
    return F.transform(opened, lambda p: F.regexp_replace(F.regexp_replace(p, rf"^\n?{mark}[^\S\n]+", ""), r"\n", " "))


def _trimmed_lines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n", "\n"), r"(?m)^[^\S\n]+|[^\S\n]+$", "")


def _markdown_parts(part: Column) -> Column:
    return _bullets(_trimmed_lines(part), "[-*]")


def markdown_bullets(part: Column) -> Column:
    """Takeaways of the bullets of a note's section; wrapped lines belong to their bullet, nested bullets are bullets."""
    return cleaned(_markdown_parts(part))


def _text_parts(text: Column) -> Column:
    lines = _trimmed_lines(normalised(text))
    lines = F.regexp_replace(lines, "(?mi)(?:" + "|".join(rf"{s}[^\n]*\n?" for s in SKIPS) + ")", "")
    stopped = F.regexp_replace(lines, "(?mi)^(?:(?:" + "|".join(s.removeprefix("^") for s in STOPS[:-1]) + rf")[^\n]*|[^\n]*{STOPS[-1].removesuffix('$')})$", "")
    return _bullets(stopped, "[-*•]")


def text_bullets(text: Column) -> Column:
    """Takeaways of the bullets of an extracted text: captions, sources and page ends stop a bullet, sign lines are passed over."""
    return cleaned(_text_parts(text))


def _first(values: Column, limit: int, made: Callable[[Column], Column], once: bool = True) -> Column:
    """The first `limit` of what `made` makes of each value by itself, `once` without those that differ only in case; later values are not looked at."""
    new = lambda held, v: F.filter(made(F.array(v)), lambda x: ~F.exists(held, lambda h: F.lower(h) == F.lower(x))) if once else made(F.array(v))
    return F.aggregate(values, F.array().cast("array<string>"), lambda held, v: F.when(F.size(held) >= limit, held).otherwise(F.concat(held, new(held, v))))


def sentences(text: Column, limit: int = 4) -> Column:
    """Takeaways of the first sentences."""
    whole = F.trim(F.regexp_replace(F.regexp_replace(normalised(text), r"(?i)^Summary\s*", ""), r"\s+", " "))
    return _first(F.regexp_extract_all(whole, F.lit(r"([^.!?]+[.!?]?)"), F.lit(1)), limit, cleaned, once=False)


def unique(values: Column, limit: int = 6) -> Column:
    """The first `limit` takeaways, of those that differ only in case the first one."""
    return _first(values, limit, cleaned)


def digests(notes: DataFrame, limit: int = 5) -> DataFrame:
    """Notes (title, body, document_class, extracted_text, excerpt, …) with their `takeaways` and a `summary` in one line.

    Visual documents put what the note says before what was extracted, others the extraction first. The summary is the
    first takeaway, else the excerpt, else the title. Null columns are empty ones.
    """
    body = F.col("body")
    twice = lambda v: cleaned(cleaned(v))  # noqa: E731  as takeaways are cleaned by themselves, and again among others
    parts = [_first(_markdown_parts(section(body, heading)), limit, twice) for heading in ("What This Source Says", "Page Route")]
    several = lambda *arrays: _first(F.concat(*arrays), limit, lambda v: v)
    own = several(*parts, unique(sentences(section(body, "Summary")), limit))
    taken = _first(_text_parts(F.col("extracted_text")), limit, twice)
    visual = F.lower(strip(F.coalesce("document_class", F.lit("")))) == "chartpack_or_visual"
    out = pinned(notes, lead=F.when(visual, own).otherwise(taken))
    room = F.size("lead") < limit
    out = pinned(out, rest=F.when(room & visual, taken).when(room, own).otherwise(F.array().cast("array<string>")))
    out = pinned(out, takeaways=several("lead", "rest")).drop("lead", "rest")
    excerpt = F.get(cleaned(F.array(F.coalesce("excerpt", F.lit("")))), 0)
    return out.withColumn("summary", F.coalesce(F.get("takeaways", 0), excerpt, truncated(F.col("title"), 180)))


def preferred(found: DataFrame, group: str, place: str, limit: int = 3) -> DataFrame:
    """(group, takeaways): of each group's digests in their order, those that name no page, or any where all do.

    A takeaway is dealt out by itself: its first place in the group is found first, so copies are one row before the group
    meets, and only `limit` of each kind do.
    """
    rows = found.select(group, F.col(place).alias("at"), F.posexplode(cleaned(F.col("takeaways"))).alias("nth", "takeaway"))
    first = rows.groupBy(group, F.lower("takeaway").alias("k")).agg(F.min(F.struct("at", "nth", "takeaway")).alias("r"))
    paged = F.col("r.takeaway").rlike(r"(?i)^Page \d+")
    near = first.withColumn("paged", paged).withColumn("nth", F.row_number().over(Window.partitionBy(group, "paged").orderBy("r.at", "r.nth"))).where(F.col("nth") <= limit)
    both = near.groupBy(group).agg(*[F.sort_array(F.collect_list(F.when(test, F.col("r")))).alias(c) for c, test in (("plain", ~F.col("paged")), ("all", F.lit(True)))])
    return both.select(group, F.transform(F.when(F.size("plain") > 0, F.col("plain")).otherwise(F.slice("all", 1, limit)), lambda r: r["takeaway"]).alias("takeaways"))


def blocks(text: Column) -> Column:
    """The blocks of a text that blank lines part, trimmed; empty ones go."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), strip), lambda b: b != "")


def merged(*texts: Column) -> Column:
    """Several texts of one row as one: each block once, where it came first."""
    return F.array_join(F.array_distinct(F.concat(*map(blocks, texts))), "\n\n")


def merged_notes(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, text, n_blocks): the notes of each group in order as one text, each block once, where it came first.

    Repeated blocks are reduced to their first place before the blocks of a group meet. Groups without a block have no row.
    """
    parts = rows.select(F.col(group).alias("group"), F.col(order).alias("at"), F.posexplode(blocks(F.col(text))).alias("nth", "block"))
    first = parts.groupBy("group", "block").agg(F.min(F.struct("at", "nth")).alias("place"))
    whole = first.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("place", "block"))).alias("b"))
    return whole.select(F.col("group").alias(group), F.array_join(F.transform("b", lambda b: b["block"]), "\n\n").alias("text"), F.size("b").cast("long").alias("n_blocks"))
