"""Queries over documents as sources to be digested: takeaways and merged notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import spread
from siltstone.operators import takeaways
from siltstone.plans.tables import table


def note_takeaways(spark, sf_dir):
    """Each document as an extracted text, a bullet a line and a line a sentence, and as its own summary section."""
    d = spread(table(spark, sf_dir, "documents"))
    lines = F.regexp_replace(F.regexp_replace("text", r"\n", "\n- "), r"\. ", ".\n")
    kind = F.when(F.col("doc_id") % 9 == 0, "chartpack_or_visual").otherwise("research_note")
    notes = d.select("doc_id", F.col("source").alias("title"), F.concat(F.lit("## Summary\n"), "text").alias("body"), kind.alias("document_class"), lines.alias("extracted_text"), F.lit(None).cast("string").alias("excerpt"))
    return takeaways.digests(notes).select("doc_id", F.array_join("takeaways", "\n").alias("takeaways"), "summary")


def _in_turn(e: str, rules) -> str:
    for pattern, repl in rules:
        e = f"regexp_replace({e}, '{_q(pattern)}', '{_q(repl).replace('$', chr(92))}', 'g')"
    return e


_q = lambda s: s.replace("'", "''")
_normal = lambda e: f"trim({_in_turn(e, takeaways.REPAIRS)})"
_IGNORED = _q("(?i)" + "|".join(takeaways.IGNORED))


def _cleaned(e: str) -> str:
    plain = f"list_transform({e}, lambda v: trim({_in_turn(_normal(_in_turn('v', takeaways.MARKUP)), takeaways.LEADS)}))"
    said = f"list_filter({plain}, lambda v: v <> '' AND NOT regexp_matches(v, '{_IGNORED}'))"
    two = f"list_transform({said}, lambda v: coalesce(nullif(array_to_string(regexp_extract_all(v, '[^.!?]+[.!?]?')[1:2], ' '), ''), v))"
    tail = _q(takeaways.TAIL)
    return f"list_transform(list_transform({two}, lambda v: trim(regexp_replace(regexp_replace(v, '\\s+', ' ', 'g'), '{tail}', '', 'g'))), lambda v: CASE WHEN regexp_matches(v, '[.!?]$') THEN v ELSE v || '.' END)"


_SKIP = _q("(?mi)(?:" + "|".join(rf"{s}[^\n]*\n?" for s in takeaways.SKIPS) + ")")
_STOP = _q("(?mi)" + "|".join(s if s.endswith("$") else rf"{s}[^\n]*$" for s in (*takeaways.STOPS[:-1], r"^[^\n]*" + takeaways.STOPS[-1])))
_LINES = rf"regexp_replace(regexp_replace({_normal('extracted')}, '\r\n', chr(10), 'g'), '(?m)^[^\S\n]+|[^\S\n]+$', '', 'g')"
_MARK = "[-*•]"
_PARTS = rf"flatten(list_transform(string_split_regex(stopped, '\n{{2,}}'), lambda b: string_split(regexp_replace(b, '\n({_MARK}[^\S\n])', chr(1) || '\1', 'g'), chr(1))))"
_OPENED = rf"list_transform(list_filter({_PARTS}, lambda p: regexp_matches(p, '^\n?{_MARK}[^\S\n]')), lambda p: regexp_replace(regexp_replace(p, '^\n?{_MARK}[^\S\n]+', ''), '\n', ' ', 'g'))"
_WHOLE = rf"trim(regexp_replace(regexp_replace({_normal('said')}, '(?i)^Summary\s*', ''), '\s+', ' ', 'g'))"
_TAKEAWAYS = f"""WITH d AS (SELECT doc_id, source, doc_id % 9 = 0 AS visual, regexp_replace(regexp_replace(text, '\\n', chr(10) || '- ', 'g'), '\\. ', '.' || chr(10), 'g') AS extracted, trim(string_split_regex(text, '(?m)^##\\s')[1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM documents),
s AS (SELECT doc_id, source, visual, regexp_replace(regexp_replace({_LINES}, '{_SKIP}', '', 'g'), '{_STOP}', '', 'g') AS stopped, {_WHOLE} AS whole FROM d),
t AS (SELECT doc_id, source, visual, {_cleaned(_OPENED)} AS taken, ({_cleaned("regexp_extract_all(whole, '[^.!?]+[.!?]?')")})[1:4] AS own FROM s),
u AS (SELECT doc_id, source, {_cleaned("CASE WHEN visual THEN list_concat(own, taken) ELSE list_concat(taken, own) END")} AS x FROM t),
r AS (SELECT doc_id, v, i FROM (SELECT doc_id, v, i, row_number() OVER (PARTITION BY doc_id, lower(v) ORDER BY i) AS nth FROM (SELECT doc_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM u)) WHERE nth = 1),
g AS (SELECT doc_id, list(v ORDER BY i)[1:5] AS x FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(g.x, chr(10)), '') AS takeaways, coalesce(g.x[1], source) AS summary FROM u LEFT JOIN g USING (doc_id)"""


def merged_notes(spark, sf_dir):
    """Eight documents after another as notes on one thing, their lines as blocks."""
    d = spread(table(spark, sf_dir, "documents")).select(F.floor(F.col("doc_id") / 8).alias("thing"), "doc_id", F.regexp_replace("text", r"\n", "\n\n").alias("text"))
    return takeaways.merged_notes(d, "thing", "doc_id", "text").select("thing", "n_blocks", F.sha1("text").alias("text_sha1"))


_MERGED = """WITH b AS (SELECT doc_id // 8 AS thing, doc_id, unnest(x) AS block, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '\\n', chr(10) || chr(10), 'g'), '\\n\\s*\\n'), lambda v: regexp_replace(v, '^\\s+|\\s+$', '', 'g')), lambda v: v <> '') AS x FROM documents)),
f AS (SELECT thing, block, doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY thing, block ORDER BY doc_id, i) AS nth FROM b) WHERE nth = 1)
SELECT thing, count(*) AS n_blocks, sha1(string_agg(block, chr(10) || chr(10) ORDER BY doc_id, i)) AS text_sha1 FROM f GROUP BY thing"""

QUERIES = {"note_takeaways": (note_takeaways, _TAKEAWAYS), "merged_notes": (merged_notes, _MERGED)}
