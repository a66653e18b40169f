"""Queries over documents as notes: indexes, registers, concepts, ledger inputs, intake, watch lists, reports and lint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import STOPWORDS, concept_label, phrase_count, pinned, slug, squeeze, truncated
from siltstone.operators import claims, concepts, ingest, intake, knowledge, lint, quant, retrieval, rules, selfnotes, watch
from siltstone.plans import corpus
from siltstone.plans.corpus import DOWN, ONTOLOGY, UP, documents

#: Folders that documents are dealt to by their number.
FOLDERS = ["wiki/source-notes/", "wiki/concepts/", "wiki/reports/", "outputs/memos/", "wiki/theses/", "wiki/states/"]
TYPES = ["paper", "image", "dataset", "web", ""]
TERMS = [*ONTOLOGY, "thing"]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: labels and titles from their first words, the other fields from their number."""
    d = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    d = pinned(d, b=concept_label(F.col("text")))
    d = pinned(d, w=F.split("b", " "))
    w = lambda *places: F.concat_ws(" ", *[F.get("w", F.lit(i)) for i in places])
    n = F.col("doc_id")
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), (n % k).cast("int"))
    number = F.lpad(n.cast("string"), 9, "0")
    return d.select(
        "doc_id", "text", "source", F.concat(pick(FOLDERS, 6), number, F.lit(".md")).alias("path"), w(0, 1, 2).alias("title"),
        F.array(w(0, 1), w(2), F.upper(w(0, 1)), w(3, 4, 5)).alias("concepts"), F.array(w(1, 2), w(4), F.concat_ws(" ", F.lit("january"), w(0)), w(1, 2)).alias("candidates"),
        F.array(F.col("source"), F.upper("lang"), F.concat("source", F.lit(" desk"))).alias("entities"), pick(TYPES, 5).alias("source_type"),
        F.when(n % 9 == 0, "chartpack_or_visual").when(n % 9 == 1, "").otherwise("research_note").alias("document_class"), pick(["", "unreviewed", " Text_Reviewed ", "visual_reviewed"], 4).alias("review_status"),
        F.when(n % 11 == 0, "retired").when(n % 11 == 1, "draft").otherwise("active").alias("status"), F.when(n % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (n % 400).cast("int")).cast("string")).alias("date"),
        F.when(n % 5 != 2, F.concat(F.lit("extracted/text/"), number, F.lit(".txt"))).alias("extracted_text_path"), F.col("b").alias("label"),
    )


_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_w = lambda *places: "concat_ws(' ', " + ", ".join(f"w[{i + 1}]" for i in places) + ")"
_label = lambda e: f"array_to_string(regexp_extract_all(lower({e}), '[a-z0-9]+'), ' ')"
_NOTES = f"""n AS MATERIALIZED (SELECT doc_id, text, source, {_list(FOLDERS)}[doc_id % 6 + 1] || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' AS path, {_w(0, 1, 2)} AS title,
[{_w(0, 1)}, {_w(2)}, upper({_w(0, 1)}), {_w(3, 4, 5)}] AS concepts, [{_w(1, 2)}, {_w(4)}, concat_ws(' ', 'january', {_w(0)}), {_w(1, 2)}] AS candidates, [source, upper(lang), source || ' desk'] AS entities,
{_list(TYPES)}[doc_id % 5 + 1] AS source_type, CASE doc_id % 9 WHEN 0 THEN 'chartpack_or_visual' WHEN 1 THEN '' ELSE 'research_note' END AS document_class, ['', 'unreviewed', ' Text_Reviewed ', 'visual_reviewed'][doc_id % 4 + 1] AS review_status,
CASE doc_id % 11 WHEN 0 THEN 'retired' WHEN 1 THEN 'draft' ELSE 'active' END AS status, CASE WHEN doc_id % 4 <> 0 THEN CAST(CAST(DATE '2024-01-01' + CAST(doc_id % 400 AS INT) AS DATE) AS VARCHAR) END AS date,
CASE WHEN doc_id % 5 <> 2 THEN 'extracted/text/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt' END AS extracted_text_path, b AS label FROM (SELECT *, string_split(b, ' ') AS w FROM (SELECT *, {_label('text')} AS b FROM documents)))"""

_in = lambda w, values: f"{w} IN (" + ", ".join(f"'{v}'" for v in values) + ")"
_empty = lambda w: f"({_in(w, [*STOPWORDS, *concepts.MONTHS, *concepts.GENERIC])} OR regexp_matches({w}, '^[0-9]+$') OR {w} = '')"
_some = lambda k, test: f"len(list_filter(string_split({k}, ' '), lambda q: {test('q')})) > 0"


def _is_concept(k: str, lone: bool = True) -> str:
    alone, first, last, n = [t for t in TERMS if " " not in t], f"split_part({k}, ' ', 1)", f"split_part({k}, ' ', -1)", f"len(string_split({k}, ' '))"
    single = f"(NOT {_empty(k)} AND ({_in(k, [*alone, *concepts.SINGLE])} OR {f'length({k}) >= 5' if lone else 'false'}))"
    stub = lambda w: f"length({w}) = 1 OR (length({w}) = 2 AND NOT regexp_matches({w}, '[0-9]') AND NOT {_in(w, [*concepts.SHORT, *alone])}) OR {_in(w, [*concepts.MONTHS, *concepts.ABBREVIATIONS])}"
    full = lambda w: f"NOT {_empty(w)}"
    phrase = f"({n} <= 4 AND NOT {_in(first, STOPWORDS)} AND NOT {_in(last, STOPWORDS)} AND NOT ({_some(k, stub)}) AND 2 * len(list_filter(string_split({k}, ' '), lambda q: length(q) <= 3)) <= {n} AND {_some(k, full)})"
    return f"(CASE WHEN {k} = '' THEN false WHEN {_in(k, TERMS)} THEN true WHEN {_some(k, lambda w: _in(w, [*concepts.NEVER, *concepts.STRUCTURE]))} THEN false WHEN {n} = 1 THEN {single} ELSE {phrase} END)"


_candidate = lambda k: f"({_is_concept(k, False)} AND NOT ({_some(k, lambda w: f'length({w}) = 1 OR ' + _in(w, concepts.NOISE))}))"
_INDEX = f"""{_NOTES}, lr AS (SELECT path, i, v, {_label('v')} AS k FROM (SELECT path, unnest(concepts) AS v, generate_subscripts(concepts, 1) AS i FROM n)), ix AS (SELECT v AS label, path FROM (SELECT *, row_number() OVER (PARTITION BY path, k ORDER BY i) AS r FROM lr WHERE k <> '') WHERE r = 1 AND {_is_concept('k')})"""


def concept_index(spark, sf_dir):
    return knowledge.concept_index(notes(spark, sf_dir), TERMS).groupBy("label").agg(F.count("*").alias("n_notes"), F.min("path").alias("first_note"))


_CONCEPT_INDEX = f"WITH {_INDEX} SELECT label, count(*) AS n_notes, min(path) AS first_note FROM ix GROUP BY label"


def source_index(spark, sf_dir):
    return knowledge.source_index(notes(spark, sf_dir)).select("source_type", F.col("place").cast("long").alias("place"), "path", "title")


_SOURCE_INDEX = f"WITH {_NOTES} SELECT t AS source_type, row_number() OVER (PARTITION BY t ORDER BY title, path) AS place, path, title FROM (SELECT *, CASE WHEN source_type = '' THEN 'unknown' ELSE source_type END AS t FROM n)"


def candidate_frequency(spark, sf_dir):
    return concepts.candidate_counts(notes(spark, sf_dir), TERMS)


_FREQUENCY = f"WITH {_NOTES}, c AS (SELECT {_label('v')} AS label_key FROM (SELECT unnest(candidates) AS v FROM n)) SELECT label_key, count(*) AS n FROM c WHERE {_candidate('label_key')} GROUP BY label_key"


def contradiction_candidates(spark, sf_dir):
    """Over sources and languages, as few concepts are shared by invented prose."""
    n = notes(spark, sf_dir).withColumn("summary", truncated(squeeze(F.col("text")), 240))
    out = knowledge.contradiction_candidates(knowledge.entity_index(n), n, UP, DOWN)
    return out.select("label", "n_notes", "n_positive", "n_negative", F.array_join("positives", ",").alias("positives"), F.array_join("negatives", ",").alias("negatives"))


_flat = "regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
_CONTRADICTIONS = f"""WITH {_NOTES}, s AS (SELECT path, entities, lower(CASE WHEN length(f) <= 240 THEN f ELSE regexp_replace(substr(f, 1, 239), '\\s+$', '') || '…' END) AS t FROM (SELECT *, {_flat} AS f FROM n)),
e AS (SELECT unnest(entities) AS label, path, {' OR '.join(f"contains(t, '{x}')" for x in UP)} AS up, {' OR '.join(f"contains(t, '{x}')" for x in DOWN)} AS down FROM s),
g AS (SELECT label, count(*) AS n_notes, count(*) FILTER (WHERE up) AS n_positive, count(*) FILTER (WHERE down) AS n_negative, array_to_string(list_sort(list(path) FILTER (WHERE up))[1:3], ',') AS positives, array_to_string(list_sort(list(path) FILTER (WHERE down))[1:3], ',') AS negatives FROM e GROUP BY label)
SELECT * FROM g WHERE n_notes >= 2 AND n_positive > 0 AND n_negative > 0"""


def synthesis_candidates(spark, sf_dir):
    return knowledge.synthesis_candidates(knowledge.concept_index(notes(spark, sf_dir), TERMS))


_SYNTHESIS = f"WITH {_INDEX} SELECT label, count(*) AS n_notes FROM ix GROUP BY label HAVING count(*) >= 3"


def unresolved_registers(spark, sf_dir):
    n = notes(spark, sf_dir)
    bare = F.col("doc_id") % 7 == 3
    nothing = F.array().cast("array<string>")
    return knowledge.unresolved(n.withColumns({"concepts": F.when(bare, nothing).otherwise(F.col("concepts")), "entities": F.when(bare, nothing).otherwise(F.col("entities"))}))


_UNRESOLVED = f"WITH {_NOTES} SELECT 'extraction' AS register, path FROM n WHERE extracted_text_path IS NULL UNION ALL SELECT 'classification', path FROM n WHERE doc_id % 7 = 3"


def collection_counts(spark, sf_dir):
    return knowledge.collection_counts(notes(spark, sf_dir).withColumn("kind", F.coalesce(lint.kind_of(F.col("path")), F.lit("other"))))


_kind = lambda p: "CASE " + " ".join(f"WHEN starts_with({p}, '{k}') THEN '{v}'" for k, v in lint.KINDS.items()) + " END"
_COLLECTIONS = f"WITH {_NOTES} SELECT coalesce({_kind('path')}, 'other') AS kind, count(*) AS n_notes, count(*) FILTER (WHERE status <> 'retired') AS n_active FROM n GROUP BY 1"


def _claims(spark, sf_dir) -> DataFrame:
    """Every claim of each document, with labels from its first words and measures from its size."""
    u = corpus._units(spark, sf_dir)
    u = pinned(u, c=F.split(concept_label(F.col("claim_text")), " "))
    two = F.concat_ws(" ", F.get("c", F.lit(0)), F.get("c", F.lit(1)))
    size, n = F.length("claim_text"), F.col("doc_id")
    folder = F.get(F.array(*map(F.lit, FOLDERS)), (n % 6).cast("int"))
    status = F.get(F.array(*map(F.lit, ["active", "contested", "stale"])), size % 3)
    return u.select(F.concat_ws("-", "doc_id", "unit").alias("id"), "source", "claim_text", F.concat(folder, F.lpad(n.cast("string"), 9, "0"), F.lit(".md")).alias("origin"), F.array(two).alias("concepts"), F.array("source").alias("entities"), (size % 10 / 10.0).cast("double").alias("score"), F.when(n % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (n % 400).cast("int")).cast("string")).alias("date"), status.alias("status"), F.when(size % 2 == 0, "fact").otherwise("estimate").alias("kind"), (size % 4).alias("n_sources"))


_CLAIMS = f"""{corpus._PLACED}, cm AS MATERIALIZED (SELECT doc_id || '-' || unit AS id, source, claim_text, {_list(FOLDERS)}[doc_id % 6 + 1] || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' AS origin, concat_ws(' ', c[1], c[2]) AS concept, (length(claim_text) % 10)::DOUBLE / 10.0::DOUBLE AS score,
CASE WHEN doc_id % 4 <> 0 THEN CAST(CAST(DATE '2024-01-01' + CAST(doc_id % 400 AS INT) AS DATE) AS VARCHAR) END AS date, ['active', 'contested', 'stale'][length(claim_text) % 3 + 1] AS status, CASE WHEN length(claim_text) % 2 = 0 THEN 'fact' ELSE 'estimate' END AS kind, length(claim_text) % 4 AS n_sources
FROM (SELECT *, string_split({_label('claim_text')}, ' ') AS c FROM units))"""


def claim_hints(spark, sf_dir):
    return knowledge.claim_hints(_claims(spark, sf_dir))


_HINTS = f"WITH {_CLAIMS}, e AS (SELECT origin AS path, id, 'concept' AS kind, concept AS label FROM cm UNION ALL SELECT origin, id, 'entity', source FROM cm) SELECT path, kind, {_label('label')} AS label_key, max_by(label, id) AS label FROM e WHERE {_label('label')} <> '' GROUP BY ALL"


def page_claims(spark, sf_dir):
    """The first eight claims of every concept."""
    c = _claims(spark, sf_dir)
    return knowledge.page_claims(c, F.col("concepts"), 8).withColumn("place", F.col("place").cast("long"))


_PAGE_CLAIMS = f"WITH {_CLAIMS} SELECT label_key, id, place FROM (SELECT concept AS label_key, id, row_number() OVER (PARTITION BY concept ORDER BY score DESC, coalesce(date, '') DESC, id) AS place FROM cm WHERE concept <> '') WHERE place <= 8"


def ledger_order(spark, sf_dir):
    out = knowledge.ledger_order(_claims(spark, sf_dir))
    return out.groupBy("origin").agg(F.count("*").alias("n"), F.max(F.when(F.col("place") == 1, F.col("id"))).alias("first_id"))


_LEDGER_ORDER = f"WITH {_CLAIMS} SELECT origin, count(*) AS n, min(id) AS first_id FROM cm GROUP BY origin"


def ledger_counts(spark, sf_dir):
    return knowledge.ledger_counts(_claims(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 6))


_LEDGER_COUNTS = f"WITH {_CLAIMS} SELECT status, kind, count(*) AS n, round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE n_sources <= 1) AS n_thin FROM cm GROUP BY ALL"


def claim_counters(spark, sf_dir):
    c = claims.polar(corpus._claims(spark, sf_dir)).select("id", "keys", "words", "polarity", "strength").cache()
    return claims.against(c).select("id", F.col("place").cast("long").alias("place"), "other")


_COUNTERS = f"""WITH {corpus._EDGES}, ag AS (SELECT dst AS id, src AS other FROM edges WHERE relation IN ('contradicts', 'weakens') UNION SELECT src, dst FROM edges WHERE relation = 'contradicts')
SELECT id, place, other FROM (SELECT ag.id, other, row_number() OVER (PARTITION BY ag.id ORDER BY strength DESC, other) AS place FROM ag JOIN cr ON cr.id = other) WHERE place <= 4"""


def note_concepts(spark, sf_dir):
    n = notes(spark, sf_dir)
    n = n.select("path", "title", F.concat_ws("\n", "title", "source").alias("routing"), F.concat_ws("\n", "title", "text").alias("whole"), "concepts", "candidates")
    hints = knowledge.claim_hints(_claims(spark, sf_dir)).where("kind = 'concept'").select("path", "label")
    return concepts.note_concepts(n, hints, TERMS).select("path", "label_key", "label", "score", F.col("place").cast("long").alias("place"))


_pad = lambda e: f"(' ' || {e} || ' ')"
_times = lambda text: f"CASE WHEN k = '' THEN 0 ELSE CAST((length({_pad(text)}) - length(replace({_pad(text)}, {_pad('k')}, ''))) / length({_pad('k')}) AS INT) END"
_NOTE_CONCEPTS = f"""WITH {_CLAIMS}, {_NOTES}, h AS ({_HINTS[_HINTS.index('SELECT path, kind'):].replace('FROM e', "FROM (SELECT origin AS path, id, 'concept' AS kind, concept AS label FROM cm) e")}),
b AS (SELECT path, {_label('title')} AS t, {_label("title || chr(10) || source")} AS r, {_label("title || chr(10) || text")} AS w, concepts, candidates FROM n),
x AS (SELECT path, t, r, w, 'chosen' AS kind, 0 AS src, i, trim(v) AS label, {_label('v')} AS k FROM (SELECT *, unnest(concepts) AS v, generate_subscripts(concepts, 1) AS i FROM b) UNION ALL SELECT path, t, r, w, 'term', 2, 0, term, term FROM b, (VALUES {', '.join(f"('{t}')" for t in TERMS)}) o(term) WHERE contains({_pad('r')}, {_pad('term')})
UNION ALL SELECT path, t, r, w, 'candidate', 3, i, trim(v), {_label('v')} FROM (SELECT *, unnest(candidates) AS v, generate_subscripts(candidates, 1) AS i FROM b)),
fq AS ({_FREQUENCY[_FREQUENCY.index(', c AS') + 2:].replace('c AS (', 'SELECT label_key AS k, count(*) AS corpus FROM (', 1).replace(") SELECT label_key, count(*) AS n FROM c WHERE", ") WHERE")}),
y AS (SELECT x.*, coalesce(corpus, 0) AS corpus, {_in('x.k', TERMS)} AS listed, contains({_pad('t')}, {_pad('x.k')}) AS titled FROM x LEFT JOIN fq ON x.k = fq.k), z AS (SELECT *, {_times('r')} AS ir, {_times('w')} AS iw FROM y),
sc AS (SELECT path, k, label, src, i, CASE kind WHEN 'chosen' THEN CASE WHEN listed OR titled OR ir >= 1 OR iw >= 2 THEN 100 + CASE WHEN titled THEN 10 ELSE 0 END + least(ir, 2) * 8 + least(iw, 3) * 4 END WHEN 'term' THEN 60 ELSE CASE WHEN {_candidate('k')} AND (listed OR titled OR iw >= 2) THEN 20 + CASE WHEN listed THEN 18 ELSE 0 END + CASE WHEN titled THEN 14 ELSE 0 END + least(iw, 3) * 6 + least(corpus, 3) * 4 END END AS score FROM z UNION ALL SELECT path, {_label('label')}, label, 1, 0, 90 FROM h),
g AS (SELECT path, k AS label_key, CAST(max(score) AS BIGINT) AS score, arg_min(label, src * 1000 + i) AS label FROM sc WHERE score IS NOT NULL AND {_is_concept('k')} GROUP BY path, k)
SELECT path, label_key, label, score, place FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, label_key) AS place FROM g) WHERE place <= 8"""


def source_chronology(spark, sf_dir):
    return knowledge.chronology(notes(spark, sf_dir)).select("place", "date", "path", "source_type")


_CHRONOLOGY = f"WITH {_NOTES} SELECT row_number() OVER (ORDER BY date, path) AS place, date, path, CASE WHEN source_type = '' THEN 'source' ELSE source_type END AS source_type FROM n WHERE date IS NOT NULL"


def knowledge_pages(spark, sf_dir):
    n = notes(spark, sf_dir)
    return knowledge.label_pages(knowledge.concept_index(n, TERMS), n).withColumn("related", F.array_join("related", ","))


_PAGES = f"""WITH {_INDEX}, d AS (SELECT ix.label AS label, count(*) AS n_notes, min(date) AS first_date, max(date) AS last_date FROM ix JOIN n USING (path) GROUP BY 1),
r AS (SELECT label, count(*) AS n_related, array_to_string(list_sort(list(other))[1:12], ',') AS related FROM (SELECT DISTINCT ix.label AS label, unnest(entities) AS other FROM ix JOIN n USING (path)) GROUP BY label) SELECT label, n_notes, coalesce(n_related, 0) AS n_related, coalesce(related, '') AS related, first_date, last_date FROM d LEFT JOIN r USING (label)"""


def retired_pages(spark, sf_dir):
    """Concept pages of last year's notes whose concept no note of this year has."""
    n = notes(spark, sf_dir)
    pages = knowledge.concept_index(n.where("date < '2024-09-01'"), TERMS).select("label").distinct().select("label", slug(F.col("label")).alias("page"), F.lit("active").alias("status"))
    return knowledge.retired(pages, knowledge.concept_index(n.where("date >= '2024-09-01'"), TERMS), "label")


_RETIRED = f"WITH {_INDEX} SELECT DISTINCT ix.label AS label, replace(lower(ix.label), ' ', '-') AS page, 'retired' AS status FROM ix JOIN n USING (path) WHERE date < '2024-09-01' AND ix.label NOT IN (SELECT ix.label FROM ix JOIN n USING (path) WHERE date >= '2024-09-01')"


def claim_gate(spark, sf_dir):
    n = knowledge.claim_inputs(notes(spark, sf_dir))
    gate = knowledge.gives_claims(F.col("path"), F.col("review_status"), F.col("source_type"), F.col("document_class"))
    return n.select("path", gate.alias("gives"), F.array_join(knowledge.claim_sections(F.col("path")), ";").alias("sections"))


_SECTIONS = "CASE " + " ".join(f"WHEN starts_with(path, '{k}') THEN '{';'.join(v)}'" for k, v in knowledge.CLAIM_SECTIONS.items()) + " ELSE '' END"
_GATE = f"WITH {_NOTES} SELECT path, NOT (starts_with(path, 'wiki/source-notes/') AND trim(lower(review_status)) = 'unreviewed' AND (source_type = 'image' OR document_class = 'chartpack_or_visual')) AS gives, {_SECTIONS} AS sections FROM n WHERE status <> 'retired'"

_EXTENSIONS = ["pdf", "MD", "html", "csv", "png", "zip", "txt", "xyz"]


def source_types(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = F.concat_ws("/", "p_brand", F.concat_ws(".", F.regexp_replace("p_name", " ", "-"), F.get(F.array(*map(F.lit, _EXTENSIONS)), F.col("p_partkey").cast("int") % 8)))
    kind = intake.source_type(path, F.col("p_size") == 1)
    return o.select(kind.alias("source_type"), intake.raw_folder(kind).alias("folder")).groupBy("source_type", "folder").agg(F.count("*").alias("n"))


_SOURCE_TYPES = f"""SELECT t AS source_type, CASE t {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in intake.FOLDERS.items())} END AS folder, count(*) AS n FROM (SELECT CASE WHEN p_size = 1 THEN 'repo' ELSE ['paper', 'article', 'web', 'dataset', 'image', 'repo', 'note', 'note'][p_partkey % 8 + 1] END AS t FROM part) GROUP BY ALL"""


def repo_snapshots(spark, sf_dir):
    """Orders as folders, their lines as files: the part's number gives name, extension and depth."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.col("l_partkey")
    name = F.when(k % 97 == 0, "package.json").when(k % 13 == 0, "README.md").when(k % 3 == 0, F.concat(F.lit("m"), k.cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("d"), k.cast("string"), F.lit(".txt")))
    files = li.select(F.col("l_orderkey").alias("folder"), F.concat(F.repeat(F.lit("sub/"), (F.col("l_suppkey") % 4).cast("int")), name).alias("path"))
    return intake.repositories(files).select("folder", "n_files", F.col("n_code").cast("long").alias("n_code"), "has_readme", "is_repo")


_REPOS = """WITH f AS (SELECT l_orderkey AS folder, l_suppkey % 4 AS level, l_partkey % 97 = 0 AS marker, l_partkey % 97 <> 0 AND l_partkey % 13 = 0 AS readme, l_partkey % 97 <> 0 AND l_partkey % 13 <> 0 AND l_partkey % 3 = 0 AS code FROM lineitem),
g AS (SELECT folder, count(*) AS n_files, CAST(sum(CASE WHEN marker THEN 2 WHEN code THEN 1 ELSE 0 END) AS BIGINT) AS n_code, bool_or(readme) AS has_readme, bool_or(marker AND level = 0) AS marked FROM f WHERE level <= 2 GROUP BY folder) SELECT folder, n_files, n_code, has_readme, marked OR n_code >= 5 OR (has_readme AND n_code >= 2) AS is_repo FROM g"""


def sidecar_override(spark, sf_dir):
    """Pages as extractions, whose odd numbers have a sidecar with a text, a blank or a status only."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = p.select(F.col("page_id").alias("path"), F.substring_index("html", "<", 2).alias("extracted_text"), F.lit("partial").alias("extraction_status"), F.lit("html").alias("extraction_method"))
    said = F.get(F.array(F.concat(F.lit(" "), F.col("url"), F.lit(" ")), F.lit("  ")), (F.col("page_id") % 4 / 2).cast("int"))
    side = p.where("page_id % 2 = 1").select(F.col("page_id").alias("path"), said.alias("extracted_text"), F.when(F.col("page_id") % 3 == 0, "checked").alias("extraction_status"), F.lit("").alias("extraction_method"))
    return intake.with_sidecars(rows, side).select("path", F.sha1("extracted_text").alias("text_sha1"), "extraction_status", "extraction_method")


_SIDECARS = """SELECT page_id AS path, sha1(CASE WHEN own THEN trim(url) ELSE array_to_string(string_split(html, '<')[1:2], '<') END) AS text_sha1, CASE WHEN page_id % 2 = 1 AND page_id % 3 = 0 THEN 'checked' WHEN own THEN 'extracted' ELSE 'partial' END AS extraction_status, CASE WHEN own THEN 'llm_vision_handoff' ELSE 'html' END AS extraction_method
FROM (SELECT *, page_id % 4 = 1 AS own FROM pages)"""


def source_summary(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", intake.summary(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("summary"))


_par = "list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\r?\\n\\r?\\n'), lambda p: regexp_replace(regexp_replace(p, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')"
_SUMMARY = f"SELECT doc_id, nullif(CASE WHEN length(s) <= 420 THEN s ELSE regexp_replace(substr(s, 1, 419), '\\s+$', '') || '…' END, '') AS summary FROM (SELECT doc_id, regexp_replace(array_to_string(({_par})[1:2], ' '), '^\\s+|\\s+$', '', 'g') AS s FROM documents)"


def dataset_preview(spark, sf_dir):
    """Customers of each nation and segment as delimited text of two columns, tabs in every other nation."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    mark = F.when(F.col("c_nationkey") % 2 == 0, "\t").otherwise(",")
    line = F.concat(F.col("c_name"), mark, F.lit(" "), F.col("c_custkey").cast("string"))
    text = c.groupBy("c_nationkey", "c_mktsegment").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"), F.first(mark).alias("m"))
    return text.select("c_nationkey", "c_mktsegment", intake.dataset_preview(F.concat(F.lit("name"), "m", F.lit("key\n"), "body")).alias("preview"))


_PREVIEW = """WITH r AS (SELECT c_nationkey, c_mktsegment, c_name AS a, CAST(c_custkey AS VARCHAR) AS b, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_name || CASE WHEN c_nationkey % 2 = 0 THEN chr(9) ELSE ',' END || ' ' || c_custkey) AS i FROM customer),
f AS (SELECT * FROM r WHERE i <= 5 UNION ALL SELECT DISTINCT c_nationkey, c_mktsegment, 'name', 'key', 0 FROM r), w AS (SELECT c_nationkey, c_mktsegment, greatest(3, max(length(a))) AS wa, greatest(3, max(length(b))) AS wb FROM f GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, string_agg('| ' || rpad(a, CAST(wa AS INT), ' ') || ' | ' || rpad(b, CAST(wb AS INT), ' ') || ' |' || CASE WHEN i = 0 THEN chr(10) || '| ' || repeat('-', wa) || ' | ' || repeat('-', wb) || ' |' ELSE '' END, chr(10) ORDER BY i) AS preview FROM f JOIN w USING (c_nationkey, c_mktsegment) GROUP BY ALL"""


def review_states(spark, sf_dir):
    n = notes(spark, sf_dir)
    status, review = intake.reviewed_defaults(F.col("status"), F.col("review_status"), F.col("document_class"))
    return n.select(intake.review_status(F.col("review_status")).alias("given"), intake.note_status(F.col("review_status")).alias("note_status"), status.alias("status"), F.trim(review).alias("review")).groupBy("given", "note_status", "status", "review").agg(F.count("*").alias("n"))


_REVIEWS = f"""WITH {_NOTES}, r AS (SELECT CASE WHEN trim(review_status) = '' THEN 'unreviewed' ELSE trim(lower(review_status)) END AS given, status IN ('draft', 'active') OR trim(review_status) IN ('', 'unreviewed') AS applies, * FROM n)
SELECT given, CASE WHEN given = 'unreviewed' THEN 'draft' ELSE 'reviewed' END AS note_status, CASE WHEN applies THEN 'reviewed' ELSE status END AS status, CASE WHEN applies THEN CASE WHEN document_class = 'chartpack_or_visual' THEN 'visual-and-text-reviewed' ELSE 'text_reviewed' END ELSE trim(review_status) END AS review, count(*) AS n FROM r GROUP BY ALL"""


def suppressed_hits(spark, sf_dir):
    """Hits of two scans of the documents, each once; every third document is a public web page."""
    hits = ingest.sensitive_hits(documents(spark, sf_dir), "doc_id", "text").select(F.col("doc_id").alias("source"), "label", "line", "preview")
    merged = intake.merged_hits(hits, hits.where("source % 2 = 0"))
    return intake.hit_summary(merged.where(~intake.suppressed(F.col("label"), F.col("source") % 3 == 0)), "source")


_SUPPRESSED = corpus._SECRETS.replace("SELECT doc_id, label, count(*) AS n_lines, min(n) AS first_line FROM h GROUP BY ALL", f"SELECT doc_id AS source, string_agg(label || ':' || c, ', ' ORDER BY label || ':' || c) AS summary FROM (SELECT doc_id, label, count(DISTINCT n) AS c FROM h WHERE NOT (doc_id % 3 = 0 AND {_in('label', intake.WEB_SUPPRESSED)}) GROUP BY ALL) GROUP BY doc_id")


def legacy_rollover(spark, sf_dir):
    """Orders of a customer as timestamped files of one slug; some customers have a canonical file already."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    files = o.select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("slug"), F.col("o_orderdate").alias("stamp"), ((F.col("o_custkey") % 5 == 0) & (F.col("o_orderkey") % 4 == 0)).alias("is_canonical"))
    return intake.rolled_over(files)


_ROLLOVER = """WITH f AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_custkey AS slug, o_orderdate AS stamp, o_custkey % 5 = 0 AND o_orderkey % 4 = 0 AS canon FROM orders), g AS (SELECT slug, bool_or(canon) AS has FROM f GROUP BY slug)
SELECT slug, path, CASE WHEN place = 1 AND NOT has THEN 'canonical' ELSE 'archive' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY stamp DESC, path DESC) AS place FROM f WHERE NOT canon) JOIN g USING (slug)"""


def catalog_upsert(spark, sf_dir):
    """Orders of the first years, and later ones that replace their customer's row."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus")
    return intake.upserted(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 = 0"), "o_custkey", "o_orderkey")


_UPSERT = "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 = 0 DESC, o_orderkey DESC) AS place FROM orders) WHERE place = 1"


def curated_export(spark, sf_dir):
    return intake.exported(notes(spark, sf_dir).select("path", "title"), ["WIKI/", "outputs/"], ["wiki/States/", "outputs/memos/0000001"])


_EXPORT = f"WITH {_NOTES} SELECT path, title FROM n WHERE (starts_with(path, 'wiki/') OR starts_with(path, 'outputs/')) AND NOT starts_with(path, 'wiki/states/') AND NOT starts_with(path, 'outputs/memos/0000001')"


_ascii = lambda e: f"regexp_replace({e}, '[^\\x00-\\x7F]', 'x', 'g')"


def entity_names(spark, sf_dir):
    """Capitalised names in every whole text, its first one as the topic; other scripts' letters stand as x."""
    d = documents(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("text"))
    topic = F.regexp_extract("text", r"^(\w+)", 1)
    return d.select("doc_id", F.array_join(concepts.entity_names(F.col("text"), topic), "|").alias("names"))


_ENTITIES = f"""WITH t AS (SELECT doc_id, {_ascii('text')} AS text FROM documents), r AS (SELECT doc_id, lower(regexp_extract(text, '^(\\w+)', 1)) AS topic, unnest(x) AS name, generate_subscripts(x, 1) AS i FROM (SELECT *, regexp_extract_all(text, '\\b(?:[A-Z][a-z]+|[A-Z]{{2,}})(?:\\s+(?:[A-Z][a-z]+|[A-Z]{{2,}}))*\\b') AS x FROM t)),
g AS (SELECT doc_id, slug, arg_min(name, i) AS name, min(i) AS i FROM (SELECT *, lower(regexp_replace(name, '\\s+', '-', 'g')) AS slug FROM r) WHERE length(name) > 2 AND slug <> regexp_replace(topic, '_+', '-', 'g') GROUP BY ALL), k AS (SELECT doc_id, list(name ORDER BY i)[1:12] AS names FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(names, '|'), '') AS names FROM documents LEFT JOIN k USING (doc_id)"""

_ALIASES = [("wiki/watch-profiles/a.md", "Brand#1", ["brand-2", "Acme"]), ("wiki/watch-profiles/b.md", "brand 3", ["Brand2!"]), ("wiki/watch-profiles/c.md", "Brand3", [])]


def exact_watch_profile(spark, sf_dir):
    profiles = spark.createDataFrame(_ALIASES, "path string, title string, aliases array<string>")
    subjects = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.regexp_replace("p_brand", "#", " #").alias("subject")).distinct()
    return watch.exact_profiles(subjects, profiles)


_slug = lambda e: f"regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace({e}, '[^A-Za-z0-9_\\s-]', '', 'g'))), '[_\\s]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"
_PROFILE = f"""WITH p(path, name) AS (VALUES {', '.join(f"('{p}', '{n}')" for p, t, a in _ALIASES for n in [t, *a])}), k AS (SELECT {_slug('name')} AS k, min(path) AS path FROM p GROUP BY 1)
SELECT subject, path FROM (SELECT DISTINCT replace(p_brand, '#', ' #') AS subject FROM part) JOIN k ON k.k = {_slug('subject')}"""


def watch_profiles(spark, sf_dir):
    """Nations' profiles from suppliers, brought up to date from customers; inactive ones are left out."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    n = F.broadcast(read("nation"))
    none = F.array().cast("array<string>")
    held = read("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("title"), "n_nationkey").agg(F.count("*").alias("c"))
    held = held.select("title", F.array("title", F.lit("desk")).alias("aliases"), F.array(F.lit("suppliers")).alias("entities"), none.alias("concepts"), F.array(F.lit("")).alias("risk_triggers"), F.when(F.col("n_nationkey") % 7 == 0, "inactive").otherwise("").alias("status"), F.lit("high").alias("priority"), F.lit(None).cast("string").alias("cadence"))
    given = read("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.lower("n_name").alias("title")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    given = given.select("title", F.array(F.lit("desk"), "title").alias("aliases"), none.alias("entities"), "segments", none.alias("risk_triggers"), F.lit("").alias("status"), F.lit("").alias("priority"), F.lit("weekly").alias("cadence")).withColumnRenamed("segments", "concepts")
    out = watch.active_profiles(watch.updated_profiles(held, given))
    return out.select("k", "title", *[F.array_join(c, ",").alias(c) for c in watch.LISTS], *watch.DEFAULTS)


_WATCH = """WITH h AS (SELECT DISTINCT n_name AS t, n_nationkey AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey), g AS (SELECT lower(n_name) AS t, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT k, title, aliases, entities, concepts, '' AS risk_triggers, status, priority, cadence FROM (SELECT regexp_replace(lower(coalesce(h.t, g.t)), '[_ ]', '-', 'g') AS k, coalesce(g.t, h.t) AS title, CASE WHEN h.t IS NULL THEN 'desk,' || g.t WHEN g.t IS NULL THEN h.t || ',desk' ELSE h.t || ',desk,' || g.t END AS aliases, CASE WHEN h.t IS NULL THEN '' ELSE 'suppliers' END AS entities, coalesce(seg, '') AS concepts,
CASE WHEN h.id % 7 = 0 THEN 'inactive' ELSE 'active' END AS status, CASE WHEN h.t IS NULL THEN 'medium' ELSE 'high' END AS priority, CASE WHEN g.t IS NULL THEN 'ad-hoc' ELSE 'weekly' END AS cadence FROM h FULL JOIN g ON lower(h.t) = g.t) WHERE status <> 'inactive'"""

_ASKED = ["wiki/concepts/000000007", "000000012.md", "WIKI\\states\\000000005.md", "00013", "nothing here", "source-notes/000000006"]


def crystallize_target(spark, sf_dir):
    asked = spark.createDataFrame([(a,) for a in _ASKED], "asked string")
    return watch.best_targets(asked, notes(spark, sf_dir)).select("asked", "path", F.col("score").cast("long").alias("score"), "ambiguous")


_TARGETS = f"""WITH {_NOTES}, a(asked, q) AS (VALUES {', '.join(f"('{x}', '{x.replace(chr(92), '/').lower()}')" for x in _ASKED)}), m AS (SELECT asked, path, CASE WHEN lower(path) = q OR lower(path) = q || '.md' THEN 100 WHEN replace(split_part(lower(path), '/', -1), '.md', '') = q OR lower(title) = q OR replace(lower(title), ' ', '-') = q THEN 90
WHEN ends_with(lower(path), '/' || q) OR ends_with(lower(path), '/' || q || '.md') THEN 80 WHEN contains(lower(path), q) OR contains(lower(title), q) THEN 60 END AS score FROM n, a)
SELECT asked, min(path) AS path, score, count(*) > 1 AS ambiguous FROM (SELECT *, max(score) OVER (PARTITION BY asked) AS top FROM m WHERE score IS NOT NULL) WHERE score = top GROUP BY asked, score"""

#: Sections of a report: what they ask for, and whether charts serve them.
_PLAN = [("first", "thing", True), ("second", "ertion", False), ("third", "qqqq", False)]


def section_coverage(spark, sf_dir):
    """The report's sections with their best notes, and how well they are covered."""
    n = notes(spark, sf_dir)
    ranked = None
    for key, word, charts in _PLAN:
        score = watch.section_priority(F.regexp_count("label", F.lit(word)), F.col("title"), F.col("path"), F.col("document_class"), word, charts)
        rows = n.where(F.col("label").contains(word)).select(F.lit(key).alias("section"), "path", score.alias("score"), (F.col("path").startswith("wiki/source-notes/") | F.col("path").startswith("outputs/memos/")).alias("is_evidence"), intake.review_status(F.col("review_status")).isin("text_reviewed", "visual_reviewed").alias("reviewed"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    best = watch.section_results(ranked, 5).join(ranked.select("section", "path", "reviewed"), ["section", "path"])
    sections = spark.createDataFrame([(k,) for k, _, _ in _PLAN], "section string")
    return watch.coverage(sections, best)


_COVERAGE = f"""WITH {_NOTES}, r AS ({' UNION ALL '.join(f"SELECT '{k}' AS section, path, len(string_split(label, '{w}')) - 1 + CASE WHEN contains(title, '{w}') THEN 12 ELSE 0 END + CASE WHEN starts_with(path, 'wiki/source-notes/') THEN 3 ELSE 0 END + CASE WHEN document_class = 'chartpack_or_visual' THEN {2 if c else -10} ELSE 0 END AS score, starts_with(path, 'wiki/source-notes/') OR starts_with(path, 'outputs/memos/') AS ev, review_status IN (' Text_Reviewed ', 'visual_reviewed') AS reviewed FROM n WHERE contains(label, '{w}')" for k, w, c in _PLAN)}),
u AS (SELECT r.*, count(*) FILTER (WHERE ev) OVER (PARTITION BY section) AS m FROM r), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, path) AS place FROM u WHERE ev OR m < 3) WHERE place <= 5),
c AS (SELECT section, count(*) AS n_results, count(*) FILTER (WHERE reviewed) AS n_reviewed, count(*) FILTER (WHERE NOT reviewed) AS n_provisional FROM b GROUP BY section)
SELECT section, coalesce(n_results, 0) AS n_results, coalesce(n_reviewed, 0) AS n_reviewed, coalesce(n_provisional, 0) AS n_provisional, CASE WHEN coalesce(n_results, 0) = 0 THEN 'uncovered' WHEN n_results < 3 THEN 'thin' ELSE 'covered' END AS state FROM (VALUES {', '.join(f"('{k}')" for k, _, _ in _PLAN)}) s(section) LEFT JOIN c USING (section)"""


def state_gaps(spark, sf_dir):
    """Subjects as sources: how many claims, notes and stale claims they have, every third without a watch profile."""
    c = _claims(spark, sf_dir).groupBy(F.col("source").alias("subject")).agg(F.count("*").alias("n_claims"), F.count_if(F.col("status") == "stale").alias("n_stale"))
    d = documents(spark, sf_dir).groupBy(F.col("source").alias("subject")).agg(F.count("*").alias("n_evidence"))
    k = F.regexp_extract("subject", r"(\d+)", 1).cast("int")
    out = watch.state_gaps(c.join(d, "subject").select("subject", "n_claims", "n_stale", "n_evidence", (k % 2 == 0).alias("escalated"), (k % 3 != 0).alias("watched")))
    return out.withColumn("gaps", F.array_join("gaps", ","))


_GAPS = f"""WITH {_CLAIMS}, c AS (SELECT source AS subject, count(*) AS nc, count(*) FILTER (WHERE status = 'stale') AS ns FROM cm GROUP BY 1), d AS (SELECT source AS subject, count(*) AS ne FROM documents GROUP BY 1)
SELECT subject, concat_ws(',', CASE WHEN nc < 3 THEN 'claims' END, CASE WHEN ne < 3 THEN 'evidence' END, CASE WHEN CAST(regexp_extract(subject, '([0-9]+)', 1) AS INT) % 2 = 0 THEN 'route' END, CASE WHEN CAST(regexp_extract(subject, '([0-9]+)', 1) AS INT) % 3 = 0 THEN 'watch' END, CASE WHEN ns > 0 THEN 'stale' END) AS gaps FROM c JOIN d USING (subject)"""


def lead_claims(spark, sf_dir):
    c = _claims(spark, sf_dir).withColumn("polarity", F.when(F.length("claim_text") % 5 == 0, "negative").otherwise("neutral"))
    return watch.lead_claims(c, "source").withColumn("place", F.col("place").cast("long"))


_LEADS = f"WITH {_CLAIMS}, r AS (SELECT source, id, score, CASE WHEN status = 'contested' THEN 'contested' WHEN length(claim_text) % 5 = 0 THEN 'negative' END AS role FROM cm) SELECT source, id, place, role FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY role, score DESC, id) AS place FROM r WHERE role IS NOT NULL) WHERE place <= 4"


def report_claims(spark, sf_dir):
    c = _claims(spark, sf_dir).select("id", "claim_text", F.col("score").alias("claim_score"))
    return watch.report_claims(c, 12, "thth|onthe").select("id", "claim_score")


_REPORT_CLAIMS = f"WITH {_CLAIMS} SELECT id, score AS claim_score FROM cm WHERE NOT regexp_matches(claim_text, '(?i)thth|onthe') ORDER BY score DESC, id LIMIT 12"


def compact_lines(spark, sf_dir):
    """The first lines of every document in short."""
    return documents(spark, sf_dir).select("doc_id", F.array_join(watch.compact_lines(F.col("text"), 4), "|").alias("lines"))


#: What plain Markdown leaves out of a line, by pattern and replacement.
_MARKS = (("^\\s*[-*]\\s+", ""), ("^\\s*\\d+\\.\\s+", ""), ("(?s)```.*?```", " "), ("!\\[[^\\]]*\\]\\([^)]*\\)", " "), ("\\[([^\\]]+)\\]\\([^)]*\\)", "\\1"), ("\\[\\[([^\\]|]+)\\|([^\\]]+)\\]\\]", "\\2"), ("\\[\\[([^\\]]+)\\]\\]", "\\1"), ("`([^`]*)`", "\\1"), ("(?m)^#{1,6}\\s+", ""), ("(?m)^>\\s?", ""), ("[*_~]{1,3}", ""), ("\\s+", " "), ("^\\s+|\\s+$", ""))
_line = "x"
for _p, _r in _MARKS:
    _line = f"regexp_replace({_line}, '{_p}', '{_r}', 'g')"
_COMPACT = f"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: {_line}), lambda x: x <> '') AS x FROM documents)),
f AS (SELECT doc_id, line, min(i) AS i FROM l GROUP BY ALL), k AS (SELECT doc_id, list(line ORDER BY i)[1:4] AS x FROM f GROUP BY doc_id) SELECT doc_id, coalesce(array_to_string(k.x, '|'), '') AS lines FROM documents LEFT JOIN k USING (doc_id)"""

_COMMANDS = {"click": "ingest", "view": "report", "purchase": "watch", "signup": "search", "error": "claims-refresh"}


def memory_events(spark, sf_dir):
    """Events as commands: the value is the count, the user the topic of packs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    command = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in _COMMANDS.items() for x in p]), F.col("event_type")), F.lit("compile"))
    topic = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit(" user "), F.col("user_id").cast("string")))
    out = e.select(command.alias("command"), watch.event_summary(command, F.floor("value"), topic, F.lit(None).cast("string")).alias("summary"))
    return out.where("summary is not null").groupBy("command", "summary").agg(F.count("*").alias("n"))


_for = "CASE WHEN user_id % 3 <> 0 THEN ' for user ' || user_id ELSE '' END"
_MEMORY = f"""SELECT command, summary, count(*) AS n FROM (SELECT command, CASE command WHEN 'ingest' THEN 'Ingested ' || CAST(floor(value) AS BIGINT) || ' file(s) into the knowledge base.' WHEN 'report' THEN 'Prepared a report pack' || {_for} || '.' WHEN 'watch' THEN 'Prepared a watch authored pack' || {_for} || '.' WHEN 'claims-refresh' THEN 'Refreshed the claim ledger with ' || CAST(floor(value) AS BIGINT) || ' claim(s).'
WHEN 'compile' THEN '{watch.SAYS['compile']}' END AS summary FROM (SELECT *, coalesce(CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _COMMANDS.items())} END, 'compile') AS command FROM events)) WHERE summary IS NOT NULL GROUP BY ALL"""


def recent_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts")
    return watch.recent(e, ["ts", "event_id"], 12).select("event_id", "event_type")


_RECENT = "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 12"


def scenario_labels(spark, sf_dir):
    """Customers' orders as histories: their span, how sure a model of them is, and two formats."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    g = o.groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"), F.count("*").alias("n"), F.max("o_totalprice").alias("most"))
    return g.select("o_custkey", watch.model_confidence(F.col("days"), F.col("n") % 3).alias("confidence"), watch.percent(F.round(F.col("n") / 64, 6)).alias("share"), watch.basis_points(F.when(F.col("n") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("n") / 8)).alias("drift"))


_SCENARIO = """SELECT o_custkey, CASE WHEN days >= 756 AND n % 3 = 0 THEN 'high' WHEN days >= 504 THEN 'medium-high' WHEN days >= 252 THEN 'medium' ELSE 'low' END AS confidence, printf('%.1f%%', round(round(n / 64.0::DOUBLE, 6) * 100, 1)) AS share, CASE WHEN n % 5 = 0 THEN 'n/a' ELSE printf('%.1f bp/day', round(n / 8.0::DOUBLE, 1)) END AS drift
FROM (SELECT o_custkey, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS days, count(*) AS n FROM orders GROUP BY 1)"""


def largest_biases(spark, sf_dir):
    """The ten lines of largest signed discount of each supplier."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = li.groupBy("l_suppkey", F.col("l_partkey").alias("series")).agg(F.sum(F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))).alias("bias"))
    return watch.largest_biases(rows, "l_suppkey").withColumn("place", F.col("place").cast("long"))


_BIASES = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(bias) DESC, series) AS place FROM (SELECT l_suppkey, l_partkey AS series, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS bias FROM lineitem GROUP BY ALL)) WHERE place <= 10"


def regime_means(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return watch.regime_means(o.select(F.col("o_orderstatus").alias("regime"), F.col("o_orderpriority").alias("series_id"), F.col("o_totalprice").alias("value"))).withColumn("mean", F.round("mean", 4))


_REGIMES = "SELECT o_orderstatus AS regime, o_orderpriority AS series_id, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL"


def checked_series(spark, sf_dir):
    """Nations of a region as its wanted series; those with suppliers of a balance over 9000 are cached."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    wanted = read("nation").select(F.col("n_regionkey").alias("profile"), F.col("n_name").alias("series"))
    cached = read("supplier").where("s_acctbal > 9000").join(F.broadcast(read("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("series_id")).distinct()
    return watch.checked_series(wanted, cached).select("profile", F.array_join("series", ",").alias("series"), F.array_join("missing", ",").alias("missing"), "usable")


_CHECKED = "WITH c AS (SELECT DISTINCT n_name AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000) SELECT n_regionkey AS profile, coalesce(string_agg(n_name, ',' ORDER BY n_name) FILTER (WHERE s IS NOT NULL), '') AS series, coalesce(string_agg(n_name, ',' ORDER BY n_name) FILTER (WHERE s IS NULL), '') AS missing, count(s) >= 4 AS usable FROM nation LEFT JOIN c ON s = n_name GROUP BY 1"


def lint_rules(spark, sf_dir):
    """All rules over the notes: fields that their number leaves out, files that are not there, links by their first words."""
    n = notes(spark, sf_dir)
    k = F.col("doc_id")
    path = F.when(k % 6 == 1, F.concat(F.lit("wiki/claims/"), F.lpad(k.cast("string"), 9, "0"), F.lit(".md"))).otherwise(F.col("path"))
    some = lambda name, value, test: F.when(test, F.struct(F.lit(name).alias("key"), value.alias("value")))
    fields = F.array(some("id", k.cast("string"), k % 2 == 0), some("kind", F.lit("x"), F.lit(True)), some("title", F.col("title"), k % 5 != 0), some("status", F.col("status"), k % 7 != 0), some("source_type", F.col("source_type"), F.lit(True)), some("review_status", F.col("review_status"), F.lit(True)), some("document_class", F.col("document_class"), F.lit(True)), some("raw_path", F.concat(F.lit("raw/"), (k % 10).cast("string")), k % 3 == 0), some("confidence", F.lit("high"), k % 4 == 0), some("confidence_score", (k % 10 / 10.0).cast("string"), k % 3 != 1), some("capture_source", F.lit("codex_pdf_vision_handoff"), k % 8 == 0))
    own = F.map_from_entries(F.filter(fields, lambda x: x.isNotNull()))
    body = F.concat(F.lit("## Managed Snapshot\n"), F.when(k % 4 == 1, "text").otherwise(" "), F.lit("\n## Managed Data Gaps\nx\n"))
    rows = n.select(path.alias("path"), F.when(k % 17 == 0, F.create_map().cast("map<string,string>")).otherwise(own).alias("fields"), body.alias("body"), F.col("text").alias("content"), (k % 3).cast("int").alias("n_labels"), (k % 500).alias("age_days"), F.lit(400).alias("threshold"), (k % 2).alias("n_threads"), "label", "doc_id")
    rows = rows.withColumn("kind", lint.kind_of(F.col("path")))
    files = spark.range(5).select(F.concat(F.lit("raw/"), F.col("id").cast("string")).alias("path"), (F.col("id") % 2 == 0).alias("flagged"))
    heads = rows.select("path", F.substring_index("label", " ", 1).alias("head"))
    names = heads.groupBy("head").agg(F.max("path").alias("to"))
    links = rows.select(F.col("path").alias("src"), F.when(F.col("doc_id") % 2 == 0, F.substring_index("label", " ", 1)).otherwise(F.concat(F.lit("none-"), F.col("doc_id").cast("string"))).alias("target"))
    resolved = links.join(names, F.col("target") == F.col("head"), "left").select("src", "target", F.col("to").alias("path"))
    every = lint.own_issues(rows).unionByName(lint.reference_issues(rows, files)).unionByName(lint.graph_issues(rows, resolved)).unionByName(lint.age_issues(rows))
    tags = spark.createDataFrame([("a", 2), ("b", 1)], "tag_key string, n_labels int")
    return every.unionByName(lint.tag_issues(tags)).groupBy("severity", "rule", "detail").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


def _lint_sql() -> str:
    f = {"id": "CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END", "kind": "'x'", "title": "CASE WHEN doc_id % 5 <> 0 THEN title END", "status": "CASE WHEN doc_id % 7 <> 0 THEN status END", "source_type": "source_type", "review_status": "review_status", "document_class": "document_class", "raw_path": "CASE WHEN doc_id % 3 = 0 THEN 'raw/' || doc_id % 10 END", "confidence": "CASE WHEN doc_id % 4 = 0 THEN 'high' END", "confidence_score": "CASE WHEN doc_id % 3 <> 1 THEN CAST(doc_id % 10 / 10.0 AS VARCHAR) END", "capture_source": "CASE WHEN doc_id % 8 = 0 THEN 'codex_pdf_vision_handoff' END"}
    cols = ", ".join(f"coalesce(CASE WHEN doc_id % 17 <> 0 THEN {e} END, '') AS f_{k}" for k, e in f.items())
    parts = [("error", "'missing frontmatter'", "''", "kind IS NOT NULL AND doc_id % 17 = 0")]
    for name in dict.fromkeys([*lint.ALWAYS, *[x for more in lint.NEEDS.values() for x in more]]):
        kinds = [k for k, more in lint.NEEDS.items() if name in lint.ALWAYS or name in more]
        parts.append(("warning", "'missing field'", f"'{name}'", f"{_in('kind', kinds)}" + (f" AND f_{name} = ''" if name in f else "")))
    for label, pattern in ingest.SENSITIVE.items():
        quoted = pattern.replace("'", "''")
        parts.append(("warning", "'sensitive content'", f"'{label}'", f"regexp_matches(text, '{quoted}')"))
    source, review = "kind = 'source-note'", "trim(lower(f_review_status))"
    parts += [("info", "'no concepts or entities'", "''", f"{source} AND doc_id % 3 = 0"), ("warning", "'no document class'", "''", f"{source} AND f_document_class = ''"), ("info", "'no draft note'", "''", source),
              ("info", "'provisional handoff'", "''", f"{source} AND f_capture_source <> '' AND ({review} IN ('', 'unreviewed') OR f_status = 'draft')"), ("warning", "'no visual review'", "''", f"{source} AND f_document_class = 'chartpack_or_visual' AND {review} <> 'visual_reviewed'"),
              ("warning", "'reviewed but draft'", "''", f"{source} AND {review} NOT IN ('', 'unreviewed') AND f_status = 'draft'"), ("warning", "'low confidence'", "''", "kind = 'claim-page' AND coalesce(try_cast(f_confidence_score AS DOUBLE), 0) < 0.3")]
    has = {"Managed Snapshot": "doc_id % 4 = 1", "Managed Data Gaps": "true"}
    for kind, headings in lint.SECTIONS.items():
        parts += [("warning", "'empty section'", f"'{h}'", f"kind = '{kind}' AND NOT ({has.get(h, 'false')})") for h in headings]
    own = " UNION ALL ".join(f"SELECT '{s}' AS severity, {r} AS rule, path, {d} AS detail FROM live WHERE {t}" for s, r, d, t in parts)
    orphan = _in("kind", lint.ORPHAN_KINDS)
    return f"""WITH {_NOTES}, m AS (SELECT *, {cols}, {_kind('path')} AS kind FROM (SELECT * REPLACE (CASE WHEN doc_id % 6 = 1 THEN 'wiki/claims/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' ELSE path END AS path) FROM n)), live AS (SELECT * FROM m WHERE f_status NOT IN ('inactive', 'obsolete', 'retired', 'superseded')),
nm AS (SELECT split_part(label, ' ', 1) AS head, max(path) AS dest FROM m GROUP BY 1), lk AS (SELECT path AS src, CASE WHEN doc_id % 2 = 0 THEN split_part(label, ' ', 1) ELSE 'none-' || doc_id END AS target FROM m), rs AS (SELECT src, target, dest FROM lk LEFT JOIN nm ON target = head),
i AS ({own} UNION ALL SELECT 'error', 'missing file', path, 'raw_path' FROM live WHERE {source} AND f_raw_path <> '' AND CAST(substr(f_raw_path, 5) AS INT) >= 5 UNION ALL SELECT 'warning', 'sensitive file', path, 'raw_path' FROM live WHERE {source} AND f_raw_path <> '' AND CAST(substr(f_raw_path, 5) AS INT) < 5 AND CAST(substr(f_raw_path, 5) AS INT) % 2 = 0
UNION ALL SELECT 'warning', 'broken link', src, target FROM (SELECT DISTINCT src, target FROM rs WHERE dest IS NULL) WHERE src IN (SELECT path FROM live) UNION ALL SELECT 'info', 'no inbound link', path, '' FROM live WHERE {orphan} AND path NOT IN (SELECT dest FROM rs WHERE dest IS NOT NULL AND dest <> src)
UNION ALL SELECT CASE WHEN kind = 'draft-note' THEN 'info' ELSE 'warning' END, 'stale', path, CAST(doc_id % 500 AS VARCHAR) FROM m WHERE doc_id % 500 > 400 UNION ALL SELECT 'warning', 'stale with open threads', path, '1' FROM m WHERE doc_id % 500 > 400 AND doc_id % 2 > 0 UNION ALL SELECT 'warning', 'tag drift', 'wiki/_indices/tags.md', 'a')
SELECT severity, rule, detail, count(*) AS n, min(path) AS first_path FROM i GROUP BY ALL"""


def claim_stance(spark, sf_dir):
    c = _claims(spark, sf_dir)
    return c.groupBy("source", claims.stance(F.col("claim_text"), UP, DOWN).alias("stance")).agg(F.count("*").alias("n"))


_held = lambda words: "(" + " + ".join(f"CAST(contains(lower(claim_text), '{w}') AS INT)" for w in words) + ")"
_STANCE = f"WITH {_CLAIMS} SELECT source, CASE WHEN {_held(DOWN)} > {_held(UP)} THEN 'weakening' ELSE 'supportive' END AS stance, count(*) AS n FROM cm GROUP BY ALL"


def phrase_counts(spark, sf_dir):
    d = pinned(documents(spark, sf_dir).select("source", "text"), b=concept_label(F.col("text")))
    counts = [F.sum(phrase_count(F.col("b"), F.lit(t))).alias(f"n_{i}") for i, t in enumerate(TERMS)]
    return d.groupBy("source").agg(*counts)


_occurs = lambda t: f"CAST(sum(CAST((length({_pad('b')}) - length(replace({_pad('b')}, ' {t} ', ''))) / {len(t) + 2} AS INT)) AS BIGINT)"
_PHRASE_COUNTS = f"SELECT source, {', '.join(f'{_occurs(t)} AS n_{i}' for i, t in enumerate(TERMS))} FROM (SELECT source, {_label('text')} AS b FROM documents) GROUP BY source"


def claim_search(spark, sf_dir):
    c = _claims(spark, sf_dir).select("id", "claim_text", F.col("origin").alias("origin_title"), "status", F.col("score").alias("confidence_score"))
    asked = retrieval.query_tokens(corpus.QUERY)
    return claims.search_claims(c, asked, "thing", 24, ("active", "stale")).select("id", F.round("claim_score", 6).alias("claim_score"))


def _search_sql() -> str:
    asked = retrieval.query_tokens(corpus.QUERY)
    words = " + ".join(f"len(list_filter(t, lambda x: x = '{a}')) + CASE WHEN contains(lower(origin), '{a}') THEN 2 ELSE 0 END" for a in asked)
    return f"""WITH {_CLAIMS}, s AS (SELECT id, score * 6::DOUBLE + {words} + CASE WHEN contains(lower(claim_text), 'thing') THEN 8 ELSE 0 END + CASE status WHEN 'stale' THEN -2 ELSE 0 END AS claim_score FROM (SELECT *, {corpus._TOKENS.format('claim_text')} AS t FROM cm) WHERE status IN ('active', 'stale'))
SELECT id, round(claim_score, 6) AS claim_score FROM s WHERE claim_score > 0 ORDER BY s.claim_score DESC, id LIMIT 24"""


def stale_reviews(spark, sf_dir):
    """Orders as rules: reviewed when ordered, with a trigger unless the priority is low; the last order is the present."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    last = o.agg(F.max("o_orderdate").alias("as_of"))
    rows = o.select("o_orderkey", F.col("o_orderdate").alias("reviewed_at"), F.when(F.col("o_orderpriority").startswith("5"), "").otherwise(F.col("o_orderpriority")).alias("review_trigger"))
    found = rules.stale_reviews(rows.crossJoin(F.broadcast(last)), F.col("as_of"), 700)
    return found.groupBy("review_trigger").agg(F.count("*").alias("n"), F.max("age_days").alias("oldest"))


_STALE = "SELECT o_orderpriority AS review_trigger, count(*) AS n, max(age) AS oldest FROM (SELECT *, CAST(floor((epoch((SELECT max(o_orderdate) FROM orders)) - epoch(o_orderdate)) / 86400) AS BIGINT) AS age FROM orders) WHERE o_orderpriority[1] <> '5' AND age >= 700 GROUP BY 1"

_COMPOSITES = list(quant.ORDER)


def regime_order(spark, sf_dir):
    """Days of orders in four regimes by the day's number, with composites by the order's."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice")
    labels = o.select("date", (F.datediff("date", F.lit("1990-01-01").cast("date")) % 4).alias("regime")).distinct()
    name = F.get(F.array(*map(F.lit, _COMPOSITES)), (F.col("o_orderkey") % len(_COMPOSITES)).cast("int"))
    composites = o.groupBy("date", name.alias("composite")).agg((F.avg("o_totalprice") / 1e6).alias("ret"))
    return quant.regime_order(labels, composites).withColumn("place", F.col("place").cast("long"))


_ORDER = f"""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, {_list(_COMPOSITES)}[o_orderkey % {len(_COMPOSITES)} + 1] AS composite, avg(o_totalprice) / 1e6::DOUBLE AS ret FROM orders GROUP BY ALL), l AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) % 4 AS INT) AS regime FROM orders),
m AS (SELECT regime, composite, avg(ret) AS m FROM l JOIN o USING (date) GROUP BY ALL), s AS (SELECT regime, sum(m * CASE composite {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in quant.ORDER.items())} END) AS score FROM m GROUP BY regime) SELECT regime, row_number() OVER (ORDER BY score DESC, regime) - 1 AS place FROM s"""


def regime_labels(spark, sf_dir):
    """Parts' numbers as mean composites of regimes, and the names that these get."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    part = lambda a, b: ((k * a) % b - F.floor(F.lit(b) / 2)) / 10000.0
    label = quant.regime_label(part(7, 23), part(5, 19), part(3, 29), part(11, 31), part(13, 17), k % 4, "north-asia-ai-hardware")
    return p.select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n"))


_part = lambda a, b: f"((p_partkey * {a}) % {b} - {b // 2}) / 10000.0::DOUBLE"
_REGIME_LABELS = f"""WITH c AS (SELECT p_partkey % 4 AS place, {_part(7, 23)} AS risk, {_part(5, 19)} AS def, {_part(3, 29)} AS hw, {_part(11, 31)} AS na, {_part(13, 17)} AS en FROM part)
SELECT CASE WHEN na > 0.0005::DOUBLE AND hw > 0.0007::DOUBLE THEN 'North Asia hardware leadership' WHEN risk > 0.0005::DOUBLE AND def < 0.0002::DOUBLE AND en <= 0.0002::DOUBLE THEN CASE WHEN hw > 0.0005::DOUBLE THEN 'Risk-on disinflation / hardware leadership' ELSE 'Risk-on disinflation' END WHEN risk < -0.0003::DOUBLE AND en > 0.0004::DOUBLE THEN 'Inflation shock / energy squeeze' WHEN risk < -0.0003::DOUBLE AND def > 0.0003::DOUBLE THEN 'Growth scare / duration bid'
WHEN risk > 0.0003::DOUBLE AND en > 0.0004::DOUBLE THEN 'Reflation / higher-rate risk-on' WHEN hw > 0.0005::DOUBLE AND risk >= -0.0002::DOUBLE THEN 'Selective hardware leadership' WHEN def > 0.0004::DOUBLE AND risk >= -0.0002::DOUBLE THEN 'Defensive carry / slower growth' ELSE 'Cross-asset regime ' || (place + 1) END AS label, count(*) AS n FROM c GROUP BY ALL"""


_SELF = ["wiki/self/heuristics/", "wiki/self/", "wiki/self/modes/", "notes/"]
_SAYS = ["", " BIAS ", "unknown"]


def self_schemas(spark, sf_dir):
    """Documents as notes on oneself: their own words, their folders and what they say by their number."""
    d = documents(spark, sf_dir).select("doc_id", "text")
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % k).cast("int"))
    path = F.concat(pick(_SELF, 4), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select(selfnotes.inferred_schema(path, F.col("text"), pick(_SAYS, 3)).alias("schema")).groupBy("schema").agg(F.count("*").alias("n"))


_words = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{schema}'" for schema, words in selfnotes.SCHEMA_WORDS.items())
_SCHEMAS = f"SELECT CASE WHEN doc_id % 3 = 1 THEN 'bias' WHEN doc_id % 4 = 0 THEN 'heuristic' WHEN doc_id % 4 = 2 THEN 'mode' {_words} ELSE 'constitution' END AS schema, count(*) AS n FROM documents GROUP BY 1"


def command_scopes(spark, sf_dir):
    """Every document's text as a topic, its source as the command; modes and budgets by its number."""
    d = documents(spark, sf_dir)
    command = F.when(F.col("source") == "src1", "report").when(F.col("source") == "src2", "deck").otherwise("other")
    k = (F.col("doc_id") % 4).cast("int")
    mode, asked = F.get(F.array(*map(F.lit, ["Index", " brief", "deep", "x"])), k), F.when(F.col("doc_id") % 5 == 0, " l1 ")
    rows = d.select(F.array_join(selfnotes.applicability(command, F.col("text")), ",").alias("scope"), selfnotes.budget(mode, asked).alias("budget"))
    return rows.groupBy("scope", "budget").agg(F.count("*").alias("n"))


_hints = "[" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{name}' END" for name, p in selfnotes.HINTS.items()) + "]"
_SCOPES = f"""WITH d AS (SELECT doc_id, CASE source WHEN 'src1' THEN ['investment', 'macro', 'valuation', 'writing'] WHEN 'src2' THEN ['investment', 'macro', 'writing'] ELSE ['global', 'writing'] END AS base, list_filter({_hints}, lambda h: h IS NOT NULL) AS hints FROM documents)
SELECT array_to_string(list_concat(list_concat(base, list_filter(hints, lambda h: NOT list_contains(base, h))), CASE WHEN list_contains(base, 'global') THEN [] ELSE ['global'] END), ',') AS scope, CASE WHEN doc_id % 5 = 0 THEN 'L1' ELSE ['L0', 'L1', 'L3', 'L2'][doc_id % 4 + 1] END AS budget, count(*) AS n FROM d GROUP BY ALL"""


def source_routing(spark, sf_dir):
    """Every note with its class and draft filled in where it lacks them, by its own title and text."""
    n = notes(spark, sf_dir)
    rows = n.select("title", "source_type", "text", "document_class", F.when(F.col("doc_id") % 5 == 0, "d.md").alias("draft_path"), F.col("doc_id").cast("string").alias("id"), "path")
    return selfnotes.routed(rows).select("path", "document_class", "draft_path")


_low = "regexp_replace(regexp_replace(lower(title || chr(10) || text), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
_named = {"transcript": "transcript", "research_note": "paper"}
_rules = " ".join(f"WHEN regexp_matches(low, '{ingest.word_rule(words)}')" + (f" OR kind = '{_named[name]}'" if name in _named else "") + f" THEN '{name}'" for name, words in ingest.CLASSES)
_stem = "nullif(left(regexp_replace(lower(title), ' +', '-', 'g'), 80), '')"
_ROUTING = f"""WITH {_NOTES}, r AS (SELECT *, coalesce(nullif(trim(source_type), ''), 'note') AS kind, {_low} AS low FROM n)
SELECT path, CASE WHEN document_class <> '' THEN document_class WHEN kind = 'dataset' THEN CASE WHEN contains(low, 'survey') OR contains(low, 'release') THEN 'data_release' ELSE 'dataset_snapshot' END
WHEN kind = 'image' THEN CASE WHEN regexp_matches(low, '{ingest.word_rule(ingest.VISUAL_WORDS)}') THEN 'chartpack_or_visual' ELSE 'visual_capture' END {_rules} WHEN kind IN ('article', 'web') THEN 'article_or_web_capture' ELSE 'working_note' END AS document_class,
CASE WHEN doc_id % 5 = 0 THEN 'd.md' ELSE 'wiki/drafts/append-review/' || coalesce({_stem}, CAST(doc_id AS VARCHAR)) || '.md' END AS draft_path FROM r"""


def latest_logs(spark, sf_dir):
    """The last seven days of events as logs, found by their names."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    files = e.select(F.concat(F.lit("wiki/memory/daily/"), F.to_date("ts").cast("string"), F.lit(".md")).alias("path")).distinct().unionByName(spark.createDataFrame([("wiki/memory/daily/index.md",), ("wiki/memory/daily/zz.md",)], "path string"))
    return selfnotes.latest_names(files, r"^\d{4}-\d{2}-\d{2}\.md$", 7)


_LOGS = "SELECT DISTINCT 'wiki/memory/daily/' || CAST(CAST(ts AS DATE) AS VARCHAR) || '.md' AS path FROM events ORDER BY path DESC LIMIT 7"


def section_heads(spark, sf_dir):
    """Heads of sections that hold whole documents: one its text, one the same under its language, one nothing."""
    d = documents(spark, sf_dir)
    body = F.concat(F.lit("## Open Loops\n"), "text", F.lit("\n## Watchpoints\n\n## Active Priorities\n"), "lang", F.lit("\n  "), "text")
    heads = selfnotes.section_heads(body, ["Active Priorities", "Open Loops", "Watchpoints", "Missing"])
    return d.select("doc_id", F.array_join(F.map_keys(heads), ",").alias("headings"), F.element_at(heads, F.lit("Open Loops")).alias("loops"), F.length(F.element_at(heads, F.lit("Active Priorities"))).cast("long").alias("size"))


_first = "string_split_regex({}, '(?m)^##\\s')[1]"
_flat = lambda e: f"left(regexp_replace(regexp_replace({e}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 600)"
_HEADS = f"""WITH h AS (SELECT doc_id, {_flat(_first.format('text'))} AS loops, {_flat(_first.format("lang || chr(10) || '  ' || text"))} AS act FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN act <> '' THEN 'Active Priorities' END, CASE WHEN loops <> '' THEN 'Open Loops' END], lambda x: x IS NOT NULL), ',') AS headings, nullif(loops, '') AS loops, CAST(length(nullif(act, '')) AS BIGINT) AS size FROM h"""

QUERIES = {
    "self_schemas": (self_schemas, _SCHEMAS), "command_scopes": (command_scopes, _SCOPES), "source_routing": (source_routing, _ROUTING), "latest_logs": (latest_logs, _LOGS), "section_heads": (section_heads, _HEADS),
    "claim_stance": (claim_stance, _STANCE), "phrase_counts": (phrase_counts, _PHRASE_COUNTS), "claim_search": (claim_search, _search_sql()), "stale_reviews": (stale_reviews, _STALE), "regime_order": (regime_order, _ORDER), "regime_labels": (regime_labels, _REGIME_LABELS),
    "concept_index": (concept_index, _CONCEPT_INDEX), "source_index": (source_index, _SOURCE_INDEX), "candidate_frequency": (candidate_frequency, _FREQUENCY), "contradiction_candidates": (contradiction_candidates, _CONTRADICTIONS),
    "synthesis_candidates": (synthesis_candidates, _SYNTHESIS), "unresolved_registers": (unresolved_registers, _UNRESOLVED), "collection_counts": (collection_counts, _COLLECTIONS), "claim_hints": (claim_hints, _HINTS),
    "page_claims": (page_claims, _PAGE_CLAIMS), "ledger_order": (ledger_order, _LEDGER_ORDER), "ledger_counts": (ledger_counts, _LEDGER_COUNTS), "claim_counters": (claim_counters, _COUNTERS), "note_concepts": (note_concepts, _NOTE_CONCEPTS),
    "source_chronology": (source_chronology, _CHRONOLOGY), "knowledge_pages": (knowledge_pages, _PAGES), "retired_pages": (retired_pages, _RETIRED), "claim_gate": (claim_gate, _GATE), "source_types": (source_types, _SOURCE_TYPES),
    "repo_snapshots": (repo_snapshots, _REPOS), "sidecar_override": (sidecar_override, _SIDECARS), "source_summary": (source_summary, _SUMMARY), "dataset_preview": (dataset_preview, _PREVIEW), "review_states": (review_states, _REVIEWS),
    "suppressed_hits": (suppressed_hits, _SUPPRESSED), "legacy_rollover": (legacy_rollover, _ROLLOVER), "catalog_upsert": (catalog_upsert, _UPSERT), "curated_export": (curated_export, _EXPORT), "entity_names": (entity_names, _ENTITIES),
    "exact_watch_profile": (exact_watch_profile, _PROFILE), "watch_profiles": (watch_profiles, _WATCH), "crystallize_target": (crystallize_target, _TARGETS), "section_coverage": (section_coverage, _COVERAGE), "state_gaps": (state_gaps, _GAPS),
    "lead_claims": (lead_claims, _LEADS), "report_claims": (report_claims, _REPORT_CLAIMS), "compact_lines": (compact_lines, _COMPACT), "memory_events": (memory_events, _MEMORY), "recent_events": (recent_events, _RECENT),
    "scenario_labels": (scenario_labels, _SCENARIO), "largest_biases": (largest_biases, _BIASES), "regime_means": (regime_means, _REGIMES), "checked_series": (checked_series, _CHECKED), "lint_rules": (lint_rules, _lint_sql()),
}
