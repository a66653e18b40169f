"""What is compiled from notes: indexes of concepts, entities and sources, registers of what is open, pages of knowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import concept_label, contains_any
from siltstone.operators.claims import NEGATIVE, POSITIVE
from siltstone.operators.concepts import is_concept, label_rows


def concept_index(notes: DataFrame, terms: list[str]) -> DataFrame:
    """(label, path): the notes of each chosen concept that holds up, one spelling of a key in each note."""
    return label_rows(notes, "concepts").where(is_concept(F.col("label_key"), terms)).select("label", "path")


def entity_index(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.explode("entities").alias("label")).select("label", "path")


def source_index(notes: DataFrame) -> DataFrame:
    """(source_type, place, path, title, date): notes of each type by title."""
    kind = F.coalesce(F.nullif("source_type", F.lit("")), F.lit("unknown"))
    rows = notes.select(kind.alias("source_type"), "path", "title", "date")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("source_type").orderBy("title", "path")))


def contradiction_candidates(index: DataFrame, notes: DataFrame, positive=POSITIVE, negative=NEGATIVE, shown: int = 3) -> DataFrame:
    """(label, n_notes, n_positive, n_negative, positives, negatives) of labels whose notes' summaries lean both ways."""
    low = F.lower("summary")
    leaning = notes.select("path", contains_any(low, positive).alias("up"), contains_any(low, negative).alias("down"))
    rows = index.join(leaning, "path")
    # the first few of each side are kept while groups are aggregated, so that a common label gathers no list
    first = lambda side: F.slice(F.array_sort(F.collect_list(F.when((F.col(f"{side}_place") <= shown), F.col("path")))), 1, shown)
    ranked = rows.withColumns({f"{s}_place": F.when(F.col(s), F.row_number().over(Window.partitionBy("label", s).orderBy("path"))) for s in ("up", "down")})
    out = ranked.groupBy("label").agg(F.count("*").alias("n_notes"), F.count_if("up").alias("n_positive"), F.count_if("down").alias("n_negative"), first("up").alias("positives"), first("down").alias("negatives"))
    return out.where("n_notes >= 2 and n_positive > 0 and n_negative > 0")


def synthesis_candidates(index: DataFrame, least: int = 3) -> DataFrame:
    """(label, n_notes) of labels with enough notes for a synthesis page."""
    return index.groupBy("label").agg(F.count("*").alias("n_notes")).where(F.col("n_notes") >= least)


def unresolved(notes: DataFrame) -> DataFrame:
    """(register, path): notes without an extracted text, and notes with neither concepts nor entities."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    found = F.array(F.when(F.coalesce(F.col("extracted_text_path"), F.lit("")) == "", "extraction"), F.when(none("concepts") & none("entities"), "classification"))
    return notes.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("register"), "path")


def collection_counts(notes: DataFrame) -> DataFrame:
    """(kind, n_notes, n_active): notes of each collection, index pages left out."""
    rows = notes.where(~F.col("path").rlike(r"(?i)/(?:index|README)\.md$"))
    return rows.groupBy("kind").agg(F.count("*").alias("n_notes"), F.count_if(~F.lower(F.coalesce("status", F.lit(""))).isin("inactive", "obsolete", "retired", "superseded")).alias("n_active"))


def chronology(notes: DataFrame) -> DataFrame:
    """Dated notes in the order of their dates as text, with their `place`: numbered within days, which are summed up first."""
    dated = notes.where(F.coalesce(F.col("date"), F.lit("")) != "").select("date", "path", "title", F.coalesce(F.nullif("source_type", F.lit("")), F.lit("source")).alias("source_type"))
    days = dated.groupBy("date").agg(F.count("*").alias("n"))
    before = days.withColumn("before", F.sum("n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1))).select("date", F.coalesce("before", F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("date").orderBy("path"))
    return dated.join(before, "date").withColumn("place", (F.col("before") + own).cast("long")).drop("before")


def claim_hints(claims: DataFrame) -> DataFrame:
    """(path, kind, label_key, label): concepts and entities of the claims of each note; the last claim's spelling stays."""
    of_kind = lambda c, kind: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("label")))
    each = F.concat(of_kind("concepts", "concept"), of_kind("entities", "entity"))
    rows = claims.where(F.trim(F.coalesce("origin", F.lit(""))) != "").select(F.trim("origin").alias("path"), "id", F.posexplode(each).alias("seq", "v")).select("path", "id", "seq", "v.*")
    return rows.withColumn("label_key", concept_label(F.col("label"))).where("label_key <> ''").groupBy("path", "kind", "label_key").agg(F.max_by("label", F.struct("id", "seq")).alias("label"))


def page_claims(claims: DataFrame, labels: Column, limit: int | None = None) -> DataFrame:
    """(label_key, id, place): claims of each label, the surest first, then the latest, then by id."""
    rows = claims.select("id", "score", "date", F.explode(F.array_distinct(F.transform(labels, concept_label))).alias("label_key")).where("label_key <> ''")
    place = F.row_number().over(Window.partitionBy("label_key").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), F.desc(F.coalesce("date", F.lit(""))), "id"))
    out = rows.select("label_key", "id", place.alias("place"))
    return out if limit is None else out.where(F.col("place") <= limit)


def ledger_order(claims: DataFrame) -> DataFrame:
    """Claims by origin and id, with their `place` within the origin."""
    return claims.withColumn("place", F.row_number().over(Window.partitionBy("origin").orderBy("id")))


def label_pages(index: DataFrame, notes: DataFrame, related: str = "entities") -> DataFrame:
    """(label, n_notes, n_related, related, first_date, last_date): a page's evidence, and the labels met with it."""
    rows = index.join(notes.select("path", F.col(related).alias("others"), F.nullif("date", F.lit("")).alias("date")), "path")
    dates = rows.groupBy("label").agg(F.count("*").alias("n_notes"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    met = rows.select("label", F.explode("others").alias("other")).distinct()
    met = met.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("other")))
    met = met.groupBy("label").agg(F.count("*").alias("n_related"), F.array_sort(F.collect_list(F.when(F.col("place") <= 12, F.col("other")))).alias("related"))
    return dates.join(met, "label", "left").select("label", "n_notes", F.coalesce("n_related", F.lit(0)).cast("long").alias("n_related"), F.coalesce("related", F.array().cast("array<string>")).alias("related"), "first_date", "last_date")


def retired(pages: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Pages whose key is not among the active ones and that are not retired yet, with their new status."""
    gone = pages.where(F.lower(F.coalesce("status", F.lit(""))) != "retired").join(active.select(key).distinct(), key, "left_anti")
    return gone.withColumn("status", F.lit("retired"))


# Headings whose text gives claims, by the start of a note's path.
CLAIM_SECTIONS = {
    "wiki/source-notes/": ("What This Source Says",),
    "wiki/reports/": ("Executive Summary", "What The Corpus Says", "Investment Implications", "Judgement", "Bottom Line", "Synthesis", "Counter-Case", "Data Gaps"),
    "outputs/memos/": ("Executive Summary", "Synthesis", "Counter-Case"),
    "wiki/theses/": ("Thesis Statement", "What Must Be True", "Risks / Failure Modes", "Catalysts"),
}


def claim_inputs(notes: DataFrame) -> DataFrame:
    """Notes that claims are read from: no index pages, none inactive."""
    status = F.lower(F.coalesce("status", F.lit("")))
    return notes.where(~F.col("path").rlike(r"(?i)/(?:index|README)\.md$") & ~status.isin("inactive", "retired", "obsolete"))


def claim_sections(path: Column) -> Column:
    """The headings of a note, in order; none elsewhere."""
    out = F.array().cast("array<string>")
    for prefix, headings in CLAIM_SECTIONS.items():
        out = F.when(path.startswith(prefix), F.array(*map(F.lit, headings))).otherwise(out)
    return out


def gives_claims(path: Column, review_status: Column, source_type: Column, document_class: Column) -> Column:
    """Pictures and charts among source notes give none until they are reviewed."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    visual = (clean(source_type) == "image") | clean(document_class).isin("chartpack_or_visual", "visual_capture")
    return ~(path.startswith("wiki/source-notes/") & (clean(review_status) == "unreviewed") & visual)


def ledger_counts(claims: DataFrame) -> DataFrame:
    """(status, kind, n, mean_score, n_thin): what the ledger's index shows; thin claims have a single source or none."""
    return claims.groupBy("status", "kind").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.count_if(F.col("n_sources") <= 1).alias("n_thin"))


def claim_counters(claims: DataFrame, edges: DataFrame, limit: int = 4) -> DataFrame:
    """(id, place, other, claim_text): the claims that stand against each claim, surest first; ids that are unknown drop out."""
    against = edges.where(F.col("relation").isin("contradicts", "weakens"))
    ends = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("other"))
    back = F.when(F.col("relation") == "contradicts", F.array(ends("dst", "src"), ends("src", "dst"))).otherwise(F.array(ends("dst", "src")))
    both = against.select(F.explode(back).alias("e")).select("e.*").distinct()
    found = both.join(claims.select(F.col("id").alias("other"), "claim_text", "score"), "other")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return found.select("id", place.alias("place"), "other", "claim_text").where(F.col("place") <= limit)
