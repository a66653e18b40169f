"""Ranked retrieval: three-field BM25 with boosts and review adjustments, in tiers that escalate.

One pass over the corpus computes, per document, the counts of the query's tokens only; corpus statistics are one row,
aggregated from those counts, so no token table is built or shuffled. Statistics always cover the whole corpus: prefix
filters apply after them. Documents have the columns path, title, content, metadata and raw, and any further ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import STOPWORDS, excerpt, pinned, times, tokens

#: field: (k1, b, weight)
FIELDS = {"title": (1.1, 0.4, 5.0), "metadata": (1.1, 0.3, 3.0), "body": (1.5, 0.75, 1.0)}

# States of notes and of their review.
RETIRED = ("inactive", "obsolete", "retired", "superseded")
REVIEWED = ("text_reviewed", "visual_reviewed", "visual-and-text-reviewed", "operator_reviewed")
VISUAL = ("visual_reviewed", "visual-and-text-reviewed", "operator_reviewed")


@dataclass(frozen=True)
class Tier:
    name: str
    limit: int
    prefixes: tuple[str, ...]


# Tiers from the shortest route to raw evidence.
TIERS = (
    Tier("L0", 4, ("wiki/_indices/", "wiki/_maps/", "wiki/glossary/")),
    Tier("L1", 6, ("wiki/concepts/", "wiki/entities/", "wiki/claims/", "wiki/states/", "wiki/regimes/", "wiki/decisions/", "wiki/probabilities/", "wiki/theses/", "wiki/watch-profiles/", "wiki/surveillance/", "wiki/synthesis/", "wiki/questions/")),
    Tier("L2", 8, ("wiki/source-notes/", "outputs/reports/", "outputs/memos/", "outputs/meeting-briefs/", "outputs/briefs/", "wiki/timelines/")),
    Tier("L3", 5, ("extracted/text/",)),
)


def query_tokens(query: str) -> list[str]:
    """The query's tokens by the rule of `tokens`, repeats kept."""
    out, word = [], ""
    for c in query.lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
            continue
        if len(word) > 2 and word not in STOPWORDS:
            out.append(word)
        word = ""
    return out


def is_retired(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))).isin(*RETIRED)


def is_reviewed(status: Column) -> Column:
    return F.lower(F.trim(F.coalesce(status, F.lit("")))).isin(*REVIEWED)


def is_visual(status: Column, method: Column) -> Column:
    return F.lower(F.trim(F.coalesce(status, F.lit("")))).isin(*VISUAL) | F.lower(F.coalesce(method, F.lit(""))).rlike("visual|page image|chart review|rendered pages")


def review_adjustment(path: Column, status: Column, review_status: Column, review_method: Column, document_class: Column, capture: Column) -> Column:
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    unread = (low(review_status) == "unreviewed") | (low(status) == "draft")
    note = F.when(is_reviewed(review_status), 12).when(unread, -4).otherwise(0)
    note = note + F.when((low(capture) == "codex_pdf_vision_handoff") & unread, -3).otherwise(0)
    note = note + F.when(low(document_class) == "chartpack_or_visual", F.when(is_visual(review_status, review_method), 6).otherwise(-15)).otherwise(0)
    return F.when(path.startswith("wiki/source-notes/"), note).otherwise(0) + F.when(low(status) == "stale", -3).otherwise(0)


def prefixed(path: Column, prefixes: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.lower(path).startswith(p.lower())
    return out


def scored(documents: DataFrame, query: str, adjustment: Column | None = None) -> DataFrame:
    """All documents with `score`. An empty query scores nothing."""
    asked = query_tokens(query)
    names = list(documents.columns)
    kinds = dict.fromkeys(asked)
    texts = {"title": F.col("title"), "metadata": F.col("metadata"), "body": F.col("content")}
    # of a field's tokens only their number and those that the query asks for are kept; the array is bound once
    kept = lambda text: F.element_at(F.transform(F.array(tokens(text)), lambda t: F.struct(F.size(t).alias("n"), F.filter(t, lambda x: x.isin(list(kinds)) if kinds else F.lit(False)).alias("hits"))), 1)
    counted = pinned(documents, **{f"_{field}": kept(text) for field, text in texts.items()})
    own = {f"_{field}_n": F.col(f"_{field}.n") for field in FIELDS}
    own |= {f"_{field}_{i}": times(F.col(f"_{field}.hits"), t) for field in FIELDS for i, t in enumerate(kinds)}
    counted = counted.withColumns(own).drop(*[f"_{f}" for f in FIELDS])
    stats = [F.count("*").alias("_docs")]
    for field in FIELDS:
        stats.append(F.avg(f"_{field}_n").alias(f"_{field}_avg"))
        stats += [F.sum((F.col(f"_{field}_{i}") > 0).cast("int")).alias(f"_{field}_{i}_df") for i in range(len(kinds))]
    # the statistics are one row
    joined = counted.crossJoin(F.broadcast(counted.agg(*stats)))
    score = (adjustment if adjustment is not None else F.lit(0)).cast("double")
    place = {t: i for i, t in enumerate(kinds)}
    for field, (k1, b, weight) in FIELDS.items():
        part = F.lit(0.0)
        size = F.greatest(F.col(f"_{field}_n"), F.lit(1)) / F.greatest(F.col(f"_{field}_avg"), F.lit(1.0))
        for t in asked:
            tf, df = F.col(f"_{field}_{place[t]}"), F.col(f"_{field}_{place[t]}_df")
            idf = F.log(1 + (F.col("_docs") - df + 0.5) / (df + 0.5))
            part = part + F.when(tf > 0, idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * size))).otherwise(0.0)
        score = score + weight * part
    phrase, path = query.lower(), F.lower("path")
    score = score + F.when(F.lower("title").contains(phrase), 10).otherwise(0) + F.when(path.contains(phrase), 4).otherwise(0) + F.when(F.lower("raw").contains(phrase), 6).otherwise(0)
    for t in asked:
        score = score + F.when(path.contains(t), 2).otherwise(0) + F.when((F.col(f"_metadata_{place[t]}") > 0) & F.col("path").startswith("wiki/"), 1).otherwise(0)
    return joined.select(*names, (score if asked else F.lit(0.0)).alias("score"))


def search(documents: DataFrame, query: str, limit: int = 8, include: tuple = (), exclude: tuple = (), adjustment: Column | None = None, excerpt_size: int = 280, order: Column | None = None) -> DataFrame:
    """The `limit` best documents with score and excerpt; ties by path, or by `order`."""
    found = scored(documents, query, adjustment).where(F.col("score") > 0)
    if exclude:
        found = found.where(~prefixed(F.col("path"), exclude))
    if include:
        found = found.where(prefixed(F.col("path"), include))
    tie = order if order is not None else F.collate("path", "UNICODE")
    best = found.orderBy(F.desc("score"), tie).limit(limit)
    return best.withColumn("excerpt", excerpt(F.col("content"), query_tokens(query) or [""], excerpt_size))


def tier_of(path: Column, tiers: tuple[Tier, ...] = TIERS) -> Column:
    out = F.lit(None).cast("string")
    for t in reversed(tiers):
        out = F.when(prefixed(path, t.prefixes), t.name).otherwise(out)
    return out


def retrieve(documents: DataFrame, query: str, budget: int = 2, grounding: int = 3, tier: Column | None = None, tiers: tuple[Tier, ...] = TIERS, adjustment: Column | None = None) -> DataFrame:
    """Evidence from the tiers up to number `budget`, and one tier more while under `grounding` results are found.

    The corpus is scored once; each tier keeps its own best, and the tiers to use follow from their counts alone, as a
    running sum over at most one row per tier. A path counts once, in its first tier.
    """
    found = scored(documents, query, adjustment).where("score > 0").withColumn("tier", tier if tier is not None else tier_of(F.col("path"), tiers))
    limits = F.create_map(*[x for t in tiers for x in (F.lit(t.name), F.lit(t.limit))])
    places = F.create_map(*[x for i, t in enumerate(tiers) for x in (F.lit(t.name), F.lit(i))])
    best = Window.partitionBy("tier").orderBy(F.desc("score"), "path")
    found = found.where(F.col("tier").isNotNull()).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(t.limit for t in tiers))
    found = found.where(F.col("rank") <= limits[F.col("tier")]).withColumn("place", places[F.col("tier")])
    counts = found.groupBy("place").agg(F.count("*").alias("n"))
    every = F.broadcast(documents.sparkSession.range(len(tiers)).select(F.col("id").cast("int").alias("place"))).join(counts, "place", "left")
    before = F.coalesce(F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = every.withColumn("before", before).where((F.col("place") <= budget) | (F.col("before") < grounding)).select("place")
    return found.join(F.broadcast(used), "place", "left_semi")
