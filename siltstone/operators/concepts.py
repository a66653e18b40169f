"""Which labels are worth a page: concept quality, entity names, and what a note's concepts are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import STOPWORDS, concept_label, phrase_count, pinned, slug, strip, words_in

# Words by what they say about a label.
MONTHS = "january february march april may june july august september october november december".split()
GENERIC = (
    "am actual annual april aug august auction auctions billion bill bills bond bonds browser calendar change changes commodities consensus countries country"
    " crypto currencies currency data december download earnings estimate estimates expected february feature features forecast nbsp historical index indexes"
    " indicator indicators january july june latest march market markets may members million monthly mom news november october past pm plan plans point points"
    " previous prior print prints quarter quarterly rank release released releases report reports search september shares source subscription today trillion"
    " utc update updates week weekly year years yoy"
).split()
NEVER = (
    "actual annual april aug august billion bill bills calendar change changes consensus data december estimate estimates expected february forecast index"
    " indexes indicator indicators january july june latest march million month months monthly mom nbsp november october past pm point points previous prior"
    " print prints quarter quarterly release released releases report reports september source today trillion utc update updates week weekly year years yoy"
).split()
ABBREVIATIONS = "am apr aug cn dec eia eu feb jan jp jul jun kr mar mba mom nbsp nov oct pm qoq sep uk us utc yoy ytd".split()
SINGLE = (
    "ai capex cpi credit demand exports flows freight funding gdp growth housing imports inflation inventory labour labor liquidity manufacturing pce pmi ppi"
    " production rates services shipping skew trade volatility"
).split()
NOISE = (
    "additional answer arxiv back com disclosure disclosures final forum http https id menu module openreview page pages please preprint problems sub research"
    " see third url user www"
).split()
STRUCTURE = "answer back com final forum http https id menu openreview org pdf problems sub url user www".split()
SHORT = ["ai"]


def _among(word: Column, values: list[str]) -> Column:
    return F.array_contains(words_in(values), word) if values else F.lit(False)


def is_concept(label: Column, terms: list[str], lone: bool = True) -> Column:
    """Whether a normalised label says something. Ontology terms always do; `lone` lets unlisted words of five letters stand."""
    words = F.split(label, " ")
    n, alone = F.size(words), [t for t in terms if " " not in t]
    some = lambda test: F.exists(words, test)
    empty = lambda w: _among(w, [*STOPWORDS, *MONTHS, *GENERIC]) | w.rlike(r"^\d+$")
    word = F.element_at(words, 1)
    single = ~empty(word) & (_among(word, [*alone, *SINGLE]) | (F.length(word) >= 5 if lone else F.lit(False)))
    stub = lambda w: (F.length(w) == 1) | ((F.length(w) == 2) & ~w.rlike(r"\d") & ~_among(w, [*SHORT, *alone]))
    framed = _among(word, STOPWORDS) | _among(F.element_at(words, -1), STOPWORDS)
    brief = F.size(F.filter(words, lambda w: F.length(w) <= 3))
    phrase = (n <= 4) & ~framed & ~some(lambda w: stub(w) | _among(w, [*MONTHS, *ABBREVIATIONS])) & (2 * brief <= n) & some(lambda w: ~empty(w))
    barred = some(lambda w: _among(w, [*NEVER, *STRUCTURE]))
    return F.when(label == "", False).when(_among(label, terms), True).when(barred, False).when(n == 1, single).otherwise(phrase)


def is_candidate(label: Column, terms: list[str]) -> Column:
    """The stricter rule for labels that nobody chose."""
    return is_concept(label, terms, lone=False) & ~F.exists(F.split(label, " "), lambda w: (F.length(w) == 1) | _among(w, NOISE))


def entity_names(context: Column, topic: Column, limit: int = 12) -> Column:
    """Runs of capitalised words or of capitals, one for each spelling's slug, without the topic itself."""
    runs = F.regexp_extract_all(F.coalesce(context, F.lit("")), F.lit(r"\b((?:[A-Z][a-z]+|[A-Z]{2,})(?:\s+(?:[A-Z][a-z]+|[A-Z]{2,}))*)\b"), F.lit(1))
    named = F.transform(F.filter(F.array_distinct(runs), lambda r: F.length(r) > 2), lambda r: F.struct(slug(r).alias("slug"), r.alias("name")))
    other = F.filter(named, lambda n: n["slug"] != slug(F.coalesce(topic, F.lit(""))))
    # no longer than the limit, so that a long text costs its runs and not their square
    first = F.aggregate(other, F.array().cast("array<struct<slug:string,name:string>>"), lambda held, n: F.when((F.size(held) >= limit) | F.exists(held, lambda h: h["slug"] == n["slug"]), held).otherwise(F.concat(held, F.array(n))))
    return F.transform(first, lambda n: n["name"])


def sampled(text: Column, size: int = 60_000) -> Column:
    """Texts over `size` characters as their head, middle and tail of a third each."""
    third = size // 3
    n = F.length(text)
    middle = F.substr(text, F.floor(n / 2).cast("int") - third // 2 + 1, F.lit(third))
    return F.when(n <= size, text).otherwise(F.concat_ws("\n", F.substring(text, 1, third), middle, F.substr(text, n - third + 1, F.lit(third))))


def label_rows(notes: DataFrame, column: str, *kept: str) -> DataFrame:
    """(kept, label_key, label): the labels of an array column, the first spelling of a key in each note."""
    rows = notes.select("path", *kept, F.posexplode(column).alias("place", "label")).withColumn("label_key", concept_label(F.col("label"))).where("label_key <> ''")
    return rows.groupBy("path", *kept, "label_key").agg(F.min_by("label", "place").alias("label"))


def candidate_counts(notes: DataFrame, terms: list[str]) -> DataFrame:
    """(label_key, n): how often a candidate that holds up occurs over all notes, repeats in a note counted."""
    rows = notes.select(F.explode("candidates").alias("label")).withColumn("label_key", concept_label(F.col("label")))
    return rows.where(is_candidate(F.col("label_key"), terms)).groupBy("label_key").agg(F.count("*").alias("n"))


def note_concepts(notes: DataFrame, hints: DataFrame, terms: list[str], limit: int = 8, promote: bool = False) -> DataFrame:
    """(path, label_key, label, score, place): a note's concepts, from four sources of which the best counts.

    `notes` has path, title, routing (title and summaries), whole (routing and the extracted text), concepts, candidates;
    `hints` has path, label: concepts of the note's claims. Chosen labels that the note bears out are worth 100 and more,
    claim hints 90, ontology terms in the routing text 60, candidates 20 and more.
    """
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    base = pinned(notes.select("path", "title", "routing", "whole", "concepts", "candidates"), t=concept_label(F.col("title")), r=concept_label(F.col("routing")), w=concept_label(F.col("whole"))).select("path", "t", "r", "w", "concepts", "candidates")
    spelled = lambda c, kind: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: F.struct(strip(v).alias("label"), concept_label(v).alias("k"), F.lit(kind).alias("kind")))
    named = F.transform(F.filter(F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>"), lambda x: pad(F.col("r")).contains(pad(x))), lambda v: F.struct(v.alias("label"), v.alias("k"), F.lit("term").alias("kind")))
    rows = base.select("path", "t", "r", "w", F.posexplode(F.concat(spelled("concepts", "chosen"), named, spelled("candidates", "candidate"))).alias("seq", "c")).select("path", "t", "r", "w", "seq", "c.*")
    corpus = candidate_counts(notes, terms).select(F.col("label_key").alias("k"), F.col("n").alias("corpus"))
    rows = rows.join(corpus, "k", "left").withColumn("corpus", F.when(F.col("kind") == "candidate", F.coalesce("corpus", F.lit(0))))
    listed = _among(F.col("k"), terms)
    titled = pad(F.col("t")).contains(pad(F.col("k")))
    in_r, in_w = phrase_count(F.col("r"), F.col("k")), phrase_count(F.col("w"), F.col("k"))
    chosen = F.when(listed | titled | (in_r >= 1) | (in_w >= 2), 100 + F.when(titled, 10).otherwise(0) + F.least(in_r, F.lit(2)) * 8 + F.least(in_w, F.lit(3)) * 4)
    known = listed | titled | (in_w >= 2) | (F.col("corpus") >= 2 if promote else F.lit(False))
    offered = F.when(is_candidate(F.col("k"), terms) & known, 20 + F.when(listed, 18).otherwise(0) + F.when(titled, 14).otherwise(0) + F.least(in_w, F.lit(3)) * 6 + F.least(F.col("corpus"), F.lit(3)) * 4)
    score = F.when(F.col("kind") == "chosen", chosen).when(F.col("kind") == "term", 60).otherwise(offered)
    # a label is spelled as the first source spells it: chosen, hints, terms, candidates
    order = F.when(F.col("kind") == "chosen", 0).when(F.col("kind") == "term", 2).otherwise(3)
    mine = rows.select("path", F.col("k").alias("label_key"), "label", score.cast("long").alias("score"), order.alias("source"), "seq")
    theirs = hints.select("path", concept_label(F.col("label")).alias("label_key"), "label", F.lit(90).cast("long").alias("score"), F.lit(1).alias("source"), F.lit(0).alias("seq"))
    held = mine.unionByName(theirs).where(F.col("score").isNotNull() & is_concept(F.col("label_key"), terms))
    best = held.groupBy("path", "label_key").agg(F.max("score").alias("score"), F.min_by("label", F.struct("source", "seq", "label")).alias("label"))
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "label_key"))
    return best.withColumn("place", place).where(F.col("place") <= limit)
