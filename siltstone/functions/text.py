"""Text functions as column expressions; all of them run inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no topic.
STOPWORDS = (
    "a about after against all also an and are as at be because been before between both but by can could did do does for"
    " from had has have how if into is it its just more most not of on or out over recent same should so some such than that"
    " the their them then there these they this those through to too under use using very was were what when where which while"
    " who why with you your"
).split()


def words_in(values: list[str]) -> Column:
    """A constant array out of one literal, which the optimizer folds; literals one by one are slow to build."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def tokens(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Lower-case runs of a-z and 0-9 that are longer than two and no stopword, in order with repeats."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: (F.length(t) > 2) & ~t.isin(stopwords))


def token_set(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """The distinct `tokens`, faster on long texts."""
    return F.filter(F.array_except(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), words_in(stopwords)), lambda t: F.length(t) > 2)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    """Lower-case ASCII words joined by single hyphens; letters with accents lose them through `fold_accents` first."""
    kept = F.lower(strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_\s-]", "")))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"[_\s]+", "-"), "-+", "-"), "^-|-$", "")


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t and "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def fold_accents(text: Column) -> Column:
    """Compatibility forms taken apart and accents dropped."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _decomposed(text)).otherwise(text)


# UTF-8 that was read as a Western code page, and what it stood for, in order.
MOJIBAKE = (("Â©", "©"), ("Â®", "®"), ("Â·", "·"), ("â€¢", "•"), ("â€“", "–"), ("â€”", "—"), ("â€˜", "‘"), ("â€™", "’"), ("â€œ", "“"), ("â€", "”"), ("â€¦", "…"))


def repaired(text: Column) -> Column:
    for broken, meant in MOJIBAKE:
        text = F.replace(text, F.lit(broken), F.lit(meant))
    return text


def tidy_lines(text: Column) -> Column:
    """Extracted text put right: broken characters read again, each line squeezed, empty lines dropped."""
    plain = F.regexp_replace(F.regexp_replace(repaired(F.coalesce(text, F.lit(""))), r"\x00", " "), r"\r", "")
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[^\S\n]+", " "), r"(?m)^ | $", ""), r"\n{2,}", "\n"))


def truncated(text: Column, size: int) -> Column:
    """At most `size` characters, the last of them an ellipsis where something was cut."""
    whole = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(whole) <= size, whole).otherwise(F.concat(F.regexp_replace(F.substring(whole, 1, size - 1), r"\s+$", ""), F.lit("…")))


def concept_label(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), " ")


def claim_label(text: Column) -> Column:
    """The form in which claims are compared: lower case, letters, digits and single spaces."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " "))


def clean_claim(text: Column) -> Column:
    """Without links' targets, code marks and wiki brackets."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)https?://\S+", " ")
    plain = F.regexp_replace(plain, r"`([^`]+)`", "$1")
    return squeeze(F.regexp_replace(plain, r"\[\[([^\]]+)\]\]", "$1"))


def claim_units(block: Column) -> Column:
    """Sentences of a block as an array: lines without their bullet, table lines left out, cut after . ! ? before a capital or digit."""
    lines = F.transform(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: clean_claim(F.regexp_replace(x, r"^\s*[-*]\s+", "")))
    usable = F.filter(lines, lambda x: (x != "") & ~x.startswith("|") & ~x.contains(" | "))
    cut = F.flatten(F.transform(usable, lambda x: F.split(x, r"(?<=[.!?])\s+(?=[A-Z0-9])")))
    return F.filter(F.transform(cut, clean_claim), lambda x: x != "")


def section(body: Column, heading: str) -> Column:
    """Text under the first `## heading` up to the next one of level two."""
    safe = "".join(c if c.isalnum() or c == " " else "\\" + c for c in heading)
    return strip(F.regexp_extract(F.coalesce(body, F.lit("")), rf"(?ims)^##\s+{safe}[ \t]*$(.*?)(?=^##\s|\z)", 1))


def wiki_links(body: Column) -> Column:
    """Distinct targets of [[target|label]] and [[target#part]] links, without their extension."""
    raw = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda x: strip(F.regexp_replace(F.regexp_replace(x, r"[|#].*$", ""), r"(?i)\.md$", ""))), lambda x: x != ""))


def plain_html(html: Column) -> Column:
    """Visible text: scripts, styles and tags go, common entities are read, white space is squeezed."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    return squeeze(entities(text))


# The named entities that are read.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def entities(text: Column) -> Column:
    for name, value in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def plain_markdown(body: Column) -> Column:
    """Markdown without code fences, images, link targets, heading, quote and emphasis marks."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?s)```.*?```", " ")
    for pattern, value in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"), (r"\[\[([^\]]+)\]\]", "$1"), (r"`([^`]*)`", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^>\s?", ""), (r"[*_~]{1,3}", "")):
        text = F.regexp_replace(text, pattern, value)
    return strip(text)


def html_title(html: Column) -> Column:
    return squeeze(entities(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_anchors(html: Column) -> Column:
    """Distinct (target, text) of the anchors of a page."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)(<a\s[^>]*href=["'][^"']*["'][^>]*>.*?</a>)"""), F.lit(1))
    pair = lambda x: F.struct(F.regexp_extract(x, r"""(?is)href=["']([^"']*)["']""", 1).alias("target"), plain_html(x).alias("text"))
    return F.array_distinct(F.transform(found, pair))


def figure_refs(body: Column) -> Column:
    """Distinct (source, alt) of Markdown images, ![[embeds]] and <img> tags, in that order."""
    text = F.coalesce(body, F.lit(""))
    take = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    ref = lambda src, alt: F.struct(strip(src).alias("source"), strip(alt).alias("alt"))
    marks = F.transform(take(r"!\[[^\]]*\]\([^)\s]+[^)]*\)"), lambda x: ref(F.regexp_extract(x, r"\]\(([^)\s]+)", 1), F.regexp_extract(x, r"!\[([^\]]*)\]", 1)))
    embeds = F.transform(take(r"!\[\[[^\]]+\]\]"), lambda x: ref(F.regexp_extract(x, r"!\[\[([^\]|]+)", 1), F.regexp_extract(x, r"\|([^\]]+)\]\]", 1)))
    images = F.transform(take(r"(?is)<img\s[^>]*>"), lambda x: ref(F.regexp_extract(x, r"""(?is)src=["']([^"']*)""", 1), F.regexp_extract(x, r"""(?is)alt=["']([^"']*)""", 1)))
    return F.array_distinct(F.filter(F.concat(marks, embeds, images), lambda r: r["source"] != ""))


def excerpt(content: Column, query: list[str], size: int = 280) -> Column:
    """A stretch of the text around the first query token, or its head where none occurs."""
    places = [F.nullif(F.locate(t, F.lower(content)), F.lit(0)) for t in query]
    first = (F.least(*places) if len(places) > 1 else places[0]) - 1
    start = F.greatest(F.lit(0), first - size // 3)
    cut = squeeze(F.substr(content, start + 1, F.lit(size)))
    head = truncated(F.regexp_replace(content, r"\s+", " "), size)
    return F.when(strip(content) == "", F.lit("")).when(first.isNull(), head).when(start > 0, F.concat(F.lit("..."), cut)).otherwise(cut)


def phrase_count(text: Column, phrase: Column) -> Column:
    """Occurrences of a phrase among space-separated words; neighbours that share their space count once."""
    padded, needle = F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" "))
    return F.when(phrase == "", 0).otherwise(((F.length(padded) - F.length(F.replace(padded, needle, F.lit("")))) / F.length(needle)).cast("int"))


def contains_any(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def terms_in(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur in the text as substrings."""
    out = F.lit(0)
    for t in terms:
        out = out + text.contains(t).cast("int")
    return out


def times(words: Column, word: str) -> Column:
    """How often a word is among others."""
    return F.size(F.filter(words, lambda x: x == F.lit(word)))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by spaces, made by zipping the words with themselves moved on by one place, n - 1 times."""
    grams = words
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(words, F.lit(k + 1), F.greatest(F.size(words), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(grams, lambda x: x.isNotNull())


#: Tables under so many bytes a core are dealt out before text work: a file of one row group is one task.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores; larger ones as their scan splits them, so that no large table is moved for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SPREAD_BYTES * cores else df


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns computed once per row: the optimizer does not copy them into what uses them, lambdas above all."""
    for name, value in columns.items():
        df = df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
    return df
