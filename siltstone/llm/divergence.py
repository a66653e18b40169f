"""How the sources of a language differ in their use of terms: chi-square-like distances, exact in whole numbers.

Each language keeps the terms of `LEAST` documents or more. A group (language, source) and the language itself give each kept
term a probability p in billionths, smoothed by one occurrence. A term's distance is f = floor((p - q)² / q): of a group from
its language for the `term` part, from another source of the language for the `pair` part, which sums f over all kept terms.

`term` searches best first. The terms of a group lie in buckets of like counts; of each bucket the greatest count and the least
count in the language bound f from above, as f grows with p and falls with q where p > q. Buckets are evaluated from the
greatest bound on, a round for all groups at once, until every unseen bound is strictly below the group's kth value.
`pair` never meets the terms that neither source has: p depends on the count only, so what one source's terms give against a
term that the other lacks is summed up over its distinct counts, and postings correct it for the terms that both have.

Counting is one Arrow pass that adds up its piece of text first; then rows are terms, not words. Postings are dealt out by
(language, term), so a hot source or language is split by term; the sums for a pair are added up in each task before they move. A pair's rows are
the output itself: sources of a language squared.

Defined results. Null text, language and source: ''. Repeated rows count each. A group without terms takes part with count 0
for every kept term; a language that keeps none has pairs of value 0 and no terms. Ties: terms and sources in order of their
bytes. Texts without letters, and empty ones, have no terms; very long ones are counted whole. Empty table: no rows. Further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import LOWER, partitions, pieces, released, stored, text_bytes, words

LEAST = 3
TOP = 200
UNIT = 1_000_000_000

#: Bytes of text whose terms are added up before they leave a worker.
COUNTED_BYTES = 4 << 20
#: Pairs of postings that a worker holds at once.
PAIRS_HELD = 1 << 19

#: The bytes between terms: ASCII but for its letters. All bytes of other characters belong to terms.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[[*range(65, 91), *range(97, 123)]] = False


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sum of each value over them."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[cut], *(np.add.reduceat(v[order], cut) for v in values)


def term_array(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of a buffer of texts, A-Z lower-cased, and the row of each."""
    starts, ends, first = words(data, offsets, BETWEEN)
    places = np.concatenate(([0], np.cumsum(ends - starts)))
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(LOWER[data[~BETWEEN[data]]].tobytes()))
    return terms, np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", COUNTED_BYTES):
        terms, row = term_array(*text_bytes(batch.column(2)))
        if not len(terms):
            continue
        coded = terms.dictionary_encode()
        langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
        n_terms, n_sources = len(coded.dictionary), len(sources.dictionary)
        group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
        keys, n = summed(row * n_terms + coded.indices.to_numpy(), np.ones(len(row), np.int64))
        keys, n, docs = summed(group[keys // n_terms] * n_terms + keys % n_terms, n, np.ones(len(keys), np.int64))
        of = keys // n_terms
        held = [langs.dictionary.take(pa.array(of // n_sources)), sources.dictionary.take(pa.array(of % n_sources)), coded.dictionary.take(pa.array(keys % n_terms)).cast(pa.string()), pa.array(n), pa.array(docs)]
        yield pa.RecordBatch.from_arrays(held, ["lang", "source", "term", "n", "docs"])


def quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / total), by long division in three digits of a thousand, so that no product leaves 64 bits."""
    out, rest = F.lit(1).cast("long"), n + 1
    for place in (UNIT // 1000, UNIT // 1_000_000, 1):
        rest = rest * 1000
        out, rest = out + quotient(rest, total) * place, rest % total
    return F.when(total > 0, out)


def distance(p: Column, q: Column) -> Column:
    return quotient((p - q) * (p - q), q)


def counted_terms(docs: DataFrame, lang: str, source: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(postings of kept terms, groups): counts of a term in a source and in its language; totals of each group."""
    named = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = named.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    counts = stored(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= LEAST)
    kept = stored(counts.select("lang", "source", "term", "n").join(terms.select("lang", "term", "lang_n"), ["lang", "term"]))
    released(counts)
    held = stored(kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held")))
    # each kept term once: its least source stands for it
    own = kept.groupBy("lang", "term").agg(F.min("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = named.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(own, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    groups = groups.select("lang", "source", zero("held").alias("held"), zero("v").alias("v"), (zero("total") + zero("v")).alias("size"), (zero("lang_total") + zero("v")).alias("lang_size"))
    return kept, stored(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("size"))))


def best_terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, term, value): the `top` most divergent terms of each group, found best first."""
    group = ["lang", "source"]
    bucket = F.floor(F.log2(F.col("n")) * 4).cast("int")
    extreme = kept.groupBy(*group, bucket.alias("bucket")).agg(F.max("n").alias("n"), F.min("lang_n").alias("lang_n"), F.count("*").alias("terms"))
    sides = lambda rows: rows.join(groups, group).withColumns({"p": share(F.col("n"), F.col("size")), "q": share(F.col("lang_n"), F.col("lang_size"))}).where("p > q")
    unseen = stored(sides(extreme).select(*group, "bucket", "terms", distance(F.col("p"), F.col("q")).alias("bound")))
    order = Window.partitionBy(*group).orderBy(F.col("value").desc(), "term")
    best, wanted = None, top
    while True:
        pending = unseen.withColumn("kth", F.lit(None).cast("long"))
        if best is not None:
            kth = best.groupBy(*group).agg(F.when(F.count("*") >= top, F.min("value")).alias("kth"))
            pending = unseen.join(kth, group, "left")
        pending = pending.where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
        before = F.sum("terms").over(Window.partitionBy(*group).orderBy(F.col("bound").desc(), "bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("terms")
        chosen = stored(pending.withColumn("before", before).where(F.col("kth").isNotNull() | (F.col("before") < wanted)).select(*group, "bucket"))
        if best is not None and chosen.isEmpty():
            return best
        seen = sides(kept.withColumn("bucket", bucket).join(chosen, [*group, "bucket"])).select(*group, "term", distance(F.col("p"), F.col("q")).alias("value"))
        found = seen if best is None else best.unionByName(seen)
        best = stored(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place"))
        unseen, wanted = stored(unseen.join(chosen, [*group, "bucket"], "left_anti")), wanted * 8


def term_starts(rows: pa.Table) -> np.ndarray:
    """Where each (language, term) begins."""
    codes = [rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term")]
    changed = np.ones(rows.num_rows, bool)
    changed[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    return np.flatnonzero(changed)


def met(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For the pairs of sources that share a term: what the sums over either's terms lack, added up piece by piece."""
    f = lambda p, q: (p - q) * (p - q) // q
    langs, sources = (rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    n_sources = len(sources.dictionary)
    lang, source = langs.indices.to_numpy().astype(np.int64), sources.indices.to_numpy().astype(np.int64)
    p, p0 = rows.column("p").to_numpy(), rows.column("p0").to_numpy()
    sizes = np.diff(np.append(starts, rows.num_rows))
    begins, partners = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    total, first = np.cumsum(partners), 0
    while first < rows.num_rows:
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS_HELD, "right")))
        own = np.repeat(np.arange(first, last), partners[first:last])
        offset = np.arange(len(own)) - np.repeat(np.cumsum(partners[first:last]) - partners[first:last], partners[first:last])
        other = begins[own] + offset
        own, other = own[own != other], other[own != other]
        value = f(p[own], p[other]) - f(p[own], p0[other]) - f(p0[own], p[other]) + f(p0[own], p0[other])
        keys, value = summed((lang[own] * n_sources + source[own]) * n_sources + source[other], value)
        group = keys // n_sources
        held = [langs.dictionary.take(pa.array(group // n_sources)), sources.dictionary.take(pa.array(group % n_sources)), sources.dictionary.take(pa.array(keys % n_sources)), pa.array(value)]
        yield pa.RecordBatch.from_arrays(held, ["lang", "source", "item", "value"])
        first = last


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`met` over postings in order of (language, term); the last term of a batch waits for the next one's rows."""
    waiting = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
        starts = term_starts(rows)
        if len(starts) > 1:
            yield from met(rows.slice(0, starts[-1]), starts[:-1])
        waiting = rows.slice(starts[-1]) if len(starts) else None
    if waiting is not None:
        yield from met(waiting, np.zeros(1, np.int64))


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language, in both directions."""
    pair = ["lang", "source", "item"]
    other = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("item_held"), F.col("p0").alias("q0"))
    pairs = stored(groups.join(other, "lang").where("source <> item").select(*pair, "held", "item_held", "v", "p0", "q0"))
    counts = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    counts = stored(counts.join(groups.select("lang", "source", "size"), ["lang", "source"]).select("lang", "source", share(F.col("n"), F.col("size")).alias("p"), "terms"))
    value = lambda p, q: (F.col("terms") * distance(F.col(p), F.col(q))).alias("value")
    mine = counts.join(pairs.select(*pair, "q0"), ["lang", "source"]).select(*pair, value("p", "q0"))
    theirs = counts.withColumnRenamed("source", "item").join(pairs.select(*pair, "p0"), ["lang", "item"]).select(*pair, value("p0", "p"))
    # a term whose count is its language's has one source
    shared = kept.where("n < lang_n").join(groups.select("lang", "source", "size", "p0"), ["lang", "source"])
    shared = shared.select("lang", "term", "source", share(F.col("n"), F.col("size")).alias("p"), "p0")
    dealt = shared.repartition(partitions(kept), "lang", "term").sortWithinPartitions("lang", "term")
    common = dealt.mapInArrow(meet, "lang string, source string, item string, value long")
    sums = [part.groupBy(*pair).agg(F.sum("value").alias("value")) for part in (mine, theirs, common)]
    added = sums[0].unionByName(sums[1]).unionByName(sums[2]).groupBy(*pair).agg(F.sum("value").alias("found"))
    neither = F.when(F.col("v") > 0, (F.col("v") - F.col("held") - F.col("item_held")) * distance(F.col("p0"), F.col("q0"))).otherwise(F.lit(0))
    return pairs.join(added, pair, "left").select(*pair, (F.coalesce("found", F.lit(0)) + neither).cast("long").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for each other source, `term` rows to rank `top`."""
    kept, groups = counted_terms(docs, lang, source, text)
    terms = best_terms(kept, groups, top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    pairs = source_pairs(kept, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return pairs.unionByName(terms).withColumn("rank", F.row_number().over(order))
