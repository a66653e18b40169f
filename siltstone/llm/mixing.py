"""Mixing sources to target weights by systematic sampling.

Within a source, expected copies are summed up document by document; one random offset per source is added to that prefix
sum, and a document is emitted once for each whole number that its stretch of the sum crosses. Documents that hold over
1/64 of their source's words (fewer than 64 a source) come first, each expected target / size of its source times; the
sum then goes on over the others in order of size, whose expected copies share what the first ones leave of the target.
So a source with one giant document comes near its target, too, and the order by size keeps the others within one of
their documents of it.

The prefix sum runs over a range partitioning by (source, size, key), which splits a hot source by size and a hot size by
key: each partition numbers its own rows, counts per partition and source are summed up, and no task sees a whole source.
The number of sources is taken to be small enough to sort in one task, as each is one row there.

Defined results. Null text: size 0. Null source: a source of its own, last in order. Documents of size 0 are sampled like
others and take no words. Repeated rows: each is sampled for itself. A source without words has target 0. Empty table:
empty result. Reruns agree: the offset is a hash of the seed and the source, and the order is total up to equal rows.
Columns beside the three named ones are kept only by `mix_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import SEPARATOR, checkpointed, partitions, pieces, private, text_bytes

CAP = 3
HEAVY = 64
WEIGHTS = (1, 2, 3)


def word_counts(array: pa.Array) -> np.ndarray:
    """Words `[^\\x20\\x09-\\x0D]+` of each text."""
    data, offsets = text_bytes(array)
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    inside = ~SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    total = np.concatenate(([0], np.cumsum(begins)))
    return total[offsets[1:]] - total[offsets[:-1]]


def sized(docs: DataFrame, key: str, source: str, text: str, tie: str | None = None) -> DataFrame:
    """(key, source, size) of each document, and its `tie` if that column is named."""
    more = [F.col(f"`{tie}`").alias("tie")] if tie else []
    picked = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(word_counts(batch.column(2))), *batch.columns[3:]], ["key", "source", "size", *["tie"] * bool(tie)])

    return picked.mapInArrow(run, f"key {picked.schema['key'].dataType.simpleString()}, source {picked.schema['source'].dataType.simpleString()}, size long" + ", tie string" * bool(tie))


def targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): shares by weight, stopped at `cap` times the source, the excess shared again.

    That is filling to a level: target = min(cap * size, level * weight). In order of cap * size / weight, a source is
    stopped if the level over what the sources before it leave would exceed its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")).cast("long"))
    ceiling = F.col("source_size") * cap
    by = Window.orderBy((ceiling / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({"left_size": F.sum("source_size").over(every) - F.sum(ceiling).over(by) + ceiling, "left_weight": F.sum("weight").over(every) - F.sum("weight").over(by) + F.col("weight")})
    per = per.withColumn("stopped", F.col("left_size") * F.col("weight") > ceiling * F.col("left_weight"))
    free = lambda c: F.sum(F.when(~F.col("stopped"), c)).over(every)
    stopped = F.sum(F.when(F.col("stopped"), ceiling).otherwise(0)).over(every)
    level = (F.sum("source_size").over(every) - stopped).cast("double") * F.col("weight") / free(F.col("weight"))
    return per.select("source", "source_size", F.when(F.col("stopped"), ceiling.cast("double")).otherwise(level).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) that only the seed and the source determine."""
    digest = F.md5(F.concat(F.lit(f"{seed}"), F.coalesce(source, F.lit("\0null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def crossings(place: Column, rate: Column, start: Column) -> Column:
    """Whole numbers crossed from the prefix sum before the `place`th (from 0) document to the one after it."""
    return (F.floor(start + (place + 1) * rate) - F.floor(start + place * rate)).cast("long")


def sample(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, tie: str | None = None) -> DataFrame:
    """(key, source, size, source_size, target, copies) of each document; a text column `tie` orders equal keys and is kept."""
    order = ["source", "size", "key", *["tie"] * bool(tie)]
    n = partitions(docs)
    base = sized(docs, key, source, text, tie).repartitionByRange(n, *order).sortWithinPartitions(*order)
    base = checkpointed(base.withColumn("at", F.monotonically_increasing_id()))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    goal = targets(base)
    rows = base.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumns({"heavy": F.col("size") * HEAVY > F.col("source_size"), "part": F.shiftright("at", 33)})
    cells = rows.groupBy("part", "source", "heavy").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    cells = cells.withColumn("before", F.sum("n").over(Window.partitionBy("source", "heavy").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    cells = cells.select(F.col("part").alias("p"), F.col("source").alias("s"), F.col("heavy").alias("h"), "first", "before")
    rows = rows.join(cells, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("heavy") == F.col("h")))
    rows = rows.withColumn("place", F.col("before") + F.col("at") - F.col("first")).drop("p", "s", "h", "first", "before", "part", "at")
    whole = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = rows.where("heavy").withColumn("copies", crossings(F.col("place"), whole, offset(F.col("source"), seed)))
    spent = drawn.groupBy("source").agg(F.count("*").alias("heavy_n"), F.sum("size").alias("heavy_size"), F.sum(F.col("copies") * F.col("size")).alias("heavy_taken"))
    light = rows.where(~F.col("heavy")).join(spent.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    left, size = F.col("target") - F.coalesce("heavy_taken", F.lit(0)), F.col("source_size") - F.coalesce("heavy_size", F.lit(0))
    rate = F.when(size > 0, F.least(F.greatest(left / size, F.lit(0.0)), F.lit(float(CAP)))).otherwise(F.lit(0.0))
    start = offset(F.col("source"), seed) + F.coalesce("heavy_n", F.lit(0)) * whole
    light = light.withColumn("copies", crossings(F.col("place"), rate, start)).drop("heavy_n", "heavy_size", "heavy_taken")
    return drawn.unionByName(light).select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies", *([F.col("tie").alias(tie)] if tie else []))


def mix_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7) -> DataFrame:
    """The mix itself: each document's row as often as it is drawn, columns unchanged.

    Draws are matched by a digest of the whole row, so keys may be null or repeated. Rows that are equal in all columns
    cannot be told apart: together they are emitted as often as their draws add up to.
    """
    row, held, copy = private(docs, "drawn_row", "drawn_copies", "drawn_copy")
    whole = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"}), 256)
    told = docs.withColumn(row, whole)
    draws = sample(told, key, source, text, seed, row).where("copies > 0").groupBy(row).agg(F.sum("copies").alias(held))
    joined = told.dropDuplicates([row]).join(draws, row)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(held).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
