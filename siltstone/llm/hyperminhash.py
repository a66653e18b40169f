"""Near-duplicate documents by HyperMinHash, with exact confirmation.

1. One pass turns each whole text into its set of word shingles, the set's address and its sketch: shingle hashes fall
   into `REGISTERS` buckets, and a bucket stores its least hash as a count of leading zeros (4 bits) and a mantissa (12
   bits). Equal sets are one class from here on, so copies of any number cost one row per task.
2. Bands of `ROWS` registers are hashed to keys; bands without a filled register are left out. At a similarity of 0.8
   the chance to share no band is below 2e-8, and sets of a few shingles share all but the band of what differs.
   Unrelated texts agree on a band with a chance of about 3e-21, which leaves few such pairs even among 1e10 texts.
3. Each key's members are paired with a leader, which depends on the key, never with each other. Pairs pass the
   collision-corrected estimate of their sketches, five standard errors below the threshold, and are then confirmed on the
   full sets of their texts. Links give first components.
4. Keys whose members still lie in different components give, a few times, pairs of such members with their hub, the
   member of most links. What is then left across components is compared in full: directly in keys of few members, and by
   an exact prefix join on the rarest shingles in larger ones.

So a linked pair is missed only if it shares no band, and large groups of near copies cost rows in proportion to their
size. Text moves once, compressed, for classes that share a key. Pairs are broadcast only if their count was checked.

Defined results. Null or wordless text: an empty set, linked with nothing. Texts shorter than a shingle: the whole
sequence is one. Null id: not linked; component null and kept true. Rows repeated with one id: the same component, all
kept or none. Empty table: empty result. Columns beside the id and the text are not read by `near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, counted, mix, partitions, pieces, released
from siltstone.llm.components import components, merged
from siltstone.llm.shingles import digest, shingle_sets

WIDTH = 5
PERCENT = 80
BANDS, ROWS = 45, 5
REGISTERS = BANDS * ROWS
MANTISSA = 12
#: Rows of ids that are broadcast at most; tables with more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Distinct leader orders over the keys.
LEADERS = 5
#: Keys with at most so many members give all their pairs across components.
SMALL = 16
#: Rounds of pairs with hubs.
HUBS = 2


def sketch(shingles: np.ndarray) -> np.ndarray:
    """16 bits per register: 0 if empty, else 1 + 4096 * leading zeros (14 at most) + mantissa."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(shingles):
        return out
    mixed = mix(shingles)
    bucket = ((mixed >> np.uint64(40)) * np.uint64(REGISTERS) >> np.uint64(24)).astype(np.int64)
    value = mixed & np.uint64((1 << 40) - 1)
    order = np.lexsort((value, bucket))
    bucket, value = bucket[order], value[order]
    first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    least = value[first].astype(np.int64)
    length = np.where(least > 0, np.floor(np.log2(np.maximum(least, 1))).astype(np.int64) + 1, 0)
    zeros = np.minimum(40 - length, 14)
    # below the leading one, or below the 14 zeros where there are more
    kept = np.where(zeros < 14, least - (np.int64(1) << np.maximum(length - 1, 0)), least)
    shift = np.where(zeros < 14, length - 1, 26) - MANTISSA
    out[bucket[first]] = 1 + (zeros << MANTISSA) + (kept >> np.maximum(shift, 0))
    return out


def sketched(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n_shingles, address, registers) of each document."""
    kind = docs.select(F.col(f"`{key}`")).schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "read_text", 256 << 10):
            sizes, addresses, registers = [], [], []
            for held in shingle_sets(batch.column(1), width):
                sizes.append(len(held))
                addresses.append(digest(held))
                registers.append(sketch(held).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(addresses, pa.binary()), pa.array(registers, pa.binary())], ["key", "n_shingles", "address", "registers"])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("read_text")).mapInArrow(run, f"key {kind}, n_shingles long, address binary, registers binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def band_keys(classes: DataFrame) -> DataFrame:
    """(band, node): the hash of each band that holds a filled register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                bands = _registers(part.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
                filled = bands.any(2)
                keys = mix(np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1))
                keys = np.broadcast_to(keys, filled.shape).copy()
                for r in range(ROWS):
                    keys = mix(keys * np.uint64(65537) + bands[:, :, r])
                nodes = np.broadcast_to(part.column(0).to_numpy()[:, None], filled.shape)
                yield pa.RecordBatch.from_arrays([pa.array(keys[filled].view(np.int64)), pa.array(nodes[filled])], ["band", "node"])

    return classes.select("node", "registers").mapInArrow(run, "band long, node long")


#: Where the counts of leading zeros change, from 14 or more to none.
_EDGES = np.concatenate(([0.0], 2.0 ** -np.arange(14, -1, -1.0)))


def accidental(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The chance that two filled registers of unrelated sets are equal: equal leading zeros, then equal mantissas."""

    def spread(sizes: np.ndarray) -> np.ndarray:
        above = (1 - _EDGES[None, :]) ** np.maximum(sizes[:, None] / REGISTERS, 1.0 / REGISTERS)
        p = above[:, :-1] - above[:, 1:]
        return p / p.sum(1, keepdims=True)

    return (spread(n_a) * spread(n_b)).sum(1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, registers it rests on): equal registers, less those that are equal by accident."""
    either, equal = ((a > 0) | (b > 0)).sum(1), ((a > 0) & (a == b)).sum(1)
    chance = accidental(n_a, n_b)
    rate = equal / np.maximum(either, 1)
    return np.clip((rate - chance) / (1 - chance), 0, 1), either


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate is at most five standard errors below the threshold."""
    side = lambda s: classes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    least = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                found, held = estimate(_registers(part.column(4)), _registers(part.column(5)), part.column(2).to_numpy(), part.column(3).to_numpy())
                yield part.filter(pa.array(found >= least - 5 * np.sqrt(least * (1 - least) / np.maximum(held, 1)) - 1e-9)).select([0, 1])

    return joined.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def few(rows: DataFrame, n: int | None = None) -> DataFrame:
    """The table, to be broadcast where its rows were counted and are few."""
    return F.broadcast(rows) if (counted(rows) if n is None else n) <= BROADCAST_ROWS else rows


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold. Each pair's two texts meet in one place."""
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    held = texts.join(few(sides, 2 * counted(pairs)), "node").select("a", "b", "node", "packed")
    met = held.repartition(partitions(texts), "a", "b").sortWithinPartitions("a", "b", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, np.zeros(0, np.uint64)
        for batch in pieces(batches, "packed", 256 << 10):
            found = []
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), shingle_sets(unpacked(batch.column(3)), width))
            for a, b, node, held in rows:
                if last == (a, b) and node == b:
                    shared = len(np.intersect1d(before, held, assume_unique=True))
                    if shared and 100 * shared >= percent * (len(before) + len(held) - shared):
                        found.append((a, b))
                elif node == a:
                    last, before = (a, b), held
            columns = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def unpacked(column: pa.Array) -> pa.Array:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return pa.array([expand(x) for x in column.to_pylist()], pa.large_binary())


def class_texts(docs: DataFrame, nodes: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(node, packed) of the classes in `nodes` (node, key, address): the text of the document that represents each."""
    source = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("key is not null")
    kind = source.schema["key"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([compress(t.as_buffer()) for t in batch.column(1)], pa.binary())], ["key", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "packed", 256 << 10):
            same = [digest(held) == address for held, address in zip(shingle_sets(unpacked(batch.column(1)), width), batch.column(2).to_pylist())]
            yield batch.filter(pa.array(same, pa.bool_())).select([0, 1])

    return source.mapInArrow(pack, f"key {kind}, packed binary").join(nodes, "key").select("node", "packed", "address").mapInArrow(run, "node long, packed binary")


def shingle_rows(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, n_shingles, component, shingle) of the `nodes` (node, n_shingles, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "packed", 256 << 10):
            sets = list(shingle_sets(unpacked(batch.column(3)), width))
            owners = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(owners) for i in range(3)), pa.array(np.concatenate(sets).view(np.int64))], ["node", "n_shingles", "component", "shingle"])

    joined = texts.join(few(nodes), "node").select("node", "n_shingles", "component", "packed")
    return joined.mapInArrow(run, "node long, n_shingles long, component long, shingle long")


def _alike(percent: int):
    return 100 * F.least("x.n_shingles", "y.n_shingles") >= percent * F.greatest("x.n_shingles", "y.n_shingles")


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """`members` (band, node, n_shingles) with `component`, of bands whose members lie in different ones, with `held`, their number."""
    rows = members.join(labels, "node", "left").select("band", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    mixed = rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("held")).where("low <> high")
    return checkpointed(rows.join(mixed.select("band", "held"), "band"))


def hub_pairs(rows: DataFrame, links: DataFrame, salt: int) -> DataFrame:
    """Members of mixed bands with their band's hub, the member of most links so far, where it lies elsewhere."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    weight = F.coalesce("links", F.lit(0)) * (1 + F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(1000 if salt else 1)))
    ranked = rows.join(ends, "node", "left").withColumn("weight", weight)
    hubs = ranked.groupBy("band").agg(F.max(F.struct("weight", "node", "component")).alias("hub")).select("band", F.col("hub.node").alias("hub"), F.col("hub.component").alias("of"))
    met = rows.join(hubs, "band").where("component <> of")
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def across(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) across components that are left to compare: all of them in bands of few members, and those that an
    exact prefix join finds among the members of larger bands.

    Shingles are put in order from the rarest. Two sets that reach the threshold have their first common shingle among
    the first n - ceil(p * n) + 1 of both, and so early that what follows it can still make up the overlap. Heavily edited
    copies begin with shingles that few others have, so they meet few others, however many copies there are.
    """
    pair = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
    small = rows.where(F.col("held") <= SMALL)
    apart = F.col("x.component") != F.col("y.component")
    near = small.alias("x").join(small.alias("y"), (F.col("x.band") == F.col("y.band")) & apart & (F.col("x.node") < F.col("y.node")) & _alike(percent)).select(*pair)
    nodes = checkpointed(rows.where(F.col("held") > SMALL).select("node", "n_shingles", "component").distinct())
    by = Window.partitionBy("shingle")
    counted = shingle_rows(texts, nodes, width).withColumn("df", F.count("*").over(by))
    order = Window.partitionBy("node").orderBy("df", "shingle")
    kept = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    prefix = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= kept)
    # every pair across components has a side outside the component that most of a shingle's rows share
    own = F.count("*").over(Window.partitionBy("shingle", "component"))
    prefix = prefix.withColumn("own", own)
    ends = {"low": F.min("component").over(by), "high": F.max("component").over(by), "main": F.max(F.struct("own", "component")).over(by)}
    prefix = checkpointed(prefix.withColumns(ends).where("low <> high").select("shingle", "node", "n_shingles", "component", "place", F.col("main.component").alias("main")))
    rest = lambda s: F.col(f"{s}.n_shingles") - F.col(f"{s}.place") + 1
    enough = (100 + percent) * F.least(rest("x"), rest("y")) >= percent * (F.col("x.n_shingles") + F.col("y.n_shingles"))
    outside = prefix.where("component <> main")
    many = outside.alias("x").join(prefix.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & apart & _alike(percent) & enough).select(*pair)
    return near.unionByName(many).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each document."""
    every = checkpointed(sketched(docs, key, text, width))
    linkable = every.where("key is not null and n_shingles > 0")
    classes = linkable.groupBy("address").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    named = classes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))
    bands = band_keys(classes)
    # turning some bits of the nodes' numbers gives each leader order, and the leader back from the least number
    turn = F.xxhash64(F.pmod("band", F.lit(LEADERS))).bitwiseAND(F.lit((1 << 62) - 1))
    shared = bands.groupBy("band").agg(F.count("*").alias("held"), F.min(F.col("node").bitwiseXOR(turn)).alias("first"))
    shared = shared.where("held > 1").select("band", F.col("first").bitwiseXOR(turn).alias("leader"))
    members = checkpointed(bands.join(shared, "band"))
    classes = checkpointed(classes.join(members.select("node").distinct(), "node", "left_semi"))
    texts = checkpointed(class_texts(docs, classes.select("node", "key", "address"), key, text, width))
    stars = members.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        likely = checkpointed(plausible(pairs, classes, percent))
        links = checkpointed(confirmed(likely, texts, width, percent))
        released(likely)
        return links

    links = linked(stars)
    found = checkpointed(components(links))
    rows = labelled(members.select("band", "node").join(classes.select("node", "n_shingles"), "node"), found)
    for salt in range(HUBS):
        more = linked(hub_pairs(rows, links, salt).join(links, ["a", "b"], "left_anti")) if counted(rows) else None
        if more is None or not counted(more):
            break
        links = links.unionByName(more)
        last, found = found, checkpointed(merged(found, more))
        # bands within one component stay so
        before, rows = rows, labelled(rows.select("band", "node", "n_shingles"), found)
        released(last, before)
    if counted(rows):
        more = linked(across(rows, texts, width, percent))
        if counted(more):
            found = checkpointed(merged(found, more))
    own = named.select("node", "address", F.col("key").alias("own")).join(found, "node", "left")
    least = own.where("component is not null").groupBy("component").agg(F.min("own").alias("least"))
    named = checkpointed(own.join(least, "component", "left").select("address", F.coalesce("least", "own").alias("class_component")))
    released(classes, texts, rows)
    out = every.select("key", "n_shingles", "address").join(named, "address", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("key").isNotNull(), F.col("class_component"))).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that stay: one of each group of near duplicates. Columns are unchanged.

    Rows that repeat one key and text stay once; rows without a key all stay. Only ids move, unless there are very many.
    Columns may have any names. Empty table: empty result.
    """
    id_, own = F.col(f"`{key}`"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(id_.alias("key"), F.col(f"`{text}`").alias("text"), own)
    found = near_duplicates(rows, "key", "text", width, percent).where("key is not null")
    found = checkpointed(found.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("n"), F.max("kept").alias("stays")))
    gone, again = found.where("not stays").select("of"), found.where("stays and n > 1").select("of")
    same = F.col("key") == F.col("of")
    once = rows.select("key", "row").join(few(gone.unionByName(again)), same, "left_anti")
    twice = rows.join(few(again), same, "left_semi").dropDuplicates(["key", "text"])
    return once.select("row.*").unionByName(twice.select("row.*"))
