"""Exact removal of repeated strings: suffixes put in order only through a depth, by most-significant-digit passes.

Each suffix counts up to its first tokens (its window); windows that are equal are what is looked for. Tokens are bytes,
with windows of `WINDOW` that are removed, and words, with windows of `PASSAGE` that are counted where they occur in other
texts, too. The passes run from coarse digits to fine ones, and a suffix that is alone in its group leaves at once:

1. The most significant digit is the group of a window's anchor, its gram of least hash. Neighbouring windows share it, so
   a stretch of windows (177 bytes of text) is dealt out as one row. Equal windows have equal anchors at equal places, so
   they stay together; anchors that occur once leave, which is nearly all.
2. Stretches that are equal as a whole (a 16-byte digest of all their tokens) are repeated throughout: copies and the
   insides of shared passages end here, however many there are, and one stretch stands for all in what follows.
3. Groups with several different stretches bring these together. Their suffixes are put in order by eight-byte digits (one
   word each for words), pass after pass, within the groups that the passes before left tied; groups that are still tied
   after the last digit of the window are exactly the repeated windows.

Stages 1 and 2 aggregate before they deal out, and their joins have both sides dealt out for them alone, so that a common
anchor can be split. An anchor with over `LARGE` different stretches is not brought together: its windows meet by a
16-byte digest of their tokens, through an aggregation that combines first. Whole texts that occur twice are repeated
throughout and settled by their address; a task sends one copy of a text for the others it reads. Text moves once, for
the texts with a repeated anchor, compressed.

Addresses are the first 16 bytes of SHA-256, digests BLAKE2b of 16 bytes: no two different texts or stretches are known
or expected to share one (a chance of 1e-18 among 1e10). Words are compared by 64-bit hashes.

Defined results. Null text: empty. Texts under a window: nothing is removed. Null and repeated ids: each row by its text.
Very long texts are read whole; a run of one byte is found like any other text. Empty table: empty result. Columns
beside the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Roller, checkpointed, counted, mix, partitions, pieces, released, stored, text_bytes, words

WINDOW, GRAM = 400, 48
PASSAGE, WORD_GRAM = 51, 6
LARGE = 100_000
#: Bytes of stretches that a worker sorts at once; groups stay whole.
SORTED_BYTES = 1 << 20
#: Addresses that a task remembers, so as to send copies once.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Unit:
    """What a token is, how many make a window and how many an anchor."""

    words: bool
    window: int
    gram: int

    def tokens(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in a row, and each text's first."""
        data, offsets = text_bytes(column)
        if not self.words:
            return data, offsets
        starts, ends, first = words(data, offsets)
        return Roller(data).hashes(starts, ends), first.astype(np.int64)

    def digits(self, tokens: np.ndarray) -> tuple[np.ndarray, int]:
        """The digit that starts at each token (big-endian, so that order is that of the bytes), and its tokens."""
        if self.words:
            return tokens, 1
        wide = np.concatenate((tokens, np.zeros(8, np.uint8))).astype(np.uint64)
        for shift in (1, 2, 4):
            wide[:-shift] = (wide[:-shift] << np.uint64(8 * shift)) | wide[shift:]
        return wide[: len(tokens)], 8


#: By number: bytes, whose windows are removed, and words.
UNITS = (Unit(False, WINDOW, GRAM), Unit(True, PASSAGE, WORD_GRAM))


def stretches(tokens: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor, anchor's hash), places in the buffer.

    A window's anchor is the leftmost of its grams of least hash; a stretch is a run of windows with one anchor.
    """
    none = np.zeros(0, np.int64)
    n, span = len(tokens), window - gram + 1
    if n < window:
        return (none,) * 4 + (none.view(np.uint64),)
    roller = Roller(tokens)
    grams = roller.every(gram)
    if len(grams) < n - gram + 1:
        grams = np.append(grams, roller.hashes(np.arange(len(grams), n - gram + 1), np.arange(len(grams) + gram, n + 1)))
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(keys) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    count = n - window + 1
    anchor = (np.minimum(ahead[:count], behind[span - 1 : span - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lengths = np.diff(offsets)
    held = np.maximum(lengths - window + 1, 0)
    rows = np.repeat(np.arange(len(lengths)), held)
    if not len(rows):
        return (none,) * 4 + (none.view(np.uint64),)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(held) - held, held) + offsets[rows]
    own = anchor[places]
    change = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (rows[1:] != rows[:-1]))))
    low, high, at = places[change], places[np.append(change[1:], len(places)) - 1], own[change]
    return rows[change], low, high, at, roller.hashes(at, at + gram)


def radix(tokens: np.ndarray, places: np.ndarray, groups: np.ndarray, unit: Unit = UNITS[0]) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes tied through a window with another of their group: their numbers, in order, and their tie's number.

    One pass a digit, from the most significant: groups whose digits differ are put in order by them and cut where they
    differ; suffixes left alone drop out.
    """
    digits, width = unit.digits(tokens)
    alive = np.argsort(groups, kind="stable")
    begins = np.concatenate(([True], np.diff(groups[alive]) != 0)) if len(alive) else np.zeros(0, bool)

    def without_singles(alive: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = ~(begins & np.append(begins[1:], True)) if len(begins) else begins
        alive, begins = alive[kept], begins[kept]
        return alive, np.cumsum(begins) - 1

    alive, tie = without_singles(alive, begins)
    at = places[alive]
    for depth in range(0, unit.window, width):
        if not len(alive):
            break
        digit = digits[at + min(depth, unit.window - width)]
        first = np.searchsorted(tie, np.arange(tie[-1] + 1))
        odd = np.flatnonzero(digit != digit[first][tie])
        if not len(odd):
            continue
        touched = np.zeros(len(first), bool)
        touched[tie[odd]] = True
        part = np.flatnonzero(touched[tie])
        order = part[np.lexsort((digit[part], tie[part]))]
        alive[part], digit[part] = alive[order], digit[order]
        begins = np.concatenate(([True], (tie[1:] != tie[:-1]) | (digit[1:] != digit[:-1])))
        alive, tie = without_singles(alive, begins)
        at = places[alive]
    return alive, tie


def covered(places: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) of the tokens under windows at sorted `places` of each owner."""
    if not len(places):
        return places, places, places
    first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (places[1:] > places[:-1] + window)))
    at = np.flatnonzero(first)
    return owner[at], places[at], places[np.append(at[1:], len(places)) - 1] + window


def source(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def _address(text: pa.Scalar) -> bytes:
    return hashlib.sha256(text.as_buffer()).digest()[:16]


def facts(rows: DataFrame) -> DataFrame:
    """(key, address, n_bytes, n_words, whole_sha256) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offsets = text_bytes(batch.column(1))
            whole = [hashlib.sha256(t.as_buffer()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([w.digest()[:16] for w in whole], pa.binary()), pa.array(np.diff(offsets)), pa.array(np.diff(words(data, offsets)[2])), pa.array([w.hexdigest() for w in whole])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "address", "n_bytes", "n_words", "whole_sha256"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, address binary, n_bytes long, n_words long, whole_sha256 string")


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], pa.Array]]:
    """Pieces of (addresses, texts) without texts that the task has met."""
    seen: set[bytes] = set()
    for batch in pieces(batches, "text"):
        new, own = [], []
        for i, text in enumerate(batch.column(0)):
            if (address := _address(text)) not in seen:
                new.append(i)
                own.append(address)
                seen.add(address)
        if len(seen) > REMEMBERED:
            seen.clear()
        yield own, batch.column(0).take(pa.array(new, pa.int64()))


def anchors(texts: DataFrame) -> DataFrame:
    """(anchor, place): the anchors of each text's stretches, and a hash of where each is; for words, of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for addresses, column in _fresh(batches):
            own = np.frombuffer(b"".join(a[:8] for a in addresses), np.uint64)
            for number, unit in enumerate(UNITS):
                tokens, offsets = unit.tokens(column)
                rows, low, _, _, anchor = stretches(tokens, offsets, unit.window, unit.gram)
                inside = np.zeros(len(low), np.uint64) if unit.words else (low - offsets[rows]).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(mix(anchor + np.uint64(number)).view(np.int64)), pa.array(mix(own[rows] + mix(inside)).view(np.int64))], ["anchor", "place"])

    return texts.select("text").mapInArrow(run, "anchor long, place long")


def occurrences(texts: DataFrame) -> DataFrame:
    """(anchor, unit, stretch, address, low, high): the stretches of each text, places in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for addresses, column in _fresh(batches):
            names = pa.array(addresses, pa.binary())
            for number, unit in enumerate(UNITS):
                tokens, offsets = unit.tokens(column)
                rows, low, high, _, anchor = stretches(tokens, offsets, unit.window, unit.gram)
                held = memoryview(np.ascontiguousarray(tokens).view(np.uint8))
                size = tokens.itemsize
                whole = [hashlib.blake2b(held[size * a : size * b], digest_size=16).digest() for a, b in zip(low.tolist(), (high + unit.window).tolist())]
                columns = [mix(anchor + np.uint64(number)).view(np.int64), np.full(len(rows), number, np.int8), pa.array(whole, pa.binary()), names.take(pa.array(rows)), (low - offsets[rows]).astype(np.int32), (high - offsets[rows]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["anchor", "unit", "stretch", "address", "low", "high"])

    return texts.select("text").mapInArrow(run, "anchor long, unit tinyint, stretch binary, address binary, low int, high int")


def packed_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(address, packed): the texts of the `wanted` (address, copy), compressed before they are dealt out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in pieces(batches, "text"):
            texts = list(batch.column(1))
            columns = [pa.array(map(_address, texts), pa.binary()), pa.array([compress(t.as_buffer()) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "address", "packed"])

    packed = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, address binary, packed binary")
    chosen = wanted.select(F.col("address").alias("of"), "copy")
    return packed.join(chosen, (F.col("address") == F.col("of")) & F.col("key").eqNullSafe(F.col("copy"))).select("address", "packed")


def _unpacked(column: pa.Array) -> list[bytes]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return [expand(x) for x in column.to_pylist()]


_BODY = {"anchor": pa.int64(), "unit": pa.int8(), "large": pa.bool_(), "twice": pa.bool_(), "address": pa.binary(), "low": pa.int32(), "body": pa.binary()}


def stretch_bodies(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(anchor, unit, large, twice, address, low, body): the tokens of the `chosen` stretches."""
    places = chosen.groupBy("address").agg(F.collect_list(F.struct("anchor", "unit", "low", "high", "large", "twice")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for address, text, held in zip(part.column(0).to_pylist(), _unpacked(part.column(1)), part.column(2).to_pylist()):
                    read: dict[int, bytes] = {0: text}
                    for p in held:
                        number = p["unit"]
                        if number not in read:
                            read[number] = UNITS[number].tokens(pa.array([text], pa.large_binary()))[0].tobytes()
                        size = 8 if UNITS[number].words else 1
                        out.append((p["anchor"], number, p["large"], p["twice"], address, p["low"], read[number][size * p["low"] : size * (p["high"] + UNITS[number].window)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _BODY.values())], list(_BODY))

    return texts.join(places, "address").select("address", "packed", "places").mapInArrow(run, "anchor long, unit tinyint, large boolean, twice boolean, address binary, low int, body binary")


def _windows(bodies: pa.Array, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined tokens, the start of each window in them, the body of each, and where each body starts."""
    data, offsets = text_bytes(bodies)
    if unit.words:
        data, offsets = data.copy().view(np.uint64), offsets // 8
    count = np.diff(offsets) - unit.window + 1
    owner = np.repeat(np.arange(len(count)), count)
    return data, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + offsets[owner], owner, offsets


_SPAN = "address binary, unit tinyint, start long, end long"
_SPANS = pa.schema([("address", pa.binary()), ("unit", pa.int8()), ("start", pa.int64()), ("end", pa.int64())])


def settled(group: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """Spans of the windows that recur in whole groups of stretches of one unit."""
    unit = UNITS[number]
    tokens, places, owner, offsets = _windows(group.column("body"), unit)
    alive, tie = radix(tokens, places, group.column("anchor").to_numpy()[owner], unit)
    if unit.words and len(alive):
        _, text = np.unique(np.array(group.column("address").to_pylist(), object), return_inverse=True)
        text, twice = text[owner[alive]], group.column("twice").to_numpy(zero_copy_only=False)[owner[alive]]
        first = np.searchsorted(tie, np.arange(tie[-1] + 1))
        other = np.logical_or.reduceat((text != text[first][tie]) | twice, first)
        alive = alive[other[tie]]
    alive = np.sort(alive)
    own, start, end = covered(places[alive], owner[alive], unit.window)
    shift = group.column("low").to_numpy()[own].astype(np.int64) - offsets[own]
    return pa.RecordBatch.from_arrays([group.column("address").take(pa.array(own)), pa.array(np.full(len(own), number, np.int8)), pa.array(start + shift), pa.array(end + shift)], schema=_SPANS)


def sorted_groups(rows: DataFrame, n: int) -> DataFrame:
    """Spans of repeated windows, by groups that are brought together and put in order."""
    dealt = rows.repartition(n, "anchor").sortWithinPartitions("anchor", "address", "low")

    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        numbers = table.column("unit").to_numpy()
        for number in range(len(UNITS)):
            if (own := numbers == number).any():
                yield settled(table.filter(pa.array(own)).combine_chunks().to_batches()[0], number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in pieces(batches, "body", SORTED_BYTES // 4):
            anchor = batch.column(0).to_numpy()
            if size >= SORTED_BYTES:
                cut = int(np.argmax(anchor != last)) if (anchor != last).any() else len(anchor)
                if cut:
                    held.append(batch.slice(0, cut))
                if cut == len(anchor):
                    continue
                yield from settle(held)
                held, size = [], 0
                batch = batch.slice(cut)
            held.append(batch)
            size += batch.nbytes
            last = batch.column(0)[batch.num_rows - 1].as_py()
        if held:
            yield from settle(held)

    return dealt.mapInArrow(run, _SPAN)


def digested_groups(rows: DataFrame) -> DataFrame:
    """The same spans for anchors with very many stretches: windows by a digest of their tokens, combined before dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "body", 1 << 18):
            numbers = batch.column("unit").to_numpy()
            for number, unit in enumerate(UNITS):
                if not (numbers == number).any():
                    continue
                own = batch.filter(pa.array(numbers == number))
                tokens, places, owner, offsets = _windows(own.column("body"), unit)
                held, size = memoryview(tokens.view(np.uint8)), tokens.itemsize
                whole = [hashlib.blake2b(held[size * a : size * (a + unit.window)], digest_size=16).digest() for a in places.tolist()]
                start = own.column("low").to_numpy()[owner].astype(np.int64) + places - offsets[owner]
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(whole, pa.binary()), own.column("unit").take(at), own.column("twice").take(at), own.column("address").take(at), pa.array(start)], ["window", "unit", "twice", "address", "start"])

    windows = rows.select("anchor", "unit", "twice", "address", "low", "body").mapInArrow(run, "window binary, unit tinyint, twice boolean, address binary, start long")
    place = F.struct("address", F.when(F.col("unit") == 0, F.col("start")).otherwise(F.lit(0)).alias("start"))
    again = windows.groupBy("window", "unit").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("twice").alias("t")).where("a <> b or (t and unit = 1)").select("window", "unit")
    size = F.when(F.col("unit") == 0, UNITS[0].window).otherwise(UNITS[1].window)
    return windows.join(again, ["window", "unit"], "left_semi").select("address", "unit", "start", (F.col("start") + size).alias("end"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(per document: key, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words; per address: spans and the kept text).

    The second holds the texts that lose some but not all of their bytes to repeated windows, as bytes. `n_repeated_words`
    counts the words under passages of `PASSAGE` words that also occur in another document.
    """
    n = partitions(docs)
    rows = source(docs, key, text)
    every = checkpointed(facts(rows))
    classes = checkpointed(every.groupBy("address").agg(F.count("*").alias("copies"), F.min("key").alias("copy")))
    again = stored(anchors(rows).groupBy("anchor").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("anchor"))
    found = stored(occurrences(rows).join(again, "anchor", "left_semi"))
    place = F.struct("address", "low", "high")
    kinds = found.groupBy("anchor", "unit", "stretch").agg(F.min(place).alias("one"), F.max(place).alias("other"))
    kinds = stored(kinds.select("anchor", "unit", "stretch", "one", F.when(F.col("unit") == 0, F.col("one") != F.col("other")).otherwise(F.col("one.address") != F.col("other.address")).alias("twice")))
    size = F.when(F.col("unit") == 0, F.lit(UNITS[0].window)).otherwise(F.lit(UNITS[1].window)).cast("long")
    full = found.join(kinds.where("twice").select("anchor", "stretch"), ["anchor", "stretch"], "left_semi")
    full = full.select("address", "unit", F.col("low").cast("long").alias("start"), (F.col("high") + size).alias("end"))
    several = stored(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > LARGE).alias("large")))
    chosen = kinds.join(several, "anchor").select("anchor", "unit", "large", "twice", "one.address", "one.low", "one.high")
    wanted = found.select("address").distinct().join(classes, "address").select("address", "copy")
    texts = stored(packed_texts(rows, wanted))
    bodies = stretch_bodies(texts, chosen)
    spans = full.unionByName(sorted_groups(bodies.where("not large"), n))
    if counted(several.where("large")):
        spans = spans.unionByName(digested_groups(bodies.where("large")))
    per = spans.groupBy("address").agg(F.sort_array(F.collect_set(F.struct("unit", "start", "end"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for address, whole, held in zip(part.column(0).to_pylist(), _unpacked(part.column(1)), part.column(2).to_pylist()):
                    merged: list[list[list[int]]] = [[] for _ in UNITS]
                    for span in held:
                        own = merged[span["unit"]]
                        if own and span["start"] <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], span["end"])
                        else:
                            own.append([span["start"], span["end"]])
                    edges = [0, *[x for m in merged[0] for x in m], len(whole)]
                    kept = b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    out.append((address, len(whole) - len(kept), len(merged[0]), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in merged[1]), merged[0], kept))
                types = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names = ["address", "n_removed", "n_spans", "kept_sha256", "n_repeated_words", "spans", "kept"]
    cut = texts.join(per, "address").select("address", "packed", "spans").mapInArrow(run, "address binary, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long, spans array<array<long>>, kept binary")
    cut = checkpointed(cut.dropDuplicates(["address"]))
    merged = checkpointed(classes.join(cut.drop("spans", "kept"), "address", "left").withColumnRenamed("address", "of"))
    released(again, found, kinds, several, texts, classes)
    out = every.join(merged, F.col("address") == F.col("of"))
    twice = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    return out.select(
        F.col("key").alias(key),
        "n_bytes",
        F.when(twice, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(twice, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(twice, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when((F.col("copies") > 1) & (F.col("n_words") >= PASSAGE), F.col("n_words")).otherwise(F.coalesce("n_repeated_words", F.lit(0))).cast("long").alias("n_repeated_words"),
    ), cut.where("n_removed > 0")
