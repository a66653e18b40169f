"""Packing documents into fixed-length training sequences by the sum-of-squares rule.

A document's full-length stretches are sequences of their own; its rest goes online to the fill level that keeps the sum
of squared counts of partially filled windows least (ties: the fullest), tracked in an array with one count per level.
The rule keeps many different levels in stock, so later rests find a gap of their size. At the end of a partition, or
when `MAX_OPEN` windows are open, windows that lack at most 1/64 are closed and padded; the pieces of all others are cut
and joined end to end, so that one window of a partition at most keeps more padding than that.

Each input partition is packed by itself, as its rows stream: no shuffle, and memory bounded by `MAX_OPEN` windows. The
sequence ids hold the partition's number, and a lost task that is run again makes the same rows from the same split.

Defined results. Null text: an empty text, which is the closing id alone. Null and repeated keys are carried as they are,
each row its own document. Empty table: empty result. Very long texts give many full sequences. Columns beside the key
and the text are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import pieces

LENGTH = 2048
CLOSING_ID = 1
MAX_OPEN = 4096
#: Units whose ids a worker keeps; texts have so many that occur once that keeping more hardly saves time.
CACHED = 1 << 16

_SPACED = re.compile(r" (?:\s|\Z)")


# Fixed value: the pattern of byte-level pre-tokenizers that use their own regular expression.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(other)}


def _ranked(data: dict) -> dict[bytes, int] | None:
    """The file's vocabulary as bytes to ids, if it is byte-level BPE whose ids follow the order of its merges."""
    model, pre = data["model"], data["pre_tokenizer"] or {}
    if model.get("type") != "BPE" or data["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    byte, vocabulary = _byte_of(), model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(vocabulary.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)):
        return None
    added = {t["content"] for t in data["added_tokens"]}
    return {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if word not in added}


class Ids:
    """Token ids as little-endian unsigned 32-bit bytes.

    Where the file is plain byte-level BPE, whose ids are its merge ranks, a faster library encodes with the same ranks.
    The pre-tokenizer always cuts before a single space that a word follows, so such stretches encode alone as they do in
    the text; they are few and recur, and a bounded table keeps their ids. Texts with a space before other white space are
    encoded whole. Texts that hold an added token (an end-of-text marker, say), and all texts of any other file, are
    encoded whole by the file's own library, which gives an added token its id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.own = path, None
        data = json.loads(Path(path).read_text())
        ranks = _ranked(data)
        added = "|".join(re.escape(t["content"]) for t in data["added_tokens"])
        self.special = re.compile(added if ranks and added else r"(?!)" if ranks else "", re.IGNORECASE)
        if ranks:
            import tiktoken

            self.encode = tiktoken.Encoding(Path(path).stem, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
        return array("I", self.own.encode(text, add_special_tokens=False).ids).tobytes()

    def _bytes(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHED:
            self.known.clear()
        known = self.known
        odd = [self.special.search(t) is not None for t in texts]
        cut = [None if own or "\0" in t or _SPACED.search(t) else t.replace(" ", "\0 ").split("\0") for t, own in zip(texts, odd)]
        for unit in {u for units in cut if units is not None for u in units if u not in known}:
            known[unit] = self._bytes(unit)
        return [b"".join(map(known.__getitem__, units)) if units is not None else self._whole(t) if own else self._bytes(t) for t, units, own in zip(texts, cut, odd)]


class Packer:
    """Online sum-of-squares packing. Pieces are (document's number, first id, ids as bytes)."""

    def __init__(self, length: int = LENGTH):
        self.length, self.slack = length, length // 64
        self.counts = np.zeros(length + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(length + 1)]
        self.n_open = self.next_id = 0

    def add(self, document, ids: bytes) -> Iterator[tuple]:
        """Closed pieces: (document, first id, ids, sequence, place in it)."""
        total, full = len(ids) // 4, self.length
        for start in range(0, total - full + 1, full):
            yield document, start, ids[4 * start : 4 * (start + full)], self.next_id, 0
            self.next_id += 1
        rest = total % full
        if rest:
            yield from self._place((document, total - rest, ids[4 * (total - rest) :]), rest)
        if self.n_open > MAX_OPEN:
            yield from self.drain()

    def level_for(self, size: int) -> int:
        """The level that a piece of `size` goes to; 0 is a new window."""
        fits, after = self.counts[: self.length - size + 1], self.counts[size:]
        change = 2 * after + 1
        change[-1] = 0  # a full window is no longer partial
        change[1:] -= 2 * fits[1:] - 1
        change[1:][fits[1:] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def _place(self, piece: tuple, size: int) -> Iterator[tuple]:
        level = self.level_for(size)
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.length:
            yield from self._close(window)
        else:
            self.open[level + size].append(window)
            self.counts[level + size] += 1
            self.n_open += 1

    def _close(self, window: list) -> Iterator[tuple]:
        at = 0
        for document, start, ids in window:
            yield document, start, ids, self.next_id, at
            at += len(ids) // 4
        self.next_id += 1

    def drain(self) -> Iterator[tuple]:
        held, at = [], 0
        for level in range(self.length - 1, 0, -1):
            for window in self.open[level]:
                if level >= self.length - self.slack:
                    yield from self._close(window)
                    continue
                for document, start, ids in window:
                    while len(ids) // 4 > self.length - at:
                        room = self.length - at
                        held.append((document, start, ids[: 4 * room]))
                        yield from self._close(held)
                        held, at, start, ids = [], 0, start + room, ids[4 * room :]
                    held.append((document, start, ids))
                    at += len(ids) // 4
                    if at == self.length:
                        yield from self._close(held)
                        held, at = [], 0
            self.open[level] = []
        if held:
            yield from self._close(held)
        self.counts[:] = 0
        self.n_open = 0


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, closing: int = CLOSING_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids on request."""
    kind = docs.select(F.col(f"`{key}`")).schema.fields[0].dataType.simpleString()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def rows(closed: list[tuple], base: int, key_type: pa.DataType) -> pa.RecordBatch:
        lengths = [len(ids) // 4 for _, _, ids, _, _ in closed]
        columns = [
            pa.array([d[0] for d, *_ in closed], key_type),
            pa.array([start for _, start, *_ in closed], pa.int64()),
            pa.array(lengths, pa.int64()),
            pa.array([zlib.crc32(ids) for _, _, ids, _, _ in closed], pa.int64()),
            pa.array([d[1] for d, *_ in closed], pa.int64()),
            pa.array([base + s for *_, s, _ in closed], pa.int64()),
            pa.array([at for *_, at in closed], pa.int64()),
        ]
        if with_ids:
            ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids for _, _, ids, _, _ in closed), "<i4"))))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Ids(tokenizer), Packer(length)
        base, end = TaskContext.get().partitionId() << 33, np.array([closing], "<u4").tobytes()
        closed, key_type = [], None
        for batch in pieces(batches, "packed_text", 256 << 10):
            key_type = batch.schema.field(0).type
            for name, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                closed += packer.add((name, len(ids) // 4), ids)
            if closed:
                yield rows(closed, base, key_type)
                closed = []
        closed += packer.drain()
        if closed:
            yield rows(closed, base, key_type)

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("packed_text")).mapInArrow(run, schema)


def sequences(packed: DataFrame, length: int = LENGTH, padding: int = 0) -> DataFrame:
    """(sequence_id, ids, n_padding) out of pieces with ids. A sequence whose length is a power of two is not padded."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
    size = F.size("ids")
    lacking = F.when(F.bit_count(size) == 1, 0).otherwise(length - size)
    return ids.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(padding), lacking)).alias("ids"), lacking.alias("n_padding"))
