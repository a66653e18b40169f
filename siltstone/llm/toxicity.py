"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's distinct words and their leading 3 to 8 bytes, hashed to 2**22 places, ASCII and Latin-1 letters without
regard to case. The machine adds a weight per term and an inner product of learned vectors per pair of terms, so that an
insult beside a group's name can weigh more than the two alone. It is fitted on the driver to a bounded sample of labelled
documents (`SAMPLE` of each label, chosen by a hash of the id), over the `SELECTED` terms that tell the labels apart
best and the `PARTNERS` terms that tell most in company of another and not alone; scoring is one pass over whole texts
without a shuffle, and the model that tasks receive has a fixed size.

Defined results. Null or empty text: the score of a text without terms. Null id: scored, never learned from, not held out.
Null label: not learned from. With no labelled rows, or one label only, the score is the share of label 1 (0 for none).
Repeated ids count once in the sample. Very long texts are scored whole. Columns beside the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import LOWER, Roller, pieces, text_bytes

BITS = 22
#: Labelled documents of each label that the model is fitted on, at most.
SAMPLE = 3000
SELECTED = 4096
#: Terms that are tried in pairs (the most frequent of the sample), and those taken for what they tell in pairs, at most.
PAIRED = 8192
PARTNERS = 1024
#: Chi-square that the joint presence of two terms has beyond that of either.
JOINT = 40
FACTORS = 6
PREFIXES = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.7


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII capitals and the Latin-1 capitals of UTF-8 as small letters."""
    out = LOWER[data]
    if len(data):
        lead = np.concatenate(([False], data[:-1] == 0xC3)) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        out[lead] += 0x20
    return out


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of letters; runs end with their row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = _LETTER[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & (first | ~np.concatenate(([False], inside[:-1]))))
    last = np.concatenate((first[1:], [True])) | ~np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place of the hashed term), with repeats."""
    data = folded(data)
    starts, ends, rows = letter_runs(data, offsets)
    roller = Roller(data)
    all_rows, places = [rows], [roller.hashes(starts, ends) >> np.uint64(64 - BITS)]
    for n in PREFIXES:
        long = ends - starts > n
        at = starts[long]
        all_rows.append(rows[long])
        places.append((roller.hashes(at, at + n) ^ np.uint64(n << 58)) >> np.uint64(64 - BITS))
    return np.concatenate(all_rows), np.concatenate(places).astype(np.int64)


@dataclass
class Machine:
    #: Slot of each hashed place, -1 for places that were not selected.
    slots: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, rows: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        """Scores of n rows from their distinct (row, slot) pairs."""
        linear = np.bincount(rows, self.weights[slots], n)
        pairs = np.zeros(n)
        for v in self.vectors.T:
            pairs += np.bincount(rows, v[slots], n) ** 2 - np.bincount(rows, v[slots] ** 2, n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + 0.5 * pairs, -30, 30)))

    def score_texts(self, array: pa.Array) -> np.ndarray:
        rows, places = terms(*text_bytes(array))
        slots = self.slots[places]
        known = slots >= 0
        pairs = np.unique(rows[known] * np.int64(len(self.weights) + 1) + slots[known])
        return self.scores(pairs // (len(self.weights) + 1), pairs % (len(self.weights) + 1), len(array))


def constant(share: float) -> Machine:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Machine(np.full(1 << BITS, -1, np.int16), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, 1)))


def told(hit: np.ndarray, miss: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Chi-square of presence in `hit` of n1 and `miss` of n0 rows."""
    both = (hit + miss) / (n1 + n0)
    return (hit / n1 - miss / n0) ** 2 / (both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)


def partners(rows: np.ndarray, places: np.ndarray, positive: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Places of terms whose joint presence with another tells `JOINT` more than either alone, the most telling first."""
    count = np.bincount(places, minlength=1 << BITS)
    # presence of fewer rows cannot reach the bound, whatever their labels
    share = positive.mean()
    often = np.argsort(-count, kind="stable")[:PAIRED]
    often = often[count[often] >= JOINT * min(share, 1 - share)]
    place_of = np.full(1 << BITS, -1, np.int32)
    place_of[often] = np.arange(len(often))
    kept = place_of[places] >= 0
    held = np.zeros((len(positive), len(often)), np.uint8)
    held[rows[kept], place_of[places[kept]]] = 1
    ones, zeros = held[positive], held[~positive]
    alone, best = strength[often], np.zeros(len(often))
    for a in range(0, len(often), 256):
        for b in range(0, len(often), 1024):
            joint = [(x[:, a : a + 256].T.astype(np.float32) @ x[:, b : b + 1024].astype(np.float32)).astype(np.float64) for x in (ones, zeros)]
            more = told(*joint, len(ones), len(zeros)) - np.maximum(alone[a : a + 256, None], alone[None, b : b + 1024])
            best[a : a + 256] = np.maximum(best[a : a + 256], more.max(1))
    order = np.argsort(-best, kind="stable")
    return often[order[best[order] > JOINT]]


def fit(rows: np.ndarray, places: np.ndarray, labels: np.ndarray, seed: int = 5) -> Machine:
    """Fit to distinct (row, place) pairs of labelled rows, by Adam on the logistic loss in whole batches."""
    n, positive = len(labels), labels > 0
    if not positive.any() or positive.all():
        return constant(float(positive.mean()) if n else 0.0)
    hit = np.bincount(places[positive[rows]], minlength=1 << BITS).astype(np.float64)
    miss = np.bincount(places[~positive[rows]], minlength=1 << BITS).astype(np.float64)
    n1, n0 = positive.sum(), (~positive).sum()
    strength = told(hit, miss, n1, n0)
    strength[hit + miss < 3] = 0
    chosen = np.argsort(-strength, kind="stable")[:SELECTED]
    chosen = chosen[strength[chosen] > 12]
    paired = partners(rows, places, positive, strength)
    chosen = np.concatenate((chosen, paired[~np.isin(paired, chosen)][:PARTNERS]))
    slots = np.full(1 << BITS, -1, np.int16)
    slots[chosen] = np.arange(len(chosen))
    kept = slots[places] >= 0
    r, s = rows[kept], slots[places[kept]].astype(np.int64)
    random = np.random.default_rng(seed)
    weights, vectors, bias = np.zeros(len(chosen)), random.normal(0, 0.02, (len(chosen), FACTORS)), float(np.log(n1 / n0))
    theta = [np.array([bias]), weights, vectors]
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for step in range(1, 121):
        bias, weights, vectors = theta[0][0], theta[1], theta[2]
        sums = np.stack([np.bincount(r, v[s], n) for v in vectors.T], 1)
        squares = np.stack([np.bincount(r, v[s] ** 2, n) for v in vectors.T], 1)
        y = bias + np.bincount(r, weights[s], n) + 0.5 * (sums**2 - squares).sum(1)
        error = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels) / n
        grad = [
            np.array([error.sum()]),
            np.bincount(s, error[r], len(weights)) + 2e-5 * weights,
            np.stack([np.bincount(s, error[r] * (sums[r, k] - vectors[s, k]), len(weights)) for k in range(FACTORS)], 1) + 1e-4 * vectors,
        ]
        for i, g in enumerate(grad):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            theta[i] = theta[i] - 0.08 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Machine(slots, float(theta[0][0]), theta[1], theta[2])


def remainder(key, divisor: int):
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % divisor


def training_terms(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, place) pairs and the labels of at most 2 * SAMPLE documents, on the driver."""
    usable = labels.where(F.col(label).isin(0, 1) & (remainder(key, 3) != 1)).select(F.col(key).alias("of"), F.col(label).cast("int").alias("label")).groupBy("of").agg(F.max("label").alias("label"))
    order = [F.xxhash64("of"), F.col("of")]
    ids = usable.where("label = 1").orderBy(*order).limit(SAMPLE).union(usable.where("label = 0").orderBy(*order).limit(SAMPLE))
    picked = docs.select(F.col(f"`{key}`").alias("of"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    picked = picked.join(F.broadcast(ids), "of").dropDuplicates(["of"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows, places = terms(*text_bytes(batch.column(1)))
            pairs = np.unique((rows << BITS) | places)
            cuts = np.searchsorted(pairs >> BITS, np.arange(batch.num_rows + 1)).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(cuts), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), held, batch.column(2)], ["of", "places", "label"])

    kind = picked.schema["of"].dataType.simpleString()
    found = picked.select("of", "text", "label").mapInArrow(run, f"of {kind}, places array<int>, label int").toArrow().sort_by("of").combine_chunks()
    if not found.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = found.column("places").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    counts = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(counts)), counts), lists.flatten().to_numpy().astype(np.int64), found.column("label").to_numpy().astype(np.int64)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) of each document."""
    machine = fit(*training_terms(docs, labels, key, text, label))
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    kind = docs.select(F.col(f"`{key}`")).schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "scored_text"):
            found = shared.value.score_texts(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], [key, "held_out", "score", "predicted"])

    out = F.coalesce(remainder(key, 3) == 1, F.lit(False)).alias("held_out")
    return docs.select(F.col(f"`{key}`"), out, F.col(f"`{text}`").alias("scored_text")).mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int")
