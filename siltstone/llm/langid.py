"""Word-level language identification by a linear-chain conditional random field.

Each word has features from its bytes: affixes of 1 to 4, every 2- and 3-gram, and itself (the lexicon), hashed to 2**18
places with a weight per language. Learned transitions tie neighbours, so a word that several languages share takes the
language of its run, and code-switched text changes label where the evidence does. Forward-backward gives each word's
marginals; a document's language has the largest mean marginal over its words with letters, and that mean is the score.

Training, on the driver, is bounded: `SAMPLE` documents a language, chosen by a hash of the id, with all their words.
Labelled texts are cut into runs of random length and strung together, so that transitions are learned from text that
switches. Prediction is one pass over whole texts without a shuffle, vectorised over documents at each position.

Defined results. Null text, or a text without letters: `und` with score 0. Null language or id: not learned from; a null
id is not held out. Repeated rows: the same prediction. No labelled rows: `und` throughout. Very long texts are read
whole. Columns beside the named ones are not read (`identify`) or pass through (`reject`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Roller, mix, pieces, text_bytes, words
from siltstone.llm.toxicity import _LETTER, folded, remainder

BITS = 18
#: Labelled documents of each language in the fit, at most.
SAMPLE = 150
#: Bytes of text that a worker labels at once: chains step together, so that small pieces cost more steps.
LABELLED_BYTES = 1 << 20
#: Distinct words whose features a worker makes at once: each has some twenty, which cost far more memory than the word.
SCORED_WORDS = 1 << 13
RUN, SEQUENCE, BATCH, EPOCHS = 12, 48, 64, 2
#: The pipeline keeps documents whose language has at least this mean marginal.
LEAST = 0.4


def hashed(code: np.ndarray, order: int) -> np.ndarray:
    return (mix(code + np.uint64((order + 1) << 56)) >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed places of all words' features in a row, each word's first): folded bytes, words of one byte or more."""
    length = ends - starts
    whole = Roller(data).hashes(starts, ends)
    code = data.astype(np.uint64)
    pair = code.copy()
    pair[:-1] |= code[1:] << np.uint64(8)
    triple = pair.copy()
    triple[:-2] |= code[2:] << np.uint64(16)
    quad = triple.copy()
    quad[:-3] |= code[3:] << np.uint64(24)
    by_length = (code, pair, triple, quad)
    word, places = [np.arange(len(starts))], [hashed(whole, 1)]
    for n in range(1, 5):
        has = np.flatnonzero(length >= n)
        word += [has, has]
        places += [hashed(by_length[n - 1][starts[has]], 10 + n), hashed(by_length[n - 1][ends[has] - n], 20 + n)]
    for n in (2, 3):
        count = np.maximum(length - n + 1, 0)
        owner = np.repeat(np.arange(len(starts)), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
        word.append(owner)
        places.append(hashed(by_length[n - 1][at], 30 + n))
    word, places = np.concatenate(word), np.concatenate(places)
    order = np.argsort(word, kind="stable")
    return places[order], np.searchsorted(word[order], np.arange(len(starts)))


def apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words alone, end to end, with their starts and ends: features cost memory by the byte of the whole buffer."""
    length = ends - starts
    begin = np.cumsum(length) - length
    return data[np.arange(int(length.sum())) + np.repeat(starts - begin, length)], begin, begin + length


def chains(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains by falling length, and for each position how many of them reach it."""
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    longest = int(count[order[0]]) if len(order) else 0
    reach = len(order) - np.searchsorted(count[order][::-1], np.arange(longest), "right")
    return first[order], reach


def forward_backward(emission: np.ndarray, transition: np.ndarray, initial: np.ndarray, first: np.ndarray, count: np.ndarray, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word, and the expected transitions summed over all neighbours, which only learning needs (`counted`).

    `emission` holds log scores by word; chain c is the words first[c] .. first[c] + count[c] - 1.
    """
    first, reach = chains(first, count)
    e = emission - emission.max(1, keepdims=True)
    np.exp(e, out=e)
    e += 1e-30
    step, begin = np.exp(transition - transition.max()), np.exp(initial - initial.max())
    forward, backward = np.empty_like(e), np.empty_like(e)
    pairs = np.zeros_like(step)
    now = None
    for t, n in enumerate(reach):
        at = first[:n] + t
        now = (begin if now is None else now[:n] @ step) * e[at]
        now /= now.sum(1, keepdims=True)
        forward[at] = now
    back = np.zeros((0, e.shape[1]))
    for t in range(len(reach) - 1, -1, -1):
        n = reach[t]
        grown = np.ones((n, e.shape[1]))
        if len(back):
            held = back * e[first[: len(back)] + t + 1]
            grown[: len(back)] = held @ step.T
            if counted:
                joint = forward[first[: len(back)] + t][:, :, None] * step[None] * held[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        grown /= grown.sum(1, keepdims=True)
        back = grown
        backward[first[:n] + t] = back
    forward *= backward
    forward /= forward.sum(1, keepdims=True)
    return forward, pairs


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    initial: np.ndarray

    def scores(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log scores of words, which are looked at alone and some at a time."""
        out = np.empty((len(starts), len(self.languages)))
        for at in range(0, len(starts), SCORED_WORDS):
            some = slice(at, at + SCORED_WORDS)
            places, cut = word_features(*apart(low, starts[some], ends[some]))
            out[some] = np.add.reduceat(self.weights[places], cut, axis=0)
        return out

    def label(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a text array: word starts and ends, each row's first word, words with letters, marginals."""
        data, offsets = text_bytes(array)
        starts, ends, first = words(data, offsets)
        low = folded(data)
        letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
        lettered = letters[ends] > letters[starts]
        marginals = np.zeros((len(starts), len(self.languages)))
        if len(starts) and self.languages:
            _, index, back = np.unique(Roller(low).hashes(starts, ends), return_index=True, return_inverse=True)
            scores = self.scores(low, starts[index], ends[index])
            scores[~lettered[index]] = 0
            marginals, _ = forward_backward(scores[back], self.transition, self.initial, first[:-1], np.diff(first), counted=False)
        return starts, ends, first, lettered, marginals

    def predict(self, array: pa.Array) -> tuple[list[str], np.ndarray]:
        _, _, first, lettered, marginals = self.label(array)
        n = len(array)
        names, score = ["und"] * n, np.zeros(n)
        if not self.languages:
            return names, score
        owner = np.repeat(np.arange(n), np.diff(first))[lettered]
        count = np.bincount(owner, minlength=n)
        sums = np.stack([np.bincount(owner, m, n) for m in marginals[lettered].T], 1)
        best = sums.argmax(1)
        for i in np.flatnonzero(count):
            text = array[int(i)].as_py()
            if any("a" <= c <= "z" or "A" <= c <= "Z" for c in text[:64]) or any(map(str.isalpha, text)):
                names[i], score[i] = self.languages[best[i]], min(1.0, sums[i, best[i]] / count[i])
        return names, score


def fit(texts: list[str], langs: list[str], seed: int = 3) -> Field:
    """Fit to labelled texts by stochastic gradient steps (Adagrad) on the log-likelihood of strung-together runs."""
    languages = sorted(set(langs))
    if not languages:
        return Field([], np.zeros((1, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    random = np.random.default_rng(seed)
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    data = folded(data)
    starts, ends, first = words(data, offsets)
    letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
    label = np.repeat([languages.index(x) for x in langs], np.diff(first))
    begins = random.random(len(starts)) < 2 / RUN
    begins[first[:-1][first[:-1] < first[1:]]] = True
    runs = np.flatnonzero(begins)
    stops = np.append(runs[1:], len(starts))
    order = random.permutation(len(runs))
    chosen = np.concatenate([np.arange(runs[i], stops[i]) for i in order] or [np.zeros(0, np.int64)])
    chosen = chosen[letters[ends[chosen]] > letters[starts[chosen]]]
    n, size = len(chosen), len(languages)
    weights, transition, initial = np.zeros((1 << BITS, size), np.float32), np.zeros((size, size)), np.zeros(size)
    grown, grown_t = np.full((1 << BITS, size), 1e-2, np.float32), np.full((size, size), 1.0)
    for _ in range(EPOCHS):
        for at in range(0, n, BATCH * SEQUENCE):
            picked = chosen[at : at + BATCH * SEQUENCE]
            truth = label[picked]
            begin = np.arange(0, len(picked), SEQUENCE)
            places, cut = word_features(*apart(data, starts[picked], ends[picked]))
            scores = np.add.reduceat(weights[places], cut, axis=0).astype(np.float64)
            marginal, pairs = forward_backward(scores, transition, initial, begin, np.diff(np.append(begin, len(picked))))
            error = -marginal
            error[np.arange(len(picked)), truth] += 1
            spread = np.repeat(np.arange(len(picked)), np.diff(np.append(cut, len(places))))
            touched, back = np.unique(places, return_inverse=True)
            grad = np.stack([np.bincount(back, e[spread], len(touched)) for e in error.T], 1).astype(np.float32)
            grad -= 1e-3 * weights[touched]
            grown[touched] += grad**2
            weights[touched] += 0.15 * grad / np.sqrt(grown[touched])
            inner = np.ones(len(picked), bool)
            inner[begin] = False
            seen = np.bincount((np.append(0, truth[:-1]) * size + truth)[inner], minlength=size * size).reshape(size, size)
            step = (seen - pairs) - 1e-2 * transition
            grown_t += step**2
            transition = transition + 0.5 * step / np.sqrt(grown_t)
    return Field(languages, weights, transition, initial)


def training_texts(docs: DataFrame, key: str, text: str, lang: str) -> tuple[list[str], list[str]]:
    """At most SAMPLE whole texts of each language, none of them held out, by a hash of their ids."""
    picked = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").alias("lang")).where(F.col("lang").isNotNull() & (remainder("key", 4) != 2))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    # a row number with this bound keeps the first SAMPLE of each task's rows before they are dealt out
    ids = picked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE).select(F.col("key").alias("of"), F.col("lang").alias("as"))
    whole = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = whole.join(F.broadcast(ids.distinct()), (F.col("key") == F.col("of")) & (F.col("lang") == F.col("as")))
    rows = found.select("key", "lang", "text").dropDuplicates(["key", "lang"]).toArrow().sort_by([("lang", "ascending"), ("key", "ascending")])
    return rows.column("text").to_pylist(), rows.column("lang").to_pylist()


def trained(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Field:
    return fit(*training_texts(docs, key, text, lang))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Field | None = None) -> DataFrame:
    """(key, held_out, lang_pred, score) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained(docs, key, text, lang))
    kind = docs.select(F.col(f"`{key}`")).schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "read_text", LABELLED_BYTES):
            names, found = shared.value.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(found)], [key, "held_out", "lang_pred", "score"])

    out = F.coalesce(remainder(key, 4) == 2, F.lit(False)).alias("held_out")
    return docs.select(F.col(f"`{key}`"), out, F.col(f"`{text}`").alias("read_text")).mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word, start and end in bytes, lang, probability): one row per word with letters, for code-switched text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(f"`{key}`")).schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "read_text", LABELLED_BYTES):
            starts, ends, first, lettered, marginals = shared.value.label(batch.column(1))
            _, offsets = text_bytes(batch.column(1))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            kept = np.flatnonzero(lettered) if shared.value.languages else np.zeros(0, np.int64)
            best = marginals[kept].argmax(1) if len(kept) else kept
            held = [batch.column(0).take(pa.array(row[kept])), pa.array((kept - first[row[kept]]).astype(np.int32)), pa.array(starts[kept] - offsets[row[kept]]), pa.array(ends[kept] - offsets[row[kept]])]
            held += [pa.array([shared.value.languages[b] for b in best], pa.string()), pa.array(marginals[kept, best] if len(kept) else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(held, [key, "word", "start", "end", "lang", "probability"])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("read_text")).mapInArrow(run, f"`{key}` {kind}, word int, start long, end long, lang string, probability double")


def keep_identified(docs: DataFrame, text: str = "text", least: float = LEAST, model: Field | None = None) -> DataFrame:
    """The rows whose text has one clear language: neither `und` nor a score under `least`. Columns, of any names, are unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained(docs))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index(text) if text in docs.columns else [c.lower() for c in docs.columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the text is read where it lies in the row: a column of its own would move it twice
        whole = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(at)], ["row", "read_text"]) for b in batches)
        for batch in pieces(whole, "read_text", LABELLED_BYTES):
            names, found = shared.value.predict(batch.column(1))
            yield batch.filter(pa.array((np.array(names) != "und") & (found >= least))).select(["row"])

    return rows.mapInArrow(run, rows.schema).select("row.*")
