"""Chat formatting with loss masks that are aligned by offsets.

A whole conversation is rendered once and encoded once. Its markers are added tokens of the tokenizer, so no token
straddles a turn's edge; the sorted spans of turns meet the sorted spans of tokens by binary search, which gives the
loss mask. Control strings inside roles and texts are escaped with a backslash and come back exactly.

Conversations reach their task by one shuffle on the key and an external sort; rows then stream, and a worker holds one
conversation at a time, since a training sample must be whole.

Defined results. Null role or text: empty. Null key: one conversation. Null turns come first; ties of a turn are ordered
by role and text; repeated rows stay. Empty texts are turns without tokens. Empty tables: empty results. Columns beside
the four named ones are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import partitions

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: Strings that a text may not hold as they are: this template's marker prefix, and the markers of other common ones.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(f"{re.escape(ROLE)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted conversation, and the start and end of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{ROLE}{escape(role)}{TEXT}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at = spans[-1][1] + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


class Encoder:
    """A tokenizer file with the template's markers added as tokens of their own and offsets left untrimmed."""

    def __init__(self, path: str):
        from tokenizers import AddedToken, Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
        self.tokenizer.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (ROLE, TEXT, END)])

    def __call__(self, formatted: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and each token's start and end in code points."""
        encoded = self.tokenizer.encode(formatted, add_special_tokens=False)
        return np.array(encoded.ids, np.uint32), np.array(encoded.offsets, np.int64).reshape(-1, 2)


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for each token that lies in one of the sorted `spans`."""
    mask = np.zeros(len(offsets), bool)
    spans = spans[spans[:, 1] > spans[:, 0]]
    first = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], "left")
    for a, b in zip(first, last):
        mask[a:b] = True
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The runs of text that the mask covers, in order."""
    out, upto = [], -1
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    for a, b in zip(edges[::2], edges[1::2]):
        start, end = max(int(offsets[a, 0]), upto), int(offsets[b - 1, 1])
        out.append(formatted[start:end])
        upto = end
    return out


def conversations(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, role, text) with each conversation's turns in order within one partition."""
    column = lambda name, as_: F.col(f"`{name}`").alias(as_)
    picked = rows.select(column(key, "key"), column(turn, "turn"), F.coalesce(column(role, "r"), F.lit("")).alias("role"), F.coalesce(column(text, "t"), F.lit("")).alias("text"))
    return picked.repartition(partitions(rows), "key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text")


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str]]]]:
    """Conversations out of sorted rows, across batches."""
    current, turns = None, []
    for batch in batches:
        for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if turns and key != current:
                yield current, turns
                turns = []
            current = key
            turns.append((role, text))
    if turns:
        yield current, turns


def format_chats(rows: DataFrame, tokenizer: str, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Training samples: (key, formatted, ids, offsets as start and end per token, loss mask as 0 and 1 per token)."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, types = Encoder(tokenizer), []

        def typed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types[:] = [batch.schema.field(0).type]
                yield batch

        for name, turns in whole(typed()):
            formatted, spans = render(turns)
            ids, offsets = encode(formatted)
            mask = loss_mask(offsets, spans[[r == "assistant" for r, _ in turns]])
            yield pa.RecordBatch.from_pylist([{key: name, "formatted": formatted, "ids": ids.tolist(), "starts": offsets[:, 0].tolist(), "ends": offsets[:, 1].tolist(), "loss_mask": mask.astype(np.int8).tolist()}], pa.schema([(key, types[0]), ("formatted", pa.string()), ("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))]))

    return conversations(rows, key, turn, role, text).mapInArrow(run, f"`{key}` {kind}, formatted string, ids array<bigint>, starts array<int>, ends array<int>, loss_mask array<tinyint>")


def chat_digest(samples: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the samples of `format_chats` say, read back from them: turns, and the text under the loss mask."""
    kind = samples.schema[key].dataType.simpleString()
    names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                formatted = batch.column(1)[i].as_py()
                offsets = np.stack([batch.column(k)[i].values.to_numpy() for k in (2, 3)], 1).astype(np.int64)
                mask = batch.column(4)[i].values.to_numpy() != 0
                turns = read_back(formatted)
                loss = "".join(map(unescape, masked_text(formatted, offsets, mask)))
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    return samples.select(key, "formatted", "starts", "ends", "loss_mask").mapInArrow(run, f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
