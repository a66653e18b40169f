"""Packing: exact ids, each in one piece, gapless sequences, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
from siltstone.llm import packing, queries
from siltstone.llm.common import default_tokenizer


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_stretches_encode_as_whole_texts_do():
    random.seed(5)
    parts = ["a", "It's", " ", "  ", "\n", "\t", "é", "🙂", "12", "!!", " ", " ", "'s", "don't", " .", "\0", "<|endoftext|>", "word", "\r\n"]
    texts = ["".join(random.choices(parts, k=random.randrange(0, 12))) for _ in range(3000)]
    encode = packing.Ids(default_tokenizer())
    for t, got, want in zip(texts, encode(texts), plain_ids(texts)):
        assert np.frombuffer(got, "<u4").tolist() == want[:-1], repr(t)


def holds(rows, expected):
    """`expected`: list of (doc_id, ids) with distinct doc_ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {d for d, _ in expected}
    for d, ids in expected:
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    tokens = padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        tokens += at
        padding += 2048 - at
    return padding / (tokens + padding)


def test_op3_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.op3_packing(spark, sf).collect()
    assert holds(rows, list(zip([d.doc_id for d in docs], plain_ids([d.text for d in docs])))) < 0.02


def test_odd_rows(spark):
    texts = [None, "", "a " * 9000, "x", "y\n"] + ["z " * 1100] * 40
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int").coalesce(1)
    packed = packing.pack(docs, default_tokenizer())
    assert holds(packed.collect(), list(zip(range(len(texts)), plain_ids([t or "" for t in texts])))) < 0.05
    whole = packing.sequences(packed).collect()
    assert all(len(s.ids) == 2048 or len(s.ids) & (len(s.ids) - 1) == 0 for s in whole)
    assert packing.pack(docs.limit(0), default_tokenizer()).count() == 0


def test_the_level_is_the_one_of_least_squares():
    random.seed(6)
    packer = packing.Packer(12)
    for n in range(400):
        size = random.randrange(1, 12)
        counts = packer.counts.copy()

        def squares(level):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < 12:
                c[level + size] += 1
            return int((c[1:12] ** 2).sum())

        fits = [h for h in range(12 - size + 1) if h == 0 or counts[h]]
        best = min(squares(h) for h in fits)
        level = packer.level_for(size)
        assert level == max(h for h in fits if squares(h) == best)
        list(packer.add(n, bytes(4 * size)))


def test_open_windows_stay_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MAX_OPEN", 50)
    packer, out = packing.Packer(), []
    for n in range(400):
        out += packer.add(n, np.arange(1100, dtype="<u4").tobytes())
        assert packer.n_open <= 50
    out += packer.drain()
    assert sum(len(ids) // 4 for _, _, ids, _, _ in out) == 440_000
