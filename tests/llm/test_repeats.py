"""Repeated windows against a plain count of every window."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from siltstone.llm import queries, repeats
from siltstone.llm.common import text_bytes


def plain(texts, window=400):
    raw = [(t or "").encode() for t in texts]
    count = Counter(hashlib.md5(r[i : i + window]).digest() for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if count[hashlib.md5(r[i : i + window]).digest()] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def plain_passages(texts, width=51):
    """Words under passages of `width` words that another text (a copy, too) holds as well."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    where = defaultdict(set)
    for k, w in enumerate(split):
        for i in range(len(w) - width + 1):
            where[tuple(w[i : i + width])].add(k)
    out = []
    for w in split:
        gone = bytearray(len(w))
        for i in range(len(w) - width + 1):
            if len(where[tuple(w[i : i + width])]) > 1:
                gone[i : i + width] = b"\1" * width
        out.append(sum(gone))
    return out


def test_op10_against_every_window(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = dict(zip([d.doc_id for d in docs], plain([d.text for d in docs])))
    rows = queries.op10_repeats(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == expected
    assert {r.doc_id: r.n_repeated_words for r in rows} == dict(zip([d.doc_id for d in docs], plain_passages([d.text for d in docs])))


def made(seed):
    random.seed(seed)
    letters = lambda n: "".join(random.choices("abcdé \n", k=n))
    passage, other = letters(900), letters(430)
    texts = [letters(200) + passage[random.randrange(300) : 600 + random.randrange(300)] + letters(150) for _ in range(25)]
    texts += [letters(random.randrange(300)) + other + letters(30) for _ in range(20)]
    texts += [passage, passage, letters(350), "z" * 399, "z" * 1500, "ab" * 600, letters(500) * 3, None, "", passage[:400], "x" + passage[1:400]]
    texts += ["short"] * 3
    word = lambda: "".join(random.choices("abcdefg", k=4))
    shared = [word() for _ in range(90)]
    texts += [" ".join([word() for _ in range(30)] + shared[random.randrange(20) : 60 + random.randrange(30)] + [word() for _ in range(20)]) for _ in range(12)]
    inner = " ".join(shared[:55])
    texts += [" ".join([inner, word(), inner, word()]), " \n".join(shared[20:72]), " ".join(shared[:50])]
    only = " ".join(word() for _ in range(60))
    texts += [f"{only} x {only}", " ".join(shared[:53])] + [" ".join(word() for _ in range(51))] * 2
    return texts


@pytest.mark.parametrize("large", [repeats.LARGE, 3])
def test_shared_passages_runs_and_odd_rows(spark, monkeypatch, large):
    monkeypatch.setattr(repeats, "LARGE", large)
    texts = made(large)
    df = spark.createDataFrame([(i if i % 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, anchor int")
    found, cut = repeats.remove_repeats(df)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())
    assert got == sorted((str(i if i % 7 else None), *x) for i, x in enumerate(plain(texts)))
    words = sorted((str(r.doc_id), r.n_repeated_words) for r in found.collect())
    assert words == sorted((str(i if i % 7 else None), x) for i, x in enumerate(plain_passages(texts)))
    for r in cut.collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    assert repeats.remove_repeats(df.limit(0))[0].count() == 0


def test_stretches_hold_every_window_once():
    texts = [t or "" for t in made(5)]
    data, offsets = text_bytes(pa.array(texts))
    rows, low, high, at, _ = repeats.stretches(data, offsets)
    count = np.bincount(rows, high - low + 1, len(texts))
    assert count.tolist() == [max(0, len(t.encode()) - 399) for t in texts]
    assert ((at >= high) & (at <= low + 400 - repeats.GRAM)).all()


@pytest.mark.parametrize("unit", repeats.UNITS)
def test_radix_orders_suffixes_and_finds_equal_windows(unit):
    random = np.random.default_rng(6)
    body = random.integers(97, 99, 3000).astype(np.uint8) if not unit.words else random.integers(0, 3, 900).astype(np.uint64)
    tokens = np.concatenate((body, body[200:800], body[100:700]))
    places = np.arange(len(tokens) - unit.window + 1)
    groups = random.integers(0, 2, len(tokens))[: len(places)]
    alive, tie = repeats.radix(tokens, places, groups, unit)
    windows = defaultdict(list)
    for i, p in enumerate(places):
        windows[groups[i], tuple(tokens[p : p + unit.window].tolist())].append(i)
    expected = [sorted(v) for k, v in sorted(windows.items()) if len(v) > 1]
    got = [sorted(alive[tie == t].tolist()) for t in range(tie[-1] + 1)]
    assert got == expected
