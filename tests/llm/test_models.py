"""Language and toxicity models: their arithmetic against enumeration, and held-out accuracy."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from siltstone.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_forward_backward_against_every_labelling():
    random = np.random.default_rng(1)
    emission, transition, initial = random.normal(size=(7, 3)), random.normal(size=(3, 3)), random.normal(size=3)
    first, count = np.array([0, 4, 4]), np.array([4, 0, 3])
    marginal, pairs = langid.forward_backward(emission, transition, initial, first, count)
    expected, expected_pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for a, n in zip(first, count):
        total = 0.0
        own, own_pairs = np.zeros((7, 3)), np.zeros((3, 3))
        for labels in itertools.product(range(3), repeat=int(n)):
            if not labels:
                continue
            w = np.exp(initial[labels[0]] + sum(emission[a + i, x] for i, x in enumerate(labels)) + sum(transition[x, y] for x, y in zip(labels, labels[1:])))
            total += w
            for i, x in enumerate(labels):
                own[a + i, x] += w
            for x, y in zip(labels, labels[1:]):
                own_pairs[x, y] += w
        if n:
            expected += own / total
            expected_pairs += own_pairs / total
    assert marginal == pytest.approx(expected, abs=1e-6) and pairs == pytest.approx(expected_pairs, abs=1e-6)


def test_pairs_of_the_machine_against_a_double_loop():
    random = np.random.default_rng(2)
    machine = toxicity.Machine(np.zeros(0), 0.3, random.normal(size=6), random.normal(size=(6, 3)))
    held = [0, 2, 5]
    y = 0.3 + sum(machine.weights[i] for i in held) + sum(machine.vectors[i] @ machine.vectors[j] for i, j in itertools.combinations(held, 2))
    assert machine.scores(np.zeros(3, int), np.array(held), 1)[0] == pytest.approx(1 / (1 + np.exp(-y)))


def test_interactions_are_learned():
    """Neither of two terms alone is toxic, both together are."""
    random, rows, places, labels = np.random.default_rng(3), [], [], []
    for i in range(800):
        a, b = random.random(2) < 0.5
        own = [1] * int(a) + [2] * int(b) + [3 + int(random.integers(20))]
        rows += [i] * len(own)
        places += own
        labels.append(int(a and b))
    machine = toxicity.fit(np.array(rows), np.array(places), np.array(labels))
    score = lambda *x: machine.scores(np.zeros(len(x), int), machine.slots[list(x)].astype(int), 1)[0]
    assert score(1, 2) > 0.7 and score(1) < 0.5 and score(2) < 0.5


def test_terms_that_tell_in_company_only_are_learned():
    """Each of two terms is as common in either class; toxic are the rows with both or neither."""
    random, rows, places, labels = np.random.default_rng(4), [], [], []
    for i in range(1600):
        a, b = bool(i & 1), bool(i & 2)
        own = [1] * a + [2] * b + [3 + int(x) for x in set(random.integers(200, size=8))]
        rows += [i] * len(own)
        places += own
        labels.append(int(a == b))
    machine = toxicity.fit(np.array(rows), np.array(places), np.array(labels))
    assert machine.slots[1] >= 0 and machine.slots[2] >= 0
    score = lambda *x: machine.scores(np.zeros(len(x), int), machine.slots[list(x)].astype(int), 1)[0]
    assert score(1, 2) > 0.7 and score(1) < 0.3 and score(2) < 0.3


def test_partners_against_all_pairs():
    random = np.random.default_rng(6)
    held = random.random((500, 30)) < 0.4
    positive = held[:, 3] ^ held[:, 7] ^ (random.random(500) < 0.1)
    rows, places = np.nonzero(held)
    chi = lambda x: toxicity.told(*[np.array([float(x[positive].sum())]), np.array([float(x[~positive].sum())])], positive.sum(), (~positive).sum())[0]
    strength = np.zeros(1 << toxicity.BITS)
    strength[:30] = [chi(held[:, i]) for i in range(30)]
    best = [max((chi(held[:, i] & held[:, j]) - max(strength[i], strength[j]) for j in range(30) if j != i)) for i in range(30)]
    found = toxicity.partners(rows, places, positive, strength)
    assert set(found.tolist()) == {i for i in range(30) if best[i] > toxicity.JOINT} and {3, 7} <= set(found.tolist())


def test_op6_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_langid(spark, SF).collect()
    assert len(rows) == len(langs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) >= 0.98


def test_op8_held_out_accuracy(spark):
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, SF).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) >= 0.93
    caught = [r for r in held if r.predicted]
    assert np.mean([marks[r.doc_id] for r in caught]) >= 0.9


def test_code_switched_words_and_odd_rows(spark):
    en = "the cat sat on the mat and then went home with the other dogs " * 20
    fr = "le chat est assis sur la chaise avec les autres chiens dans une maison " * 20
    model = langid.fit([en, fr], ["en", "fr"])
    text = " ".join(en.split()[:10] + fr.split()[:10])
    _, _, _, _, marginals = model.label(pa.array([text]))
    assert [model.languages[i] for i in marginals.argmax(1)] == ["en"] * 10 + ["fr"] * 10
    rows = [(None, "the cat", "en"), (1, None, "en"), (2, "", None), (3, "12 34 |", "en"), (4, en * 50, "en"), (5, fr, "fr"), (5, fr, "fr"), (6, "中文 字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 score", "'x' held_out")
    out = langid.identify(df, model=model).collect()
    assert len(out) == len(rows)
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"} and all(r.score == 0 for r in out if r.lang_pred == "und")
    assert {r.lang_pred for r in out if r.doc_id == 5} == {"fr"}
    assert langid.label_words(df, model).where("doc_id = 4").count() == len((en * 50).split())
    assert langid.identify(df.limit(0)).count() == 0 and langid.identify(df.where("lang is null")).where("lang_pred <> 'und'").count() == 0


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x"), (1, None), (2, ""), (3, "bad bad"), (3, "bad bad"), (4, "w " * 50_000)], "doc_id long, text string").selectExpr("*", "0 label", "1 of")
    labels = spark.createDataFrame([(3, 1), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == 6
    assert toxicity.score(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), labels).count() == 0
