"""What the pipeline's Python workers hold: features of some words at once, each text once, and nothing of a task that is over."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from siltstone.llm import common, hyperminhash, langid, packing


def model():
    random = np.random.default_rng(5)
    languages = ["de", "en", "fr"]
    return langid.Field(languages, random.normal(size=(1 << langid.BITS, 3)).astype(np.float32), random.normal(size=(3, 3)), random.normal(size=3))


def test_features_are_made_of_some_words_at_a_time(monkeypatch):
    seen, real, field = [], langid.word_features, model()
    monkeypatch.setattr(langid, "word_features", lambda data, starts, ends: seen.append(len(starts)) or real(data, starts, ends))
    texts = pa.array([" ".join(f"w{i}x{i * 7919 % 104729}" for i in range(at, at + 20_000)) for at in (0, 20_000)] + [None, "", "1 2"])
    tracemalloc.start()
    starts, ends, first, lettered, marginals = field.label(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(starts) == 40_002 and sum(seen) == 40_002 and max(seen) <= 1 << 13
    assert peak < 48 << 20
    # the same as with the features of all words in one go
    data, _ = common.text_bytes(texts)
    low = langid.folded(data)
    places, cut = real(*langid.apart(low, starts, ends))
    whole = np.add.reduceat(field.weights[places], cut, axis=0).astype(np.float64)
    assert np.array_equal(field.scores(low, starts, ends), whole)
    whole[~lettered] = 0
    plain, _ = langid.forward_backward(whole.copy(), field.transition, field.initial, first[:-1], np.diff(first))
    assert np.array_equal(marginals, plain) and np.allclose(marginals.sum(1), 1)


def test_texts_reach_the_worker_once(spark):
    rows = [(1, "der mond", "x"), (2, None, "y"), (3, "12 34", None), (4, "the sun", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, TEXT string, `a.b` string").repartition(2)
    kept = langid.keep_identified(docs, least=0.0, model=model())
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[3]]
    assert "read_text" not in kept._jdf.queryExecution().optimizedPlan().toString()
    none = docs.where(F.lit(False))
    assert langid.keep_identified(none, least=0.0, model=model()).count() == 0


def test_freed_memory_is_given_back_when_the_input_ends(monkeypatch):
    given = []
    monkeypatch.setattr(common, "given_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["abcd"] * 10)], ["t"])
    assert sum(p.num_rows for p in common.pieces(iter([batch, batch.slice(0, 0), batch]), "t", 8)) == 20 and len(given) == 1
    monkeypatch.undo()
    common.given_back()


def test_hashes_and_units_stay_small(monkeypatch):
    monkeypatch.setattr(common.Roller, "_powers", np.ones(1, np.uint64))
    monkeypatch.setattr(common.Roller, "_inverse", np.ones(1, np.uint64))
    data = np.frombuffer(b"some words and some words", np.uint8)
    roller = common.Roller(data)
    assert roller.hashes(np.array([0]), np.array([10])) == roller.hashes(np.array([15]), np.array([25]))
    assert len(common.Roller._powers) <= (256 << 10) + 2
    kept = data.astype(np.uint64)
    common.Roller(kept)
    assert np.array_equal(kept, data)
    assert packing.CACHED <= 1 << 16


def test_band_keys_do_not_depend_on_the_cut(spark):
    random = np.random.default_rng(8)
    registers = random.integers(0, 4, (5000, hyperminhash.REGISTERS)).astype(np.uint16)
    rows = [(i, registers[i].tobytes()) for i in range(5000)]
    classes = spark.createDataFrame(rows, "node long, registers binary").coalesce(1)
    found = hyperminhash.band_keys(classes).groupBy("node").agg(F.sort_array(F.collect_list("band")).alias("bands"))
    alone = hyperminhash.band_keys(classes.where("node in (0, 2047, 2048, 4999)")).groupBy("node").agg(F.sort_array(F.collect_list("band")).alias("alone"))
    assert found.count() == 5000 and found.join(alone, "node").where("bands = alone").count() == 4
