"""The pipeline's stages, each against a plain version on its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from siltstone.llm import langid, mixing, secrets
from test_near import plain_components
from test_ops_text import plain_targets


@pytest.fixture(scope="module")
def outputs(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_stay_until_the_last(outputs):
    for before, after in outputs[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString()


def test_language_stage_keeps_clean_documents(outputs):
    before, after = outputs[0]
    predicted = {r.doc_id: r for r in langid.identify(before).collect()}
    assert {r.doc_id for r in after.collect()} == {d for d, r in predicted.items() if r.lang_pred != "und" and r.score >= langid.LEAST}
    assert after.count() >= 0.98 * before.count()


def test_near_stage_keeps_the_least_of_each_group(outputs):
    before, after = outputs[1]
    expected = plain_components([(r.doc_id, r.text) for r in before.collect()], 5)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, (_, c) in expected.items() if c == d)


def test_secret_stage_cuts_out_the_findings(outputs):
    before, after = outputs[2]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert after.count() == len(texts)
    for r in after.collect():
        spans = secrets.joined(secrets.find(texts[r.doc_id]))
        assert r.text == (secrets.cut_out(texts[r.doc_id], spans) if spans else texts[r.doc_id])
        assert r.n_chars == len(r.text) and not secrets.find(r.text)


def test_mixing_stage_repeats_whole_rows(outputs):
    before, after = outputs[3]
    rows = {r.doc_id: r for r in before.collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken, largest, copies = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows.values():
        sizes[r.source] += size(r.text)
        largest[r.source] = max(largest[r.source], size(r.text))
    for r in after.collect():
        assert r == rows[r.doc_id]
        taken[r.source] += size(r.text)
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 3
    for s, goal in plain_targets(sizes).items():
        assert abs(taken[s] - goal) <= 2 * largest[s]


def test_packing_stage_packs_everything(outputs):
    before, after = outputs[4]
    pieces = after.collect()
    counts = defaultdict(int)
    for p in pieces:
        counts[p.doc_id] += p.length
    copies = defaultdict(int)
    for r in before.collect():
        copies[r.doc_id] += 1
    tokens = {p.doc_id: p.doc_tokens for p in pieces}
    assert counts == {d: n * tokens[d] for d, n in copies.items()}


def test_run_and_odd_rows(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "token = abcdef0123456789abcdef0123456789 the cat sat on the mat", "en", None, 5), (2, "token = abcdef0123456789abcdef0123456789 the cat sat on the mat", "en", None, 5), (3, "le chat est là " * 9000, "fr", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() >= 1
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf).count() == 3


def test_rows_without_an_id_keep_their_own_draws(spark):
    rows = [(None if i % 3 == 0 else i // 2, f"a{i} " + "w " * (i % 7 + 1), "xyz"[i % 5 % 3]) for i in range(600)] + [(None, "same text here", "x")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = Counter(tuple(r) for r in mixing.mix_documents(docs).collect())
    assert set(mixed) <= set(rows) and max(n for r, n in mixed.items() if r[1] != "same text here") <= 3
    size = lambda r: len(r[1].split())
    drawn = mixing.sample(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect()
    for r in drawn:
        taken = sum(n * size(row) for row, n in mixed.items() if row[2] == r.source)
        assert taken == r.taken and abs(taken - r.target) <= 2 * r.largest
    assert mixed == Counter(tuple(r) for r in mixing.mix_documents(docs.repartition(5)).collect())


def test_columns_of_any_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = docs.withColumns({"a.b": F.col("n_chars") % 3, "with space": F.lit("x"), "row": F.lit(1), "spans": F.lit(None).cast("string"), "read_text": F.lit(2)})
    secret = docs.limit(1).withColumns({"text": F.lit("the cat sat on the mat and token = abcdef0123456789abcdef0123456789"), "doc_id": F.lit(10**6).cast("long")})
    docs = docs.unionByName(secret)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "packing" or out.columns == docs.columns
        assert out.count() > 0 and stage(spark, docs.limit(0), sf).count() == 0
        if name == "secret_scan":
            (hit,) = out.where("doc_id = 1000000").collect()
            assert hit.text == "the cat sat on the mat and [REDACTED]" and hit.n_chars == len(hit.text) and hit["a.b"] in (0, 1, 2)
