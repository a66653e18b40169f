"""Queries whose time was carried on beyond its limit: the same results by plain code, and the step that was too dear is gone."""

import random
import re
import threading
import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siltstone.functions.text import STOPWORDS
from siltstone.operators import claims, ingest, quant, takeaways
from siltstone.plans import corpus, tables


def plain_labels(title, text, terms, limit):
    low = lambda s: re.findall("[a-z0-9]+", (s or "").lower())
    t, b = low(title), low(text)
    good = lambda w: len(w) > 2 and w not in STOPWORDS and not w.isdigit()
    grams = lambda ws: Counter(" ".join(ws[i : i + k]) for k in (2, 3) for i in range(len(ws) - k + 1) if all(map(good, ws[i : i + k])))
    pad = lambda s: f" {s} "
    titled = lambda c: pad(c) in pad(" ".join(t))
    score = Counter()
    for c in {c for c in terms if pad(c) in pad(" ".join(t)) + pad(" ".join(b))}:
        score[c] += 26 + 4 * titled(c)
    for c, n in grams(t).items():
        score[c] += 8 * n + 4
    for c, n in grams(b).items():
        score[c] += (4 * n + 4 * titled(c)) * (n >= 2 or titled(c))
    for c, n in Counter(w for w in b if good(w) and len(w) >= 5).items():
        score[c] += (n + 4 * titled(c)) * (n >= 3 or titled(c))
    ranked = sorted((-s, -len(c.split(" ")), c) for c, s in score.items() if s)
    return [(c, -s, i) for i, (s, _, c) in enumerate(ranked[:limit], 1)]


def test_concepts_are_those_of_plain_counting(spark):
    rng = random.Random(4)
    words = ["copper", "rises", "demand", "of", "the", "2024", "ab", "Zinc", "straße", "x9z", "trade-war", "KK"]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", ". ", "\n"]) for _ in range(n))
    rows = [(i, rng.choice([None, "", say(4)]), rng.choice([None, "", say(5), say(40), say(400)])) for i in range(300)]
    terms = ["of the", "copper", "rises copper", "demand demand rises", "copper demand of the", "", "Zinc", "none such", "a  b", "zinc"]
    found = {}
    for r in ingest.concept_candidates(spark.createDataFrame(rows, "id long, t string, b string"), "id", "t", "b", terms).collect():
        found.setdefault(r.id, []).append((r.concept, r.score, r.place))
    assert {i: sorted(x, key=lambda y: y[2]) for i, x in found.items()} == {i: w for i, t, b in rows if (w := plain_labels(t, b, terms, 8))}


def test_concepts_do_not_sort_every_phrase(spark):
    docs = spark.createDataFrame([(1, "t", "b")], "id long, t string, b string")
    plan = ingest.concept_candidates(docs, "id", "t", "b", ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and "Exchange" not in plan


def test_takeaways_beyond_the_limit_are_not_cleaned(spark, monkeypatch):
    real = takeaways.cleaned
    watched = lambda values: real(F.transform(values, lambda v: F.when(v.contains("boom"), F.raise_error(F.lit("looked at"))).otherwise(v)))
    monkeypatch.setattr(takeaways, "cleaned", watched)
    text = "\n".join(f"- Copper rose by {i} points" for i in range(5)) + "\n- boom"
    notes = [(1, "t", "## Summary\nboom. boom.", "research_note", text, None), (2, "t", "## Page Route\n" + text, "chartpack_or_visual", "- boom", None), (3, "t", "## Summary\nOne. Two. Three. Four. boom.", "chartpack_or_visual", "- Five", None)]
    out = takeaways.digests(spark.createDataFrame(notes, "id int, title string, body string, document_class string, extracted_text string, excerpt string"))
    five = [f"Copper rose by {i} points." for i in range(5)]
    assert {r.id: r.takeaways for r in out.collect()} == {1: five, 2: five, 3: ["One.", "Two.", "Three.", "Four.", "Five."]}


def test_what_is_ignored_and_repaired_where_it_stands(spark):
    lines = ["see METADATA PATH: x", "Key Takeaways", "not Key takeaways", "mail a@b.c", "add image, table, or figure-specific notes", "a Distribution: b", "Distribution: b", "Âge â€¢ x ▪ y z", "*a* `b` [[c|d]] [e](f)", None, ""]
    row = spark.createDataFrame([(lines,)], "v array<string>").select(takeaways.cleaned("v").alias("v")).first()
    assert row.v == ["not Key takeaways.", "a Distribution: b.", "ge - x - y z.", "a b d e."]


def test_snapshots_are_compared_in_one_reading(spark, sf):
    plan = corpus.claim_snapshot_diff(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    one, two = (spark.createDataFrame([(x,) for x in v], "id string") for v in (["a", "b", "b", None], ["b", "c", "c", None, None]))
    found = claims.snapshot_diff(one, two).collect()
    assert sorted(map(str, found)) == sorted(map(str, one.select("id").distinct().join(two, "id", "left_anti").selectExpr("id", "'removed' change").union(two.select("id").distinct().join(one, "id", "left_anti").selectExpr("id", "'added' change")).collect()))


def test_mixtures_are_fitted_side_by_side(spark, monkeypatch):
    real, lock, now, most, fits = quant.GaussianMixture, threading.Lock(), [0], [0], []

    class Watched(real):
        def fit(self, data):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            try:
                model = super().fit(data)
                fits.append((model.getK(), model.getSeed(), model.summary.logLikelihood))
                return model
            finally:
                with lock:
                    now[0] -= 1

    monkeypatch.setattr(quant, "GaussianMixture", Watched)
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, (rng.normal(size=2) + 4 * (i % 3)).tolist()) for i in range(300)], "date int, features array<double>")
    labels, bic = quant.mixture_regimes(rows, 2, 3, tries=3)
    assert most[0] > 1 and sorted(f[:2] for f in fits) == [(k, 42 + t) for k in (2, 3) for t in range(3)]
    assert bic == {k: -2 * max(x for j, _, x in fits if j == k) + (k * 2 + k * 3 + k - 1) * np.log(300) for k in (2, 3)}
    assert labels.count() == 300 and labels.select("regime").distinct().count() == min(bic, key=bic.get)


def test_paths_are_simulated_once_for_their_statistics(spark, monkeypatch, tmp_path):
    def run(frames):
        (tmp_path / uuid.uuid4().hex).touch()
        for f in frames:
            yield pd.DataFrame({"path": f["id"], "horizon": 5, "regime": 0, "series_id": "a", "ret": f["id"] / 100.0 - 0.2})

    monkeypatch.setattr(tables, "scenario_paths", lambda *_: spark.range(0, 100, 1, 4).mapInPandas(run, "path long, horizon int, regime int, series_id string, ret double"))
    assert [(r.n, round(r.shortfall, 6)) for r in tables.scenario_summary(spark, "").collect()] == [(100, -0.18)]
    assert len(list(tmp_path.iterdir())) == 4
