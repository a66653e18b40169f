"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from siltstone.llm import hnsw, queries


def brute(ids, x, asked, k=20):
    out = {}
    for q, v in asked:
        s = x @ v
        order = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:k]
        out[q] = [i for _, i in order]
    return out


def recall(rows, expected):
    found = {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(found[q] & set(e)) / len(e) for q, e in expected.items()])


def test_op2_recall_and_scores(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(table.embedding.tolist(), np.float64), table.vec_id.tolist()
    at = {i: v for i, v in zip(ids, x)}
    rows = queries.op2_hnsw(spark, sf).collect()
    expected = brute(ids, x, [(i, at[i]) for i in ids if i % 20 == 0])
    assert recall(rows, expected) >= 0.95
    for q in expected:
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and q not in [r.vec_id for r in own]
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(r.score == pytest.approx(float(at[r.vec_id] @ at[q]), abs=1e-12) for r in own)


def test_several_shards_and_norms(spark):
    random = np.random.default_rng(2)
    x = random.normal(size=(1500, 24)) * random.uniform(0.5, 2, (1500, 1))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = hnsw.nearest(rows, rows.where("vec_id % 50 = 0"), shard_rows=400).collect()
    assert recall(found, brute(list(range(1500)), x, [(i, x[i]) for i in range(0, 1500, 50)])) >= 0.95


def test_odd_vectors_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (40, [1.0, 2.0, 4.0]), (8, [0.5, -0.0])]
    rows += [(100 + i, [1.0, 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 score", "'x' id")
    out = {}
    for r in hnsw.nearest(df, df.where("vec_id % 20 = 0")).collect():
        out.setdefault(r.query_id, {})[r.rank] = r.vec_id
    equal = [0, 20, *range(100, 160)]
    assert [out[0][k] for k in range(1, 21)] == [i for i in equal if i != 0][:20]
    assert [out[20][k] for k in range(1, 21)] == [i for i in equal if i != 20][:20]
    assert out[40] == {1: 7}
    assert set(out) == {0, 20, 40, 100, 120, 140}
    assert hnsw.nearest(df.limit(0), df.limit(0)).count() == 0


def test_string_ids_and_ties_at_the_cut(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.5]), ("c", [1.0, -0.5]), ("d", [1.0, 0.25]), ("e", [0.5, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    found = hnsw.nearest(df, df.where("vec_id = 'b'"), k=2).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [("b", "a", 1.0), ("b", "c", 1.0)]


def test_recall_of_a_full_shard():
    random = np.random.default_rng(9)
    x = random.normal(size=(64, 32))[random.integers(0, 64, hnsw.SHARD_ROWS)] + random.normal(size=(hnsw.SHARD_ROWS, 32))
    found, _ = hnsw.search(x, hnsw.build(x), x[::100], 20)
    best = np.argsort(-(x[::100] @ x.T), 1, kind="stable")[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, best)]) >= 0.93
