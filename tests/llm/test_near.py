"""Near duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
from siltstone.llm import hyperminhash, queries
from siltstone.llm.components import components


def plain_set(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def plain_components(rows, width, percent=80):
    sets = [(d, plain_set(t, width)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, (_, s) in enumerate(sets):
        shared = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return {d: (len(s), least[find(i)]) for i, (d, s) in enumerate(sets)}


def test_op5_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = plain_components([(d.doc_id, d.text) for d in docs], 4)
    rows = queries.op5_hyperminhash(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_large_group_of_near_copies_and_chains(spark):
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefgh", k=6))
    base = [word() for _ in range(150)]
    texts = [" ".join(w if random.random() > p else word() for w in base) for p in np.linspace(0, 0.08, 240)]
    chain = [word() for _ in range(120)]
    for k in range(12):
        texts.append(" ".join(chain))
        chain = chain[4:] + [word() for _ in range(4)]
    texts += ["a", "A", "b", "", None, "a b c", "A  b\tc", "a b c d"] + ["x y z w v"] * 30 + [word() for _ in range(50)]
    rows = list(enumerate(texts))
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 node", "'x' key", "2 component")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hyperminhash.near_duplicates(df, width=4).collect()}
    assert got == plain_components(rows, 4)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "w " * 60_000), (4, "w " * 60_001)], "doc_id long, text string")
    rows = sorted(hyperminhash.near_duplicates(df).collect(), key=str)
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("3", "3", True), ("4", "3", False), ("None", "None", True)]
    assert hyperminhash.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_near_the_truth():
    random = np.random.default_rng(4)
    for n in (400, 3000):
        for shared in (0.0, 0.5, 0.8, 0.95):
            found = []
            for _ in range(40):
                x = random.integers(0, 2**63, n, dtype=np.uint64)
                y = np.concatenate((x[: int(n * 2 * shared / (1 + shared))], random.integers(0, 2**63, n - int(n * 2 * shared / (1 + shared)), dtype=np.uint64)))
                a, b = (hyperminhash.sketch(np.unique(v))[None, :] for v in (x, y))
                found.append(hyperminhash.estimate(a, b, np.array([n]), np.array([n]))[0][0])
            assert np.mean(found) == pytest.approx(shared, abs=0.03)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_keep_one_with_clashing_columns(spark):
    rows = [(1, "a b c d e f", 9, "p", 3, 0), (2, "a b c d e f", 8, "q", 2, 1), (None, "a b c d e f", 7, "r", 1, 0), (3, None, 6, "s", 0, 0), (3, None, 5, "s", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `of` int, stays string, `key` int, `row` int")
    kept = hyperminhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r["of"]) for r in kept.collect())[0::2] == [("1", 9), ("None", 7)]
    assert hyperminhash.keep_one(df.limit(0)).count() == 0
