"""The manifest against a plain tree, and its SQL."""

import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from siltstone.llm import manifest, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `node` int, grp string, `a.b` int"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    for nodes in tree[:-1]:
        first = i // 8 * 8
        yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + 8])
        i //= 8


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[lang] = levels([leaf(r, r["text"]) for r in by[lang]])
    top = levels([trees[lang][-1][0] for lang in langs])
    for j, lang in enumerate(langs):
        for i, r in enumerate(by[lang]):
            sides, at = [*path(trees[lang], i), *path(top, j)], trees[lang][0][i]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                at = leaf(r, r["text"] and r["text"].translate(LOWER))
            for a, b in sides:
                at = digest(a + at + b)
            yield r["doc_id"], trees[lang][0][i], trees[lang][-1][0], top[-1][0], digest("".join(a + b for a, b in sides)), at, at == top[-1][0]


def shown(rows):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in rows), key=str)


def some_rows(n, langs):
    random.seed(n)
    rows = [(i, random.choice(["Äb C", "x" * 9, "", None, "-", "Lower CASE \0 é"]) if i % 7 else "y" * 300_000, random.choice(langs), random.choice(["s", None, ""]), random.choice([3, None]), i, "g", i) for i in range(n)]
    return rows + rows[:3] + [(None, None, None, None, None, 0, "g", 0)] * 2 + [(5, "Other", langs[0], "s", 1, 0, "g", 0)]


def test_against_a_plain_tree(spark):
    """Nulls, ties, repeated rows, long texts, clashing columns, more languages than a run."""
    df = spark.createDataFrame(some_rows(150, ["a", "ß", "Z", None, "-", "", *map(str, range(9))]), SCHEMA)
    expected = sorted(plain([r.asDict() for r in df.collect()]), key=str)
    assert shown(manifest.prove(df, claimed=manifest.tampered()).collect()) == expected


def test_large_language_needs_a_second_round(spark):
    df = spark.range(manifest.BLOCK + 100).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.when(F.col("id") % 500 > 0, F.lit("en")).alias("lang"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    expected = list(plain([r.asDict() for r in df.collect()]))
    got = manifest.prove(df, claimed=manifest.tampered()).collect()
    assert shown(got) == sorted(expected, key=str)


def test_proofs_fold_to_the_root(spark):
    df = spark.createDataFrame(some_rows(40, ["a", "b"]), SCHEMA)
    for r in manifest.prove(df, with_proof=True).collect():
        at = r.leaf
        for left, right in zip(r.proof[::2], r.proof[1::2]):
            at = digest(left + at + right)
        assert at == r.root and r.verified and digest("".join(r.proof)) == r.proof_sha256


def test_empty_and_one_row(spark):
    df = spark.createDataFrame(some_rows(1, ["a"])[:1], SCHEMA)
    assert manifest.prove(df.limit(0)).count() == 0
    (r,) = manifest.prove(df).collect()
    assert r.leaf == r.subroot == r.root and r.verified and r.proof_sha256 == digest("")


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    sql = con.execute(queries.oracle_sql()["op11_manifest"])
    names = [c[0] for c in sql.description]
    assert shown(queries.op11_manifest(spark, sf).collect()) == shown([dict(zip(names, r)) for r in sql.fetchall()])
