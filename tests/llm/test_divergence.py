"""The audit of sources against its SQL and a plain version."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from siltstone.llm import divergence, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = {t for t, n in Counter(t for d in own for t in set(d[2])).items() if n >= 3}
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pairs = {o: sum(f(p[s][t], p[o][t]) for t in kept) for o in p if o != s}
            terms = {t: f(p[s][t], q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]}
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                order = sorted(values, key=lambda x: (-values[x], x.encode()))[:most]
                out |= {(lang, s, part, x, values[x], i) for i, x in enumerate(order, 1)}
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_rows():
    random.seed(3)
    vocabulary = [f"{a}{b}" for a in "abcdefghijk" for b in ("x", "é", "Yz", "ß", "k" * 9, "日本")]
    rows = []
    for i in range(400):
        source = random.choice(["s0"] * 5 + ["s1", "s2", None, "", "Ä"])
        weights = [1 + (hash((source, w)) % 7 == 0) * 9 for w in range(len(vocabulary))]
        rows.append((" 9, ".join(random.choices(vocabulary, weights, k=random.randint(0, 30))), random.choice(["en", "en", "de", None]), source))
    rows += rows[:20] + [(None, "en", "none"), ("", "xx", "a"), ("1 2 3 .", "xx", "b"), ("only once here", "yy", "a"), ("twice", "yy", "b"), (None, None, None)]
    return rows + [("long tail " * 40_000, "en", "s0"), *[("all the same", "zz", s) for s in "abc"]]


@pytest.mark.parametrize("top", [1, 5, 200])
def test_against_a_plain_version(spark, top):
    rows = some_rows()
    df = spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], "text string, lang string, source string, term int, part string, `n` int, `a.b` int")
    assert rows_of(divergence.audit(df, top=top)) == plain(rows, top)
    assert divergence.audit(df.limit(0)).count() == 0


def test_postings_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS_HELD", 5)
    import pyarrow as pa

    random.seed(1)
    rows = sorted((lang, term, source, random.randint(1, 10**9)) for lang in "ab" for term in "uvwxyz" for source in random.sample("klmnopq", random.randint(1, 7)))
    start = {s: i * 1000 + 5 for i, s in enumerate("klmnopq")}
    table = pa.table({"lang": [r[0] for r in rows], "term": [r[1] for r in rows], "source": [r[2] for r in rows], "p": [r[3] for r in rows], "p0": [start[r[2]] for r in rows]})
    got, want = Counter(), Counter()
    for batch in divergence.meet(iter(table.to_batches(max_chunksize=3))):
        for r in batch.to_pylist():
            got[r["lang"], r["source"], r["item"]] += r["value"]
    f = lambda a, b: (a - b) ** 2 // b
    for lang, term, s, p in rows:
        for other, word, o, q in rows:
            if (lang, term) == (other, word) and s != o:
                want[lang, s, o] += f(p, q) - f(p, start[o]) - f(start[s], q) + f(start[s], start[o])
    assert got == want


def test_shares_are_exact_beyond_64_bits(spark):
    values = [(0, 1), (10**13, 3 * 10**13 + 7), (9 * 10**12, 9 * 10**12 + 1), (2**40, 2**50 + 1)]
    df = spark.createDataFrame(values, "n long, total long")
    assert [r[0] for r in df.select(divergence.share(df.n, df.total)).collect()] == [1 + 10**9 * (n + 1) // t for n, t in values]


def test_terms_keep_whole_characters():
    import pyarrow as pa

    from siltstone.llm.common import text_bytes

    texts = ["A日本b, ÉÉ", "", "x", "1 2", "Zz-zZ"]
    terms, row = divergence.term_array(*text_bytes(pa.array(texts)))
    assert terms.to_pylist() == ["a日本b", "ÉÉ", "x", "zz", "zz"] and np.array_equal(row, [0, 0, 2, 4, 4])


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert rows_of(queries.op12_divergence(spark, sf)) == set(con.execute(queries.oracle_sql()["op12_divergence"]).fetchall())
