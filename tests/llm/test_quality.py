"""Counts against a plain version; estimates against the same steps in numpy; verdicts on planted rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import quality, queries

WORD = r"[^\x20\x09-\x0D]+"


def plain_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines), len(set(words))


def plain_estimates(groups):
    """{group: (m, centre, scatter)} by the same starts, bins and steps."""
    floor = np.diag([(quality.UNIT * v) ** 2 for v in quality.FLOOR.values()])
    out = {}
    for g, x in groups.items():
        q = np.percentile(x, [25, 50, 75], axis=0)
        mean, cov, told = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floor, None
        for _ in range(quality.STEPS):
            gap = x - mean
            bins = np.floor(quality.BINS * np.log1p(np.einsum("ni,ij,nj->n", gap, np.linalg.inv(cov), gap)))
            last = np.sort(bins)[int(np.ceil(len(x) * quality.SHARE)) - 1]
            near = x[bins <= last]
            mean, cov = near.mean(0), np.cov(near.T, bias=True) + floor
            now = (len(near), near.sum(0).tolist())
            if now == told:
                break
            told = now
        out[g] = (len(near), mean, cov * quality.CONSISTENCY)
    return out


def plain_mixed(own, above):
    (m, u, c), (_, v, d) = own, above
    w, gap = m / (m + quality.PRIOR), u - v
    return m, v + w * gap, w * c + (1 - w) * d + w * (1 - w) * np.outer(gap, gap)


def plain_verdicts(rows):
    counts = [plain_counts(r[1]) for r in rows]
    failed = [c[0] < 20 or 100 * c[4] > 30 * c[0] for c in counts]
    held = {}
    points = []
    for (_, _, lang, source), (n, chars, symbols, dups, repeats, lines, distinct), bad in zip(rows, counts, failed):
        if bad:
            points.append(None)
            continue
        values = [np.log(chars / n), np.log1p(100 * symbols / n), np.log1p(100 * dups / max(lines, 1)), np.log1p(100 * repeats / n), 10 * np.log(distinct) / np.log(n)]
        points.append(np.floor(np.array(values) * quality.UNIT + 0.5))
        for g in ((), (lang,), (lang, source)):
            held.setdefault(g, []).append(points[-1])
    found = plain_estimates({g: np.array(v) for g, v in held.items()})
    langs = {g: plain_mixed(found[g], found[()]) for g in found if len(g) == 1}
    whole = {g: plain_mixed(found[g], langs[g[:1]]) for g in found if len(g) == 2}
    for (key, _, lang, source), c, bad, x in zip(rows, counts, failed, points):
        distance = None if bad else float((x - whole[lang, source][1]) @ np.linalg.inv(whole[lang, source][2]) @ (x - whole[lang, source][1]))
        yield key, *c[:5], bad, not bad and distance <= quality.CUTOFF, distance


def matches(got, rows):
    want = sorted(plain_verdicts(rows), key=lambda r: str(r[:7]))
    got = sorted((tuple(r) for r in got), key=lambda r: str(r[:7]))
    assert [g[:8] for g in got] == [w[:8] for w in want]
    assert all(a[8] == b[8] is None or a[8] == pytest.approx(b[8], rel=1e-6, abs=1e-6) for a, b in zip(got, want))


def some_rows():
    random.seed(6)
    word = lambda: "".join(random.choices("abcdefghi", k=random.randint(2, 8)))
    text = lambda n: "".join(word() + random.choice([" "] * 9 + ["\n", "\t", ". "]) for _ in range(n))
    rows = [(i, text(random.randint(25, 200)), random.choice(["en", "de", None]), random.choice(["a"] * 6 + ["b", None, "-"])) for i in range(500)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(60)), "en", "a") for i in range(10)]
    rows += [(2000, None, "en", "a"), (2001, "", None, None), (2002, " \n\t", "en", "b"), (2003, "w " * 19, "en", "a"), (2004, text(40) * 3, "de", "a"), (None, text(50), "en", "a")]
    rows += [(2005, text(60_000), "en", "lone"), (2006, (text(12).replace("\n", " ") + "\n") * 2 + text(90), "en", "a")]
    return rows + rows[:4]


def test_counts_on_odd_texts(spark):
    texts = ["", " ", None, "a", "a\x0bb\x0cc\rd", "x\n\nx\n x\n \n\t\n", "é# <b>", "a b " * 30, "one two three four five six seven eight " * 2, "\n".join(["l i n e"] * 5), "ü" * 300_000, "w " * 9, " a  b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'l' lang", "'s' source", "1 words", "2 lines", "3 `a.b`", "4 grp")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct"]
    got = {r["key"]: tuple(r[c] for c in names) for r in quality.counted(df).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def test_verdicts_against_the_same_steps_in_numpy(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 grp", "2 n", "3 length", "4 `a.b`")
    got = quality.judged(df).collect()
    matches(got, rows)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in range(1000, 1010)) and all(kept[i] for i in range(500))


def test_a_group_of_copies_rejects_no_others(spark):
    rows = some_rows()[:200]
    rows += [(5000 + i, rows[0][1], "en", "a") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality.judged(df).collect()
    matches(got, rows)
    assert all(r.kept for r in got)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "few words", "en", "a")], "doc_id long, text string, lang string, source string")
    assert [(r.base_failed, r.kept, r.distance) for r in quality.judged(df).collect()] == [(True, False, None)]
    assert quality.judged(df.limit(0)).count() == 0


def test_query_against_the_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    matches(queries.op13_quality(spark, sf).collect(), [(d.doc_id, d.text, d.lang, d.source) for d in docs])


def test_no_python_in_the_plan(spark, sf):
    plan = quality.counted(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
