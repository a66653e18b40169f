"""Quality rules over whole texts, and robust multivariate outliers of their statistics by language and source.

A document fails the base rules with fewer than 20 words, or with over 30 % of its words in repeated windows of eight. Of
those that pass, five statistics are transformed to be roughly symmetric, and each language and source gets a
minimum-covariance-determinant estimate of their centre and scatter: starting from medians and quartiles, a concentration
step measures every document's Mahalanobis distance and takes the mean and covariance of the nearest three quarters, until
no group's subset changes, or `STEPS` of them. A document is rejected if its distance from its group's estimate is beyond `CUTOFF`.

All of it is built from Spark's own functions: counts are row-local array expressions, without a shuffle of words; a step is
one aggregate by group and distance bin, summed up in each task before it moves, so a hot group costs no single task. The
sums are of whole thousandths and so do not depend on their order; medians too are of whole numbers, whose distinct values are
few. The subset is taken to the end of the distance bin in which the three quarters are reached. What is joined back to the
rows is one row a group; it is broadcast where the groups were counted and are at most `GROUPS_BROADCAST`.

Groups are estimated on three levels: all documents, a language, a language and source. Each level is mixed with the one
above as if that held `PRIOR` documents of it, so small groups lean on their language. `FLOOR` is the least spread by which a
departure is measured; it keeps groups of copies from rejecting everything else.

Defined results. Null or empty text: no words, fails. Null language or source: a value of its own. Repeated rows: each counts,
and gets the same verdict. Empty table: no rows; if none passes the base rules, none is rejected further. Very long texts are
taken whole. Ties: documents in one distance bin are taken together. Columns beside the named four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import counted as rows_in
from siltstone.llm.common import released, stored

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
BETWEEN = r"[\x20\x09-\x0D]+"
INSIDE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: The statistics in order, and the least spread of each.
FLOOR = {"length": 0.08, "symbols": 0.5, "lines": 1.5, "repeats": 1.5, "variety": 0.3}
UNIT = 1000
SHARE = 0.75
#: What makes the covariance of the nearest three quarters consistent for five normal statistics.
CONSISTENCY = 1.412
PRIOR = 50
BINS = 50
#: Most concentration steps; later ones move few documents at the subset's edge.
STEPS = 10
#: Groups whose estimates (some 400 bytes each) are broadcast; more are joined by a shuffle.
GROUPS_BROADCAST = 10_000
#: Squared distance that one document in 10 ** 5 of a normal population exceeds, for five statistics.
CUTOFF = 30.86

NAMES = list(FLOOR)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, grp of language and source, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct).

    Repeated windows: their hashes stand in an array; only where a hash recurs are they sorted with their places, neighbours
    compared (by two hashes), and the words under the recurring ones counted from the gaps between their places.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-"))
    own = ["key", "lang", "source"]
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(INSIDE))
    rows = docs.select(F.col(f"`{key}`").alias("key"), named(lang).alias("lang"), named(source).alias("source"), F.array_remove(F.split(body, BETWEEN), "").alias("words"), lines.alias("lines"), F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    n, lines = F.size("words"), F.size("lines")
    window = lambda of, i: of(*[F.get("words", i + k) for k in range(WINDOW)])
    rows = rows.select(
        *own, "words", "n_symbols", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        lines.cast("long").alias("n_lines"), (lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: window(F.xxhash64, i))).alias("hashes"),
    )
    own = [*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_distinct"]
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), window(F.hash, i).alias("g"), i.alias("place"))))
    rows = rows.select(*own, F.when(F.size("hashes") > F.size(F.array_distinct("hashes")), placed).alias("sorted"))
    after = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    rows = rows.select(*own, "sorted", F.zip_with("sorted", after("sorted"), lambda x, y: (x["h"] == y["h"]) & (x["g"] == y["g"])).alias("same"))
    found = lambda i: F.coalesce(F.get("same", i), F.lit(False))
    recurring = F.transform(F.filter("sorted", lambda _, i: found(i) | found(i - 1)), lambda x: x["place"])
    rows = rows.select(*own, F.sort_array(recurring).alias("places"))
    gaps = F.zip_with("places", after("places"), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))))
    return rows.select(*own, F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).alias("n_repeat_words"))


def statistics() -> dict[str, Column]:
    """In thousandths: word length, symbols by word, repeated lines and words by share, all as logarithms; variety of words."""
    n = F.col("n_words")
    percent = lambda a, b: F.log1p(100 * F.col(a) / F.greatest(b, F.lit(1)))
    values = {
        "length": F.log(F.col("word_chars") / n), "symbols": percent("n_symbols", n), "lines": percent("n_dup_lines", F.col("n_lines")), "repeats": percent("n_repeat_words", n),
        "variety": 10 * F.log(F.col("n_distinct")) / F.log(n),
    }
    return {name: F.round(UNIT * value).cast("long").alias(name) for name, value in values.items()}


def whitened(rows: DataFrame) -> DataFrame:
    """From the covariance c00, c10, c11 …: w00, w10, w11 …, the inverse of its lower Cholesky factor l00, l10, l11 …"""
    p, made = range(len(NAMES)), []
    for j in p:
        rest = {i: " - ".join([f"c{i}{j}", *(f"l{i}{k} * l{j}{k}" for k in range(j))]) for i in p if i >= j}
        made += [f"sqrt({rest[j]}) AS l{j}{j}", *(f"({rest[i]}) / l{j}{j} AS l{i}{j}" for i in p if i > j)]
    for i, j in PAIRS:
        made.append(f"1 / l{i}{i} AS w{i}{i}" if i == j else f"-({' + '.join(f'l{i}{k} * w{k}{j}' for k in range(j, i))}) / l{i}{i} AS w{i}{j}")
    return rows.selectExpr("*", *made)


def fields() -> list[str]:
    return [f"u{i}" for i in range(len(NAMES))] + [f"w{i}{j}" for i, j in PAIRS]


def squared_distance() -> Column:
    sides = [" + ".join(f"w{i}{j} * ({NAMES[j]} - u{j})" for j in range(i + 1)) for i in range(len(NAMES))]
    return F.expr(" + ".join(f"({x}) * ({x})" for x in sides))


def floored(i: int, j: int) -> str:
    return f"{(UNIT * FLOOR[NAMES[i]]) ** 2 if i == j else 0.0}D"


def started(points: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each group as a first centre and scatter."""
    quarters = points.groupBy("grp").agg(F.count("*").alias("n"), *[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in NAMES])
    middle = [f"{c}[1] AS u{i}" for i, c in enumerate(NAMES)]
    spread = [f"{floored(i, j)} + " + (f"pow(({NAMES[i]}[2] - {NAMES[i]}[0]) / 1.349D, 2)" if i == j else "0D") + f" AS c{i}{j}" for i, j in PAIRS]
    return whitened(quarters.selectExpr("grp", "n", *middle, *spread))


def at_hand(estimate: DataFrame, groups: int) -> DataFrame:
    return F.broadcast(estimate) if groups <= GROUPS_BROADCAST else estimate


def concentrated(points: DataFrame, estimate: DataFrame, groups: int) -> DataFrame:
    """One step: (grp, n, m, s…, u…, c…) from the nearest `SHARE` of each group by the estimate's distances."""
    sums = {f"s{i}": c for i, c in enumerate(NAMES)} | {f"s{i}{j}": f"{NAMES[i]} * {NAMES[j]}" for i, j in PAIRS}
    bin_ = F.floor(BINS * F.log1p(squared_distance())).cast("int")
    cells = points.join(at_hand(estimate.select("grp", "n", *fields()), groups), "grp").groupBy("grp", "n", bin_.alias("bin")).agg(F.count("*").alias("m"), *[F.expr(f"sum({c}) AS {s}") for s, c in sums.items()])
    before = F.sum("m").over(Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")
    near = cells.withColumn("before", before).where(F.col("before") < F.ceil(F.col("n") * SHARE))
    out = near.groupBy("grp", "n").agg(*[F.expr(f"sum({c}) AS {c}") for c in ("m", *sums)])
    centre = [f"s{i} / m AS u{i}" for i in range(len(NAMES))]
    return out.selectExpr("*", *centre, *[f"s{i}{j} / m - u{i} * u{j} + {floored(i, j)} AS c{i}{j}" for i, j in PAIRS])


def estimates(points: DataFrame, steps: int = STEPS) -> DataFrame:
    """Concentration steps until no group's subset changes: its size and sums stay as they were."""
    held, told = stored(started(points)), None
    groups = rows_in(held)
    for _ in range(steps):
        found = stored(concentrated(points, held, groups))
        same = ["grp", "m", *[f"s{i}" for i in range(len(NAMES))]]
        if told is not None and found.select(*same).join(told.select(*same), same, "left_anti").isEmpty():
            return found
        told = found
        held = whitened(found)
    return found


def mixed(own: DataFrame, above: DataFrame, up: Column) -> DataFrame:
    """The estimates of one level mixed with those of the level above, which weigh as `PRIOR` documents."""
    p = range(len(NAMES))
    above = above.selectExpr("grp AS up", *[f"u{i} AS v{i}" for i in p], *[f"c{i}{j} AS d{i}{j}" for i, j in PAIRS])
    met = own.withColumn("of", up).join(above, F.col("of") == F.col("up")).withColumn("own", F.col("m") / (F.col("m") + PRIOR))
    spread = [f"own * c{i}{j} + (1 - own) * d{i}{j} + own * (1 - own) * (u{i} - v{i}) * (u{j} - v{j}) AS c{i}{j}" for i, j in PAIRS]
    return met.selectExpr("grp", "m", *[f"v{i} + own * (u{i} - v{i}) AS u{i}" for i in p], *spread)


def robust(points: DataFrame) -> DataFrame:
    """(grp, u…, w…) of each language and source. A group's name is its level and its values, framed."""
    found = estimates(points)
    scaled = found.selectExpr("grp", "m", *[f"u{i}" for i in range(len(NAMES))], *[f"{CONSISTENCY}D * c{i}{j} AS c{i}{j}" for i, j in PAIRS])
    level = lambda k: scaled.where(F.col("grp").startswith(f"{k}"))
    langs = mixed(level(1), level(0), F.lit("0"))
    groups = mixed(level(2), langs, F.concat(F.lit("1"), F.substring_index(F.substr("grp", F.lit(2)), "\0", 1)))
    return stored(whitened(groups).select("grp", *fields()))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of each document.

    `distance` is the squared distance from the group's estimate; null for those that fail the base rules.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = stored(counted(docs, key, text, lang, source).withColumn("base_failed", failed))
    grp = F.concat(F.lit("2"), F.col("lang"), F.lit("\0"), F.col("source"))
    levels = F.array(F.lit("0"), F.concat(F.lit("1"), F.col("lang")), grp)
    measured = rows.where("NOT base_failed").select(levels.alias("levels"), *statistics().values())
    points = stored(measured.select(F.explode("levels").alias("grp"), *NAMES))
    model = robust(points)
    released(points)
    base = ["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    scored = rows.select(*base, F.when(~F.col("base_failed"), grp).alias("of"), *[F.when(~F.col("base_failed"), c).alias(name) for name, c in statistics().items()])
    met = scored.join(at_hand(model, rows_in(model)), F.col("of") == F.col("grp"), "left").withColumn("distance", squared_distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return met.select(F.col("key").alias(key), *base[1:], kept.alias("kept"), "distance")
