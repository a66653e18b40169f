"""Queries of the training-data operators, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import chat, divergence, hnsw, hyperminhash, langid, manifest, matroska, mixing, packing, quality, repeats, secrets, toxicity
from siltstone.llm.common import default_tokenizer, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digest(table(spark, sf_dir, "documents"))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(rows, rows.where("vec_id % 20 = 0"))


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer or default_tokenizer(), with_ids=False)


def op4_chat(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All conversations and one more, whose texts look like another template's control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    return chat.chat_digest(chat.format_chats(rows.unionByName(planted), tokenizer or default_tokenizer()))


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.sample(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first scan of a corpus: the ledger is empty, and every (blob, rule version) pair unseen."""
    return secrets.ledger_scan(table(spark, sf_dir, "documents"), ledger=spark.createDataFrame([], secrets.LEDGER))[0]


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))[0]


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row proven, those with a tampered text against the manifest of the rows as they are."""
    return manifest.prove(table(spark, sf_dir, "documents"), claimed=manifest.tampered())


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {"op1_matroska": op1_matroska, "op2_hnsw": op2_hnsw, "op3_packing": op3_packing, "op4_chat": op4_chat, "op5_hyperminhash": op5_hyperminhash, "op6_langid": op6_langid, "op7_mixing": op7_mixing, "op8_toxicity": op8_toxicity, "op9_secrets": op9_secrets, "op10_repeats": op10_repeats, "op11_manifest": op11_manifest, "op12_divergence": op12_divergence, "op13_quality": op13_quality, "pipeline": corpus_pipeline.run}


#: Mixing is plain arithmetic over an order, down to the hashed offsets.
OP7_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS ceiling FROM s),
x AS (SELECT *, sum(source_size) OVER () - sum(ceiling) OVER o + ceiling AS left_size, sum(weight) OVER () - sum(weight) OVER o + weight AS left_weight FROM w WINDOW o AS (ORDER BY ceiling / weight::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, left_size * weight > ceiling * left_weight AS stopped FROM x),
t AS (SELECT source, source_size, CASE WHEN stopped THEN ceiling::DOUBLE ELSE (sum(source_size) OVER () - sum(CASE WHEN stopped THEN ceiling ELSE 0 END) OVER ())::DOUBLE * weight / sum(weight) FILTER (WHERE NOT stopped) OVER () END AS target FROM y),
r AS (SELECT d.*, source_size, target, size * 64 > source_size AS heavy FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, row_number() OVER (PARTITION BY source, heavy ORDER BY size, doc_id) - 1 AS place, ('0x' || substr(md5('7' || coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM r),
h AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM p WHERE heavy),
hc AS (SELECT *, CAST(floor(u + (place + 1) * rate) - floor(u + place * rate) AS BIGINT) AS copies FROM h),
g AS (SELECT source, count(*) AS heavy_n, sum(size) AS heavy_size, sum(copies * size) AS heavy_taken FROM hc GROUP BY source),
l AS (SELECT p.*, u + coalesce(heavy_n, 0) * CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS start, CASE WHEN source_size > coalesce(heavy_size, 0) THEN least(greatest((target - coalesce(heavy_taken, 0)) / (source_size - coalesce(heavy_size, 0)), 0), 3) ELSE 0 END AS rate FROM p LEFT JOIN g ON p.source IS NOT DISTINCT FROM g.source WHERE NOT heavy),
lc AS (SELECT *, CAST(floor(start + (place + 1) * rate) - floor(start + place * rate) AS BIGINT) AS copies FROM l)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM (SELECT doc_id, size, source_size, target, copies FROM hc UNION ALL SELECT doc_id, size, source_size, target, copies FROM lc)
"""


def _framed(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _op11_tree(name: str, by: str, levels: int) -> str:
    """CTEs of a tree over `name`0 (by, pos, n, h): in each level the node above a run, and each node's siblings in its run."""
    out = []
    for k in range(levels):
        run = f"PARTITION BY {by}, pos // 8 ORDER BY pos ROWS BETWEEN"
        out.append(f"{name}{k}s AS (SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
        out.append(f"{name}{k + 1} AS (SELECT {by}, pos // 8 AS pos, (max(n) + 7) // 8 AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}{k} GROUP BY {by}, pos // 8)")
    return ", ".join(out)


def _op11_sql(levels: int = 9, top_levels: int = 4) -> str:
    """Unrolled for up to 8 ** levels rows of a language, 8 ** top_levels languages; beyond its root a level changes nothing."""
    fields = lambda text: " || ".join(map(_framed, ("doc_id", "source", "lang", "n_chars", text)))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # DuckDB has no crc32: a byte at a time through the table of the reflected polynomial
    table = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    ctes = [f"crc AS (SELECT {table} AS t)", f"d AS (SELECT doc_id, lang, sha256({fields('text')}) AS h, CASE WHEN {crc} % 3 = 0 THEN sha256({fields(lower)}) END AS claimed FROM documents, crc)"]
    ctes += ["a0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d)", _op11_tree("a", "lang", levels)]
    ctes += [f"b0 AS (SELECT 0 AS one, lang, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a{levels})", _op11_tree("b", "one", top_levels)]
    rungs = [f"a{k}s" for k in range(levels)] + [f"b{k}s" for k in range(top_levels)]
    joins = "".join(f" JOIN a{k}s ON a{k}s.lang IS NOT DISTINCT FROM a0.lang AND a{k}s.pos = a0.pos // {8**k}" for k in range(levels))
    joins += " JOIN b0s ON b0s.lang IS NOT DISTINCT FROM a0.lang" + "".join(f" JOIN b{k}s ON b{k}s.pos = b0s.pos // {8**k}" for k in range(1, top_levels))
    hand, folds = "coalesce(a0.claimed, a0.h)", []
    for i, x in enumerate(rungs):
        folds.append(f"f{i} AS (SELECT * EXCLUDE hand, CASE WHEN n{i} = 1 THEN hand ELSE sha256(l{i} || hand || r{i}) END AS hand FROM {f'f{i - 1}' if i else 'met'})")
    sides = ", ".join(f"{x}.l AS l{i}, {x}.r AS r{i}, {x}.n AS n{i}" for i, x in enumerate(rungs))
    ctes += [f"met AS (SELECT a0.doc_id, a0.h AS leaf, b0s.h AS subroot, (SELECT h FROM b{top_levels}) AS root, sha256({' || '.join(f'{x}.l || {x}.r' for x in rungs)}) AS proof_sha256, {sides}, {hand} AS hand FROM a0{joins})", *folds]
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, proof_sha256, hand AS folded_root, hand = root AS verified FROM f{len(rungs) - 1}"


#: Every pair of sources over every kept term, in 128-bit whole numbers.
OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
y AS (SELECT *, sum(n) OVER w + count(*) OVER w AS size, sum(lang_n) OVER w + count(*) OVER w AS lang_size FROM x WINDOW w AS (PARTITION BY lang, source)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // size::HUGEINT AS p, 1 + (1000000000::HUGEINT * (lang_n + 1)) // lang_size::HUGEINT AS q FROM y),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER o AS INTEGER) AS rank FROM u WINDOW o AS (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) QUALIFY part = 'pair' OR row_number() OVER o <= 200
"""


def oracle_sql() -> dict[str, str]:
    out = {"op7_mixing": OP7_SQL, "op11_manifest": _op11_sql(), "op12_divergence": OP12_SQL}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
