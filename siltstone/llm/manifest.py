"""A Merkle manifest of a dataset, and proofs that rows still belong to it.

Each row is a leaf: the SHA-256 of its fields, framed by their lengths. Within each language the leaves stand in order of
the key, and every `FANOUT` consecutive nodes become one until a single node, the language's subroot, remains; the
subroots become the root in the same way. A row's proof is the siblings on its way to the root.

Spark hashes the leaves, numbers them by a range partitioning (no task sees a whole language) and deals them out in aligned
blocks of `BLOCK` leaves, which are whole subtrees of `LEVELS` levels. In each block an embedded DuckDB runs one query a
level on the block's Arrow table: an ordered `string_agg` of a run, and its `sha256`. Blocks give one node each; these are
dealt out in blocks again, a round for every `LEVELS` levels, so no task holds more than `BLOCK` nodes of any tree. Going
down, each block's nodes meet the proof of their block in a cogroup, and add their own siblings to it. Texts are read once
and never shuffled: what moves is two digests a row. A lost executor costs the blocks it held; positions are written before
they are used, so a repeated task sees the same ones.

Defined results. Null fields: `-`, which no framed value equals. Null language: a language of its own, first in order. Null
keys: first in their language. Equal keys: in order of their leaves; repeated rows are leaves of their own, and interchangeable.
Empty table: no rows. Very long texts are hashed whole. Columns beside the named fields are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.llm.common import partitions, released, stored

FANOUT = 8
LEVELS = 4
BLOCK = FANOUT**LEVELS
DIGEST = 64

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODES = "grp string, n long, pos long, node binary"
PATHS = "grp string, pos long, name string, path array<string>, subroot string, root string"


def framed(value: Column) -> Column:
    """`-` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(framed, values)), 256))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with `n`, the size of their `grp`, and `pos`, their place in it (from 0) by `order`.

    Rows are dealt out by range of (grp, order); each partition numbers its own, and the sizes of what each partition holds
    of a group are summed up. Ties are broken by the rows' place in the input, so that they can be split.
    """
    keys = ["grp", *order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(rows), *keys).sortWithinPartitions(*keys).drop("tie")
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    cells = dealt.groupBy("grp", part.alias("part")).agg(F.count("*").alias("held"), F.min("at").alias("first"))
    whole = Window.partitionBy("grp")
    before = F.sum("held").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")
    cells = stored(cells.select(F.col("grp").alias("g"), F.col("part").alias("p"), "first", before.alias("before"), F.sum("held").over(whole).alias("n")))
    return dealt.join(cells, (F.col("grp") == F.col("g")) & (part == F.col("p"))).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("g", "p", "at", "first", "before")


def levels_in(n: int) -> int:
    """Levels that a block of a tree of `n` nodes has: all of them beyond one block, else until one node remains."""
    if n > BLOCK:
        return LEVELS
    k = 0
    while FANOUT**k < n:
        k += 1
    return k


_ENGINE = None


def engine():
    """This worker's DuckDB: in memory, one thread, as Spark deals out the cores."""
    global _ENGINE
    if _ENGINE is None:
        import duckdb

        _ENGINE = duckdb.connect(":memory:", config={"threads": 1})
    return _ENGINE


def queried(nodes: pa.Table, sql: str) -> pa.Table:
    held = engine()
    held.register("nodes", nodes)
    try:
        return held.sql(sql).to_arrow_table()
    finally:
        held.unregister("nodes")


def level_queries(levels: int) -> str:
    """n0 is the block's nodes in hex; r1, r2 … the runs of each level as one text, n1, n2 … their digests."""
    out = ["n0 AS MATERIALIZED (SELECT *, lower(hex(node)) AS h FROM nodes)"]
    for k in range(1, levels + 1):
        out.append(f"r{k} AS MATERIALIZED (SELECT pos // {FANOUT} AS up, string_agg(h, '' ORDER BY pos) AS run FROM n{k - 1} GROUP BY up)")
        out.append(f"n{k} AS MATERIALIZED (SELECT up AS pos, sha256(run) AS h FROM r{k})")
    return "WITH " + ", ".join(out)


def sibling_query(levels: int, columns: str) -> str:
    """The columns of each node, with l1, s1, l2, s2 …: the siblings left and right of its way up, in each level."""
    own = [f"(n0.pos // {FANOUT ** (k - 1)}) % {FANOUT}" for k in range(1, levels + 1)]
    cut = "".join(f", left(r{k}.run, {DIGEST} * ({i})) AS l{k}, substr(r{k}.run, {DIGEST} * ({i}) + {DIGEST + 1}) AS s{k}" for k, i in enumerate(own, 1))
    joins = "".join(f" JOIN r{k} ON r{k}.up = n0.pos // {FANOUT**k}" for k in range(1, levels + 1))
    return f"{level_queries(levels)}, met AS (SELECT n0.*{cut} FROM n0{joins}) SELECT {columns} FROM met ORDER BY pos"


def block_root(key: tuple, nodes: pa.Table) -> pa.Table:
    n = nodes.column("n")[0].as_py()
    levels = levels_in(n)
    top = queried(nodes, f"{level_queries(levels)} SELECT unhex(h) AS node FROM n{levels}")
    return pa.table({"grp": pa.array([key[0].as_py()]), "n": pa.array([-(-n // BLOCK)]), "pos": pa.array([key[1].as_py()]), "node": top.column("node").combine_chunks().cast(pa.binary())})


def block() -> Column:
    return F.floor(F.col("pos") / BLOCK).alias("block")


def risen(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round, the given ones first, and (grp, node): the one that remains of each group."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds = [nodes]
    while True:
        nodes = stored(nodes.select("grp", "n", "pos", "node").groupBy("grp", block()).applyInArrow(block_root, NODES))
        if most <= BLOCK:
            return rounds, nodes.select("grp", "node")
        rounds.append(nodes)
        most = -(-most // BLOCK)


def quoted(values: list[str]) -> str:
    """A list of digests as SQL; nothing else gets here."""
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def block_paths(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Each node's siblings up to the root: its own levels', then those of its block."""
    levels, outer = levels_in(nodes.column("n")[0].as_py()), above.to_pylist()[0]
    own = ", ".join(f"l{k}, s{k}" for k in range(1, levels + 1))
    columns = f"grp, pos, name, list_concat([{own}]::VARCHAR[], {quoted(outer['path'])}) AS path, '{outer['subroot']}' AS subroot, '{outer['root']}' AS root"
    return queried(nodes, sibling_query(levels, columns)).cast(pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("name", pa.string()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())]))


def descended(rounds: list[DataFrame], paths: DataFrame, last: Callable, schema: str) -> DataFrame:
    """From the paths of the groups' roots (as blocks, pos 0) down the rounds; `last` treats the first round's blocks."""
    for nodes in reversed(rounds):
        at_leaves = nodes is rounds[0]
        named = nodes if at_leaves else nodes.withColumn("name", F.lit(None).cast("string"))
        met = named.groupBy("grp", block()).cogroup(paths.groupBy("grp", "pos"))
        paths = met.applyInArrow(last if at_leaves else block_paths, schema if at_leaves else PATHS)
        if not at_leaves:
            paths = stored(paths)
    return paths


def folded(levels: int, outer: list[str]) -> str:
    """SQL of the digest reached from the leaf in hand (`claimed`, else `node`) with the siblings of its path."""
    at = "lower(hex(coalesce(claimed, node)))"
    for left, right in [*((f"l{k}", f"s{k}") for k in range(1, levels + 1)), *((f"'{a}'", f"'{b}'") for a, b in zip(outer[::2], outer[1::2]))]:
        at = f"sha256({left} || {at} || {right})"
    return at


def proven(with_proof: bool, key_type: pa.DataType) -> Callable:
    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        levels, outer = levels_in(nodes.column("n")[0].as_py()), above.to_pylist()[0]
        own = ", ".join(f"l{k}, s{k}" for k in range(1, levels + 1))
        sides = f"list_concat([{own}]::VARCHAR[], {quoted(outer['path'])})"
        columns = f"key, h AS leaf, '{outer['subroot']}' AS subroot, '{outer['root']}' AS root, sha256(array_to_string({sides}, '')) AS proof_sha256, {folded(levels, outer['path'])} AS folded_root"
        columns += f", pos AS position, {sides} AS proof" if with_proof else ""
        out = queried(nodes, sibling_query(levels, columns))
        same = [pa.field("key", key_type), *(pa.field(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))]
        more = [pa.field("position", pa.int64()), pa.field("proof", pa.list_(pa.string()))] if with_proof else []
        return out.cast(pa.schema(same + more))

    return run


def manifest(docs: DataFrame, key: str = "doc_id", lang: str = "lang", fields: tuple[str, ...] = FIELDS, claimed: Column | None = None) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(leaves with their places, the nodes of each round, (name, pos, subroot, root) of each language).

    `claimed`, where it is given, is the leaf of what a reader holds of the row; null: the row itself.
    """
    tongue = F.col(f"`{lang}`").cast("string")
    grp = F.when(tongue.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), tongue))
    base = stored(docs.select(grp.alias("grp"), F.col(f"`{key}`").alias("key"), leaf([F.col(f"`{c}`") for c in fields]).alias("node"), (F.lit(None).cast("binary") if claimed is None else claimed).alias("claimed")))
    leaves = stored(placed(base, "key", "node"))
    released(base)
    rounds, subroots = risen(leaves)
    tops = stored(placed(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), "name"))
    return leaves, rounds, tops


def prove(docs: DataFrame, key: str = "doc_id", lang: str = "lang", fields: tuple[str, ...] = FIELDS, claimed: Column | None = None, with_proof: bool = False) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each row; with its position and proof if asked.

    `folded_root` is what the siblings of the row's path make of its claimed leaf; `verified`, whether that is the root. A
    proof lists the siblings left and right of the path, level by level, each as one text of digests.
    """
    leaves, rounds, tops = manifest(docs, key, lang, fields, claimed)
    top_rounds, root = risen(tops)
    start = root.select("grp", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("name"), F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.lower(F.hex("node")).alias("root"))
    paths = stored(descended(top_rounds, start, block_paths, PATHS))
    subroots = tops.select(F.col("name").alias("of"), F.lower(F.hex("node")).alias("top"))
    paths = paths.join(subroots, F.col("name") == F.col("of")).select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("name"), "path", F.col("top").alias("subroot"), "root")
    kind = docs.select(F.col(f"`{key}`").alias("key")).schema["key"].dataType
    schema = f"key {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + ", position long, proof array<string>" * with_proof
    out = descended(rounds, paths, proven(with_proof, to_arrow_type(kind)), schema)
    return out.withColumnRenamed("key", key).withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column) -> Column:
    """A-Z as a-z, and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(key: str = "doc_id", text: str = "text", fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf of a row whose text was lower-cased, where 3 divides the checksum of its decimal key; else null."""
    values = [lowered(F.col(f"`{c}`")) if c == text else F.col(f"`{c}`") for c in fields]
    return F.when(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3 == 0, leaf(values))
