"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, shard results merged.

Vectors are dealt to shards by their hash; equal vectors are one node, which keeps its `k + 1` least ids (no query needs
more of them), collected within each task before anything is dealt out, so that one common vector fills no shard. A graph
is stored as flat arrays: the nodes' vectors, and per layer the node numbers and a fixed number of neighbour slots. Inner
product becomes closeness on a sphere by one added coordinate, the root of what the shard's largest norm leaves.

Graphs are built in batches: a batch searches the graph of the nodes before it, all its searches stepping together in
NumPy, and compares its own members; links are chosen by the diversity rule and pruned on both sides. Queries go in
blocks to every shard, and each shard returns one row of at most k per query, which a last aggregation merges. The number
of shards follows the number of rows at `SHARD_ROWS` a shard, so tasks stay of one size as the table grows.

Defined results. Vectors that are null, zero, or hold null or non-finite components take no part, and rows without an id
neither. Vectors of another length than the query's are not compared with it. A row repeated with the same id counts
once; copies under other ids are candidates of their own, ties to the smaller id. Fewer than k candidates: all of them.
Empty tables: empty results. Columns beside the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed

SHARD_ROWS = 16_384
BLOCK_QUERIES = 8192
LINKS = 16
EF_BUILD, EF_SEARCH = 80, 160
EXPAND = 4
#: Entries of the table of visited nodes, over the searches that step together.
VISITED = 1 << 23
#: Distinct vectors that a task holds before it hands them on.
HELD = 20_000


def _similarities(x: np.ndarray, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.einsum("qcd,qd->qc", x[nodes], q, optimize=True)


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the `ef` nearest nodes found, nearest first; -1 where there are fewer.

    links[node] lists neighbours (-1: none); entry holds starting nodes per query (-1: none).
    """
    out_ids, out_sims = np.full((len(q), ef), -1, np.int32), np.full((len(q), ef), -np.inf, np.float32)
    width = max(1, VISITED // max(1, len(x)))
    for at in range(0, len(q), width):
        part, n = q[at : at + width], len(q[at : at + width])
        stamp = np.full((n, len(x) + 1), -1, np.int32)  # the last place is for -1
        ids = np.full((n, ef), -1, np.int32)
        sims = np.full((n, ef), -np.inf, np.float32)
        done = np.ones((n, ef), bool)
        active, fresh = np.arange(n), entry[at : at + width]
        clock = 0
        while len(active):
            rows = active[:, None]
            seen = stamp[rows, fresh] >= 0
            mark = clock + np.arange(fresh.shape[1], dtype=np.int32)[None, :]
            stamp[rows, fresh] = np.where(seen, stamp[rows, fresh], mark)
            new = ~seen & (fresh >= 0) & (stamp[rows, fresh] == mark)
            clock += fresh.shape[1]
            found = np.where(new, _similarities(x, np.maximum(fresh, 0), part[active]), -np.inf).astype(np.float32)
            all_ids = np.concatenate((ids[active], np.where(new, fresh, -1)), 1)
            all_sims = np.concatenate((sims[active], found), 1)
            all_done = np.concatenate((done[active], ~new), 1)
            best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef] if all_sims.shape[1] > ef else np.broadcast_to(np.arange(ef), (len(active), ef))
            ids[active], sims[active], done[active] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sims, all_done))
            waiting = np.where(done[active], -np.inf, sims[active])
            pick = np.argpartition(-waiting, EXPAND - 1, axis=1)[:, :EXPAND]
            open_ = np.isfinite(np.take_along_axis(waiting, pick, 1))
            going = open_.any(1)
            active, pick, open_ = active[going], pick[going], open_[going]
            if not len(active):
                break
            chosen = np.where(open_, np.take_along_axis(ids[active], pick, 1), -1)
            flags = done[active]
            np.put_along_axis(flags, pick, True, 1)
            done[active] = flags
            fresh = np.where(chosen[:, :, None] >= 0, links[np.maximum(chosen, 0)], -1).reshape(len(active), -1)
        order = np.argsort(-sims, axis=1, kind="stable")
        out_ids[at : at + width], out_sims[at : at + width] = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return out_ids, out_sims


def choose_links(x: np.ndarray, candidates: np.ndarray, sims: np.ndarray, count: int) -> np.ndarray:
    """The diversity rule: nearest first, a candidate counts unless a chosen one is nearer to it than the node is.

    Free slots go to the nearest of those left out. `candidates` are sorted nearest first, -1 last.
    """
    n, c = candidates.shape
    out = np.full((n, count), -1, np.int32)
    for at in range(0, n, 512):
        cand, sim = candidates[at : at + 512], sims[at : at + 512]
        held = x[np.maximum(cand, 0)]
        between = held @ held.transpose(0, 2, 1)
        rank = np.full(cand.shape, 2 * c, np.int64)
        taken, size = np.zeros(cand.shape, bool), np.zeros(len(cand), np.int64)
        for j in range(c):
            near = np.where(taken, between[:, :, j], -np.inf).max(1)
            good = (cand[:, j] >= 0) & (near < sim[:, j]) & (size < count)
            taken[:, j] = good
            size += good
            rank[:, j] = np.where(good, j, np.where(cand[:, j] >= 0, c + j, 2 * c))
        order = np.argsort(rank, axis=1, kind="stable")[:, :count]
        out[at : at + 512, : order.shape[1]] = np.where(np.take_along_axis(rank, order, 1) < 2 * c, np.take_along_axis(cand, order, 1), -1)
    return out


def _sorted_candidates(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest first, without repeats and the node itself."""
    candidates = np.sort(candidates, 1)
    repeat = np.zeros(candidates.shape, bool)
    repeat[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    candidates = np.where(repeat | (candidates == nodes[:, None]), -1, candidates)
    sims = np.where(candidates >= 0, _similarities(x, np.maximum(candidates, 0), x[nodes]), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)


def build_layer(x: np.ndarray, entry: np.ndarray, slots: int) -> np.ndarray:
    """Neighbour slots of the nodes 0 .. len(x) - 1, put in in this order; entry[i] starts the search for node i."""
    n = len(x)
    links = np.full((n, slots), -1, np.int32)
    at = 0
    while at < n:
        size = min(n - at, 64 if at == 0 else min(at, 1024))
        batch = np.arange(at, at + size)
        own = x[batch] @ x[batch].T
        np.fill_diagonal(own, -np.inf)
        near = np.argsort(-own, 1, kind="stable")[:, : min(size - 1, slots)] + at if size > 1 else np.zeros((size, 0), np.int64)
        if at:
            starts = np.where(entry[batch] < at, entry[batch], 0)[:, None].astype(np.int32)
            found, _ = beam_search(x[:at], links[:at], x[batch], starts, EF_BUILD)
            near = np.concatenate((found[:, : max(slots, EF_BUILD // 2)], near), 1)
        if near.shape[1]:
            candidates, sims = _sorted_candidates(x, batch, near.astype(np.int32))
            links[batch, : slots // 2] = choose_links(x, candidates, sims, slots // 2)
            _link_back(x, links, batch)
        at += size
    return links


def _link_back(x: np.ndarray, links: np.ndarray, batch: np.ndarray) -> None:
    """Add the reverse of the batch's links; nodes with too many choose again."""
    to, source = links[batch].ravel(), np.repeat(batch, links.shape[1])
    kept = to >= 0
    to, source = to[kept], source[kept]
    near = np.einsum("id,id->i", x[to], x[source])
    order = np.lexsort((-near, to))
    to, source = to[order], source[order]
    targets, first, count = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, count)
    width = min(int(count.max()) if len(count) else 0, 2 * links.shape[1])
    incoming = np.full((len(targets), width), -1, np.int32)
    fits = place < width
    incoming[np.repeat(np.arange(len(targets)), count)[fits], place[fits]] = source[fits]
    for at in range(0, len(targets), 2048):
        nodes = targets[at : at + 2048]
        candidates, sims = _sorted_candidates(x, nodes, np.concatenate((links[nodes], incoming[at : at + 2048]), 1))
        links[nodes] = choose_links(x, candidates, sims, links.shape[1])


def on_sphere(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Float vectors of one norm whose inner products with (q, 0) are those of the originals; and the scale."""
    norms = (vectors**2).sum(1)
    scale = float(np.sqrt(norms.max())) or 1.0
    added = np.sqrt(np.maximum(norms.max() - norms, 0))
    return (np.concatenate((vectors, added[:, None]), 1) / scale).astype(np.float32), scale


def build(vectors: np.ndarray, seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top: (node numbers, neighbour slots as places in the layer's own list)."""
    n = len(vectors)
    x, _ = on_sphere(vectors)
    level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(np.int64), 6)
    order = np.argsort(-level, kind="stable")
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for height in range(int(level.max()), -1, -1):
        nodes = order[: int((level >= height).sum())]
        entry = descend(x, layers, x[nodes])
        layers.append((nodes.astype(np.int32), build_layer(x[nodes], entry, LINKS if height else 2 * LINKS)))
    return layers


def descend(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray) -> np.ndarray:
    """Place in the next layer (whose list begins with the last layer's nodes) that each query starts from."""
    place = np.zeros(len(q), np.int32)
    for nodes, links in layers:
        place = beam_search(x[nodes], links, q, place[:, None], EXPAND)[0][:, 0]
    return place


def search(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, k: int, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest nodes found for each query and their inner products in double precision; -1 where fewer."""
    x, _ = on_sphere(vectors)
    norm = np.maximum(np.sqrt((q**2).sum(1, keepdims=True)), 1e-300)
    asked = np.concatenate((q / norm, np.zeros((len(q), 1))), 1).astype(np.float32)
    place = descend(x, layers[:-1], asked)
    nodes, links = layers[-1]
    found = beam_search(x[nodes], links, asked, place[:, None], max(ef, k))[0]
    found = np.where(found >= 0, nodes[np.maximum(found, 0)], -1)
    exact = np.empty(found.shape)
    for at in range(0, len(q), 1024):
        exact[at : at + 1024] = np.einsum("qcd,qd->qc", vectors[np.maximum(found[at : at + 1024], 0)], q[at : at + 1024])
    exact[found < 0] = -np.inf
    order = np.argsort(-exact, 1, kind="stable")[:, :k]
    return np.take_along_axis(found, order, 1), np.take_along_axis(exact, order, 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dim, vector as binary of doubles) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                ids, dims, held = [], [], []
                for name, value in zip(batch.column(0)[at : at + 4096].to_pylist(), batch.column(1)[at : at + 4096]):
                    if name is None or not value.is_valid or not len(value.values) or value.values.null_count:
                        continue
                    v = value.values.to_numpy().astype(np.float64) + 0.0
                    if np.isfinite(v).all() and v.any():
                        ids.append(name)
                        dims.append(len(v))
                        held.append(v.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(held, pa.binary())], ["id", "dim", "vector"])

    return rows.select(F.col(f"`{key}`").cast("long"), F.col(f"`{vector}`")).mapInArrow(run, "id long, dim int, vector binary")


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """(dim, vector, its `keep` least ids in the task): a common vector leaves a task in a few rows."""

    def out(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([len(v) // 8 for v in held], pa.int32()), pa.array(list(held), pa.binary()), pa.array([sorted(i)[:keep] for i in held.values()], pa.list_(pa.int64()))], ["dim", "vector", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, set] = {}
        for batch in batches:
            for name, vector in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                own = held.setdefault(vector, set())
                own.add(name)
                if len(own) > 8 * keep:
                    held[vector] = set(sorted(own)[:keep])
            if len(held) > HELD:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    return vectors.mapInArrow(run, "dim int, vector binary, ids array<bigint>")


INDEX = "shard int, dim int, vectors binary, ids array<bigint>, id_starts array<int>, layers array<struct<nodes: binary, links: binary>>"
_LAYERS = pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())]))


def build_index(vectors: DataFrame, n_rows: int, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """One row per shard and vector length: the graph as flat arrays. And the number of shards."""
    shards = max(1, -(-n_rows // shard_rows))
    dealt = distinct_vectors(vectors, k + 1).withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        held: dict[bytes, set] = {}
        for vector, ids in zip(group.column("vector").to_pylist(), group.column("ids").to_pylist()):
            held.setdefault(vector, set()).update(ids)
        names = sorted(held)
        dim = group.column("dim")[0].as_py()
        own = [sorted(held[v])[: k + 1] for v in names]
        layers = build(np.frombuffer(b"".join(names), np.float64).reshape(-1, dim))
        return pa.table(
            {
                "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()),
                "dim": pa.array([dim], pa.int32()),
                "vectors": pa.array([b"".join(names)], pa.binary()),
                "ids": pa.array([[i for o in own for i in o]], pa.list_(pa.int64())),
                "id_starts": pa.array([np.concatenate(([0], np.cumsum([len(o) for o in own]))).astype(np.int32)], pa.list_(pa.int32())),
                "layers": pa.array([[{"nodes": a.tobytes(), "links": b.tobytes()} for a, b in layers]], _LAYERS),
            }
        )

    return dealt.groupBy("shard", "dim").applyInArrow(run, INDEX), shards


def nearest(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, key, score): the k nearest rows found for each query row, the query's own id left out.

    Ids may be of any type that sorts; others than whole numbers are numbered in their order for the search.
    """
    if rows.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return _by_number(rows, queries, key, vector, k, shard_rows, ef)
    index, shards = build_index(usable(rows, key, vector), rows.count(), k, shard_rows)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    index = checkpointed(index).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = usable(queries, key, vector).dropDuplicates(["id", "vector"])
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    types = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())]

    def run(graph: pa.Table, asks: pa.Table) -> pa.Table:
        names, scores, ids = [], [], []
        if graph.num_rows and asks.num_rows:
            dim = graph.column("dim")[0].as_py()
            vectors = np.frombuffer(graph.column("vectors")[0].as_py(), np.float64).reshape(-1, dim)
            starts, owned = graph.column("id_starts")[0].values.to_numpy(), graph.column("ids")[0].values.to_numpy()
            layers = [(nodes := np.frombuffer(one["nodes"], np.int32), np.frombuffer(one["links"], np.int32).reshape(len(nodes), -1)) for one in graph.column("layers")[0].as_py()]
            names = asks.column("id").to_pylist()
            found, exact = search(vectors, layers, _matrix(asks.column("vector"), dim), max(ef, k + 1), ef)
            least = exact[:, min(k, exact.shape[1] - 1)]  # vectors that tie with the last one stay, so that ids settle the tie
            for name, nodes, near, last in zip(names, found, exact, least):
                held = sorted((-s, i) for node, s in zip(nodes[(nodes >= 0) & (near >= last)], near.tolist()) for i in owned[starts[node] : starts[node + 1]].tolist() if i != name)[:k]
                scores.append([-s for s, _ in held])
                ids.append([i for _, i in held])
        return pa.table([pa.array(c, t) for c, t in zip((names, scores, ids), types)], ["query_id", "scores", "ids"])

    by = ("shard", "dim", "block")
    parts = index.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, "query_id long, scores array<double>, ids array<bigint>")
    pairs = F.transform(F.arrays_zip("scores", "ids"), lambda p: F.struct((-p["scores"]).alias("far"), p["ids"].alias("id")))
    merged = parts.groupBy("query_id").agg(F.flatten(F.collect_list(pairs)).alias("all"))
    best = merged.select("query_id", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("place", "pair"))
    return best.select("query_id", (F.col("place") + 1).alias("rank"), F.col("pair.id").alias(key), (-F.col("pair.far")).alias("score"))


def _by_number(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, shard_rows: int, ef: int) -> DataFrame:
    ids = rows.select(F.col(f"`{key}`").alias("name")).unionByName(queries.select(F.col(f"`{key}`").alias("name")))
    ids = checkpointed(ids.where("name is not null").distinct().orderBy("name").withColumn("number", F.monotonically_increasing_id()))

    def numbered(frame: DataFrame) -> DataFrame:
        return frame.select(F.col(f"`{key}`").alias("name"), F.col(f"`{vector}`").alias("vector")).join(ids, "name").select("number", "vector")

    found = nearest(numbered(rows), numbered(queries), "number", "vector", k, shard_rows, ef)
    asked = ids.select(F.col("name").alias("query"), F.col("number").alias("query_id"))
    named = found.join(asked, "query_id").join(ids, "number")
    return named.select(F.col("query").alias("query_id"), "rank", F.col("name").alias(key), "score")
