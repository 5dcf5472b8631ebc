"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Equal vectors are one node with the list of their ids, so large groups of copies neither
break the graph nor fill an answer.  Nodes are dealt to shards of up to about ``SHARD`` by a hash;
each shard's graph is built in bulk: levels by a geometric draw, for every level the nearest
nodes of the level by blocked matrix products, thinned by the diversity rule and made
mutual, all stored as flat int32 neighbour arrays.  Queries walk down the levels and run a
beam search on the lowest, all queries of a block in step.  Each shard returns its best; the
best of all shards are ranked by exact double-precision distance on the original vectors.

Graphs never move: the queries, a stated set, are broadcast in blocks of ``QUERY_BYTES``, each
graph is loaded once for a block, and a task merges the answers of all the graphs it reads, so
that what is shuffled are k answers for each query and task.

Vectors that are null, zero, or hold null or non-finite components take no part; vectors of
another length are searched among their own length only.  Rows that repeat an id are one
candidate at the least of their distances, listed once; as a query they ask with the least of
their vectors.  Rows with a null id take no part.  Other columns are passed over.  An empty
table gives an empty result.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch, lean, tasks

SHARD = 16384
NEIGHBOURS = 24
NEAR = 64
BEAM = 96
K = 10
#: Queries searched in step, and bytes of queries broadcast at once.
QUERY_BLOCK = 256
QUERY_BYTES = 32 << 20


def _nearest(x: np.ndarray, k: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its k nearest other rows (float32), nearest first, and their squared distances."""
    n, k = len(x), min(k, len(x) - 1)
    if k <= 0:
        return np.zeros((n, 0), np.int32), np.zeros((n, 0), np.float32)
    sq = (x * x).sum(axis=1)
    ids, dist = np.zeros((n, k), np.int32), np.zeros((n, k), np.float32)
    for a in range(0, n, block):
        d = sq[a : a + block, None] + sq[None, :] - 2 * (x[a : a + block] @ x.T)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        dn = np.take_along_axis(d, near, axis=1)
        order = np.argsort(dn, axis=1, kind="stable")
        ids[a : a + block], dist[a : a + block] = np.take_along_axis(near, order, axis=1), np.take_along_axis(dn, order, axis=1)
    return ids, dist


def _linked(x: np.ndarray, most: int) -> np.ndarray:
    """Flat neighbour array (n x most, -1 for none) of one level: diverse near nodes, then their reverse links."""
    n = len(x)
    out = np.full((n, most), -1, np.int32)
    ids, dist = _nearest(x, NEAR)
    if not ids.shape[1]:
        return out
    half, used = most * 2 // 3, np.zeros(n, np.int64)
    # A near node is taken if it is nearer to the node than to any one taken before it.
    taken = np.zeros(ids.shape, bool)
    for j in range(ids.shape[1]):
        c = ids[:, j]
        ok = used < half
        for i in range(j):
            rows = np.flatnonzero(ok & taken[:, i])
            if len(rows):
                gap = ((x[c[rows]] - x[ids[rows, i]]) ** 2).sum(axis=1)
                ok[rows[gap < dist[rows, j]]] = False
        taken[:, j] = ok
        used += ok
    taken[:, : min(4, ids.shape[1])] = True  # the very nearest always
    src, at = np.nonzero(taken)
    dst, d = ids[src, at], dist[src, at]
    # Forward links, then reverse ones, nearest first within each, as far as there is room.
    a, b, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([d, d])
    back = np.repeat([0, 1], len(src))
    order = np.lexsort((w, back, a))
    a, b = a[order], b[order]
    _, firsts = np.unique(a.astype(np.int64) * n + b, return_index=True)
    keep = np.zeros(len(a), bool)
    keep[firsts] = True
    a, b = a[keep], b[keep]
    begin = np.searchsorted(a, np.arange(n))
    place = np.arange(len(a)) - begin[a]
    room = place < most
    out[a[room], place[room]] = b[room]
    return out


def build(x: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """A graph over the rows of x (float32): level_i (node numbers) and links_i (flat neighbour arrays), i = 0 the lowest."""
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(rng.random(len(x)) + 1e-12) / np.log(NEIGHBOURS)).astype(int)
    out = {"x": x}
    for i in range(int(level.max(initial=0)) + 1):
        nodes = np.flatnonzero(level >= i).astype(np.int32)
        out[f"level_{i}"] = nodes
        out[f"links_{i}"] = _linked(x[nodes], NEIGHBOURS * (2 if i == 0 else 1))
    return out


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step: the nearest ``width`` nodes found for each (-1 for none) and squared distances."""
    m, n = len(q), len(x)
    seen = np.zeros((m, n), bool)
    ids = np.full((m, width), -1, np.int64)
    dist = np.full((m, width), np.inf, np.float32)
    open_ = np.zeros((m, width), bool)
    e = entry.shape[1]
    ids[:, :e], open_[:, :e] = entry, entry >= 0
    dist[:, :e] = np.where(entry >= 0, ((x[entry] - q[:, None, :]) ** 2).sum(axis=2), np.inf)
    np.put_along_axis(seen, np.maximum(entry, 0), True, axis=1)
    live = np.arange(m)
    while len(live):
        cost = np.where(open_[live], dist[live], np.inf)
        best = cost.argmin(axis=1)
        going = np.isfinite(cost[np.arange(len(live)), best])
        live, best = live[going], best[going]
        if not len(live):
            break
        at = ids[live, best]
        open_[live, best] = False
        near = links[at].astype(np.int64)
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        if not len(r):
            continue
        node = near[r, c]
        seen[live[r], node] = True
        d = ((x[node] - q[live[r]]) ** 2).sum(axis=1)
        new_d = np.full(near.shape, np.inf, np.float32)
        new_d[r, c] = d
        all_d = np.concatenate([dist[live], new_d], axis=1)
        all_i = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        all_o = np.concatenate([open_[live], fresh], axis=1)
        pick = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        ids[live], dist[live], open_[live] = (np.take_along_axis(z, pick, axis=1) for z in (all_i, all_d, all_o))
    return np.where(np.isfinite(dist), ids, -1), dist


def search(graph: dict[str, np.ndarray], q: np.ndarray, width: int = BEAM) -> np.ndarray:
    """For each query up to ``width`` near nodes (-1 for none)."""
    x = graph["x"]
    if len(x) <= width:
        return np.broadcast_to(np.arange(len(x)), (len(q), len(x)))
    top = max(int(k.split("_")[1]) for k in graph if k.startswith("level_"))
    entry = np.zeros((len(q), 1), np.int64)
    for i in range(top, 0, -1):
        nodes = graph[f"level_{i}"]
        start = np.searchsorted(nodes, entry)
        start = np.where(entry >= 0, start, -1)
        found, dist = _beam(x[nodes], graph[f"links_{i}"], q, np.minimum(start, len(nodes) - 1), min(8, max(2, len(nodes))))
        order = np.argsort(dist, axis=1, kind="stable")[:, :4]
        found = np.take_along_axis(found, order, axis=1)
        entry = np.where(found >= 0, nodes[np.maximum(found, 0)], -1)
        first = entry[:, :1]
        entry = np.where(entry >= 0, entry, first)
        if i > 1:
            entry = entry[:, :1]
    return _beam(x, graph["links_0"], q, _unique_rows(entry), width)[0]


def _unique_rows(entry: np.ndarray) -> np.ndarray:
    """Repeated entries of a row become -1."""
    out = np.sort(entry, axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def _index(table: pa.Table) -> pa.Table:
    """One shard's rows (dim, shard, vec, ids) -> its graph as one blob."""
    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    order = np.argsort(np.array([v[0] for v in table.column("ids").to_pylist()]), kind="stable")
    table = table.take(pa.array(order))
    x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64).reshape(-1, dim)
    ids = table.column("ids").to_pylist()
    exponent = int(np.frexp(np.abs(x).max())[1])
    graph = build(_scaled(x, exponent))
    cut = np.cumsum([0, *map(len, ids)])
    blob = _pack(graph | {"exact": x, "exponent": np.array(exponent), "cut": cut, "ids": np.array([i for g in ids for i in g], np.int64)})
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "graph": pa.array([blob], pa.binary())})


def _scaled(x: np.ndarray, exponent: int) -> np.ndarray:
    """x / 2**exponent in single precision: squares of components up to 1 can't overflow."""
    return np.ldexp(x, -exponent).astype(np.float32)


def _merged(qid: np.ndarray, vid: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best answers with different ids of each query; ties to smaller ids."""
    order = np.lexsort((score, vid, qid))
    qid, vid, score = qid[order], vid[order], score[order]
    fresh = np.ones(len(qid), bool)
    fresh[1:] = (qid[1:] != qid[:-1]) | (vid[1:] != vid[:-1])  # of rows that repeat an id the nearest
    qid, vid, score = qid[fresh], vid[fresh], score[fresh]
    order = np.lexsort((vid, score, qid))
    qid, vid, score = qid[order], vid[order], score[order]
    place = np.arange(len(qid)) - np.searchsorted(qid, qid)
    keep = place < k
    return qid[keep], vid[keep], score[keep]


def _answers(queries, width: int, k: int):
    """Graphs to their answers for a block of queries {dim: (ids, vectors)}, merged over the graphs a task reads."""

    def one(g: dict[str, np.ndarray], qid: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        exact, cut, ids, exponent = g.pop("exact"), g.pop("cut"), g.pop("ids"), int(g.pop("exponent"))
        count = np.minimum(np.diff(cut), k + 1)  # ids ascend: of equal vectors the smallest come first
        out = []
        # A query far beyond a shard's own range isn't told apart in single precision: it is held against every node.
        far = np.abs(q).max(axis=1) > np.ldexp(1.0, min(1023, exponent + 20))
        near = np.full((len(q), max(1, min(width, len(exact)))), -1, np.int64)
        if not far.all():
            near[~far] = search(g, _scaled(q[~far], exponent), width)
        for i in range(len(qid)):
            nodes = np.arange(len(exact)) if far[i] else np.unique(near[i][near[i] >= 0])
            s = np.sqrt(((exact[nodes] - q[i]) ** 2).sum(axis=1))
            lost = ~np.isfinite(s)
            if lost.any():  # squares beyond double precision
                s[lost] = [math.dist(exact[n], q[i]) for n in nodes[lost]]
            mine = np.concatenate([ids[cut[n] : cut[n] + count[n]] for n in nodes] or [np.zeros(0, np.int64)])
            score = np.repeat(s, count[nodes])
            other = mine != qid[i]
            out.append((np.full(int(other.sum()), qid[i]), mine[other], score[other]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for b in batches:
            for row in range(b.num_rows):
                dim = b.column(0)[row].as_py()
                if dim not in asked:
                    continue
                graph = dict(np.load(io.BytesIO(b.column(1)[row].as_py())))
                for at in range(0, len(asked[dim][0]), QUERY_BLOCK):
                    found = one(dict(graph), asked[dim][0][at : at + QUERY_BLOCK], asked[dim][1][at : at + QUERY_BLOCK])
                    best = [np.concatenate(c) for c in zip(best, _merged(*found, k))]
                best = list(_merged(*best, k))
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names=["query_id", "vec_id", "score"])

    return run


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vec: the components as little-endian doubles) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, dims, blobs = [], [], []
            for i, v in enumerate(b.column(1).to_pylist()):
                if not v or any(c is None for c in v):
                    continue
                x = np.array(v, "<f8")
                if np.isfinite(x).all() and x.any():
                    keep.append(i)
                    dims.append(len(x))
                    blobs.append((x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], names=["vec_id", "dim", "vec"])

    return vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), "vector").mapInArrow(lean(run), "vec_id long, dim int, vec binary")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, width: int = BEAM, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` (vec_id, vector) its k nearest found in ``vectors``, itself left out."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    ready = scratch.write(prepared(vectors), "vectors")
    # Of equal vectors the k + 1 smallest ids are enough to answer any query exactly; copies are met first by pairs (id, vector) in partial sums.
    nodes = ready.groupBy("dim", "vec").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = scratch.write(nodes, "nodes")
    single = nodes.where("copies = 1").select("dim", "vec", F.array("first").alias("ids"))
    many = nodes.where("copies > 1").select("dim", "vec")
    salted = ready.join(many, ["dim", "vec"], "left_semi").groupBy("dim", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    merged = salted.groupBy("dim", "vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    per_dim = {r["dim"]: max(1, -(-r["n"] // shard)) for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per_dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards_of = spark.createDataFrame(list(per_dim.items()), "dim int, shards int")
    dealt = single.union(merged).join(F.broadcast(shards_of), "dim").withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int"))
    graphs = dealt.select("dim", "shard", "vec", "ids").groupBy("dim", "shard").applyInArrow(_index, "dim int, shard int, graph binary")
    graphs = scratch.write(graphs, "graphs")
    # Of rows that repeat a query's id, the least vector asks.
    asked = prepared(queries).groupBy("vec_id").agg(F.min(F.struct("dim", "vec")).alias("v")).select("vec_id", "v.dim", "v.vec")
    asked = scratch.write(asked, "queries")
    n_bytes = asked.agg(F.sum(F.octet_length("vec") + 8)).first()[0] or 0
    blocks = -(-n_bytes // QUERY_BYTES)
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        shared = spark.sparkContext.broadcast(_by_dim(rows))
        one = graphs.select("dim", "graph").mapInArrow(lean(_answers(shared, width, k)), "query_id long, vec_id long, score double")
        one = scratch.write(one, "found")
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    least = found.repartition(tasks(spark), "query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return least.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_dim(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A block of queries (vec_id, dim, vec) by their length."""
    ids, dims, vecs = rows.column("vec_id").to_numpy(), rows.column("dim").to_numpy(), rows.column("vec").to_pylist()
    out = {}
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        out[dim] = (ids[at], np.frombuffer(b"".join([vecs[i] for i in at]), np.float64).reshape(len(at), dim))
    return out


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100."""
    vectors = _usable(spark, sf_dir)
    return neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))
