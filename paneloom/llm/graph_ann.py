"""Nearest neighbours by inner product over robust-pruned directed graphs, one graph a shard.

Vectors are dealt into shards by hash. In a shard points are inserted in batches: a greedy search over the graph so far
proposes neighbours, and relaxed distance pruning keeps only those that no kept neighbour is closer to by the factor
ALPHA; links back are added and pruned the same way. Queries, in blocks, search every shard with a beam; scores of what is
found are inner products of the original vectors in double precision.

Inner products are turned into distances by one more dimension that brings all vectors to the length of the longest.
Equal vectors are one point of the graph, which carries the smallest k + 1 of their ids: no further one can be among the
k nearest, so that nothing is lost however many rows share a vector.

Defined results: vectors that are NULL, zero, or hold NULL or non-finite components take no part, nor do rows without an
id; an id that occurs repeatedly has the smallest of its vectors; vectors are compared with those of their own length
only; equal scores go to the smaller id; fewer candidates than k give all of them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from paneloom.llm.common import stored

DEGREE, ALPHA = 32, 1.2
BUILD_BEAM, BEAM = 64, 96
SHARDS, SHARD_ROWS = 12, 50_000     # at least so many shards, and at most about so many vectors in one
QUERY_BLOCK = 2048
BATCH = 256                          # points inserted, or queries searched, at once


def beam_search(x, graph, start, queries, beam):
    """(ids, squared distances) of the `beam` nearest points found for each query, nearest first; -1 where there are
    fewer. All queries take a step at a time."""
    n, rows = len(queries), np.arange(len(queries))
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    ids[:, 0], dist[:, 0] = start, ((x[start] - queries) ** 2).sum(1)
    opened = np.zeros((n, beam), bool)
    met = np.zeros((n, len(x)), bool)
    met[:, start] = True
    while True:
        waiting = np.where(opened | (ids < 0), np.inf, dist)
        at = waiting.argmin(1)
        live = np.flatnonzero(np.isfinite(waiting[rows, at]))
        if not len(live):
            return ids, dist
        opened[live, at[live]] = True
        near = graph[ids[live, at[live]]]
        new = (near >= 0) & ~met[live[:, None], near]
        r, c = np.nonzero(new)
        met[live[r], near[r, c]] = True
        d = np.full(near.shape, np.inf, np.float32)
        gap = x[near[r, c]] - queries[live[r]]
        d[r, c] = np.einsum("ij,ij->i", gap, gap)
        all_d = np.concatenate([dist[live], d], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(new, near, -1)], axis=1), best, 1)
        dist[live] = np.take_along_axis(all_d, best, 1)
        opened[live] = np.take_along_axis(np.concatenate([opened[live], np.zeros(near.shape, bool)], axis=1), best, 1)


def robust_prune(x, points, found, degree=DEGREE, alpha=ALPHA):
    """For each point the neighbours kept among those found (-1: none): the nearest one is kept and drops all that are
    alpha times closer to it than to the point, and so on."""
    n = len(points)
    found = np.sort(np.where(found == points[:, None], -1, found), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    vectors = x[found]
    dist = ((vectors - x[points][:, None]) ** 2).sum(2)
    dist[found < 0] = np.inf
    out, rows = np.full((n, degree), -1, np.int64), np.arange(n)
    alive = dist.copy()
    for k in range(degree):
        at = alive.argmin(1)
        ok = np.isfinite(alive[rows, at])
        if not ok.any():
            break
        out[ok, k] = found[rows, at][ok]
        gap = vectors - vectors[rows, at][:, None]
        drop = alpha * alpha * np.einsum("ijk,ijk->ij", gap, gap) <= dist
        alive[drop & ok[:, None]] = np.inf
        alive[rows, at] = np.inf
    return out


def build(x, seed=3):
    """(graph, start point) over the rows of x."""
    n = len(x)
    graph = np.full((n, DEGREE), -1, np.int64)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != start]
    done = 0
    while done < len(order):
        p = order[done:done + min(BATCH, max(1, done))]
        done += len(p)
        found, _ = beam_search(x, graph, start, x[p], min(BUILD_BEAM, n))
        # points inserted together may be neighbours of each other as well
        found = np.concatenate([found, np.broadcast_to(p, (len(p), len(p)))], axis=1) if len(p) <= 32 else found
        graph[p] = robust_prune(x, p, found)
        a, b = np.repeat(p, DEGREE), graph[p].ravel()
        a, b = a[b >= 0], b[b >= 0]
        by = np.argsort(b, kind="stable")
        a, b = a[by], b[by]
        to, first, count = np.unique(b, return_index=True, return_counts=True)
        # points with many links back go together, so that tables stay narrow
        for few, many in ((0, 8), (8, 64), (64, 1 << 30)):
            some = np.flatnonzero((count > few) & (count <= many))
            for i in range(0, len(some), 512):
                s = some[i:i + 512]
                col = np.arange(count[s].max())
                back = np.where(col < count[s][:, None], a[np.minimum(first[s][:, None] + col, len(a) - 1)], -1)
                old = graph[to[s]]
                both = np.concatenate([old, back], axis=1)
                room = (both >= 0).sum(1) <= DEGREE
                if room.any():
                    # all fit: no pruning, only closing up and dropping repeats
                    b2 = np.sort(both[room], axis=1)
                    b2[:, 1:][b2[:, 1:] == b2[:, :-1]] = -1
                    graph[to[s][room]] = -np.sort(-b2, axis=1)[:, :DEGREE]
                if not room.all():
                    graph[to[s][~room]] = robust_prune(x, to[s][~room], both[~room])
    return graph, start


def usable(vectors: DataFrame, id_col, vector_col) -> DataFrame:
    """(vec_id, v): one vector for each id, of those that take part."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return (vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def build_graphs(points: DataFrame, longest: float) -> DataFrame:
    """A row for each shard: its vectors, ids and graph. `points` has shard, v and ids."""
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x = matrix(t.column("v"))
        order = np.lexsort(x.T[::-1])
        x, t = x[order], t.take(pa.array(order))
        wide = np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None]], axis=1).astype(np.float32)
        graph, start = build(wide)
        ids = t.column("ids").to_pylist()
        return pa.table({"shard": t.column("shard").slice(0, 1), "dims": pa.array([x.shape[1]], pa.int32()), "start": pa.array([start], pa.int64()),
                         "vectors": pa.array([x.tobytes()], pa.binary()), "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary()),
                         "counts": pa.array([[len(i) for i in ids]], pa.list_(pa.int32())), "ids": pa.array([[j for i in ids for j in i]], pa.list_(pa.int64()))})

    return points.groupBy("shard").applyInArrow(run, "shard long, dims int, start long, vectors binary, graph binary, counts array<int>, ids array<long>")


def search(queries: pa.Table, shard: dict, longest: float, k: int, beam: int):
    """(query_id, vec_id, score) arrays: the k best of this shard for each query, itself left out."""
    x = np.frombuffer(shard["vectors"]).reshape(-1, shard["dims"])
    graph = np.frombuffer(shard["graph"], np.int32).reshape(len(x), -1).astype(np.int64)
    wide = np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None]], axis=1).astype(np.float32)
    ends = np.cumsum(shard["counts"])
    ids, starts = np.array(shard["ids"]), ends - np.array(shard["counts"])
    q, own = matrix(queries.column("v")), queries.column("query_id").to_numpy()
    # a query as long as the vectors searches best; its length does not change the order
    scale = np.sqrt(longest / np.maximum((q * q).sum(1), 1e-300))
    out = []
    for i in range(0, len(q), BATCH):
        part = q[i:i + BATCH]
        probe = np.concatenate([part * scale[i:i + BATCH, None], np.zeros((len(part), 1))], axis=1).astype(np.float32)
        found, _ = beam_search(wide, graph, shard["start"], probe, min(max(beam, k + 1), len(x)))
        score = (x[found] * part[:, None]).sum(2)
        score[found < 0] = -np.inf
        for r in range(len(part)):
            best = np.argsort(-score[r], kind="stable")
            # as many points as may hold the k best rows, those of equal score together
            f = found[r][best]
            f, s = f[f >= 0], score[r][best][:(f >= 0).sum()]
            if len(s) > k + 1:
                keep = s >= s[k]
                f, s = f[keep], s[keep]
            rows = np.concatenate([ids[starts[j]:ends[j]] for j in f])
            value = np.repeat(s, np.array(shard["counts"])[f])
            other = rows != own[i + r]
            rows, value = rows[other], value[other]
            top = np.lexsort((rows, -value))[:k]
            out.append((np.full(len(top), own[i + r]), rows[top], value[top]))
    return [np.concatenate(c) for c in zip(*out)]


def nearest(vectors: DataFrame, queries: DataFrame, k=20, id_col="vec_id", vector_col="embedding", beam=BEAM, shards=SHARDS, shard_rows=SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `vectors` found nearest to each row of `queries`, its own id left out."""
    points = usable(vectors, id_col, vector_col)
    smallest = points.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    points = stored(smallest.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    squared = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    n, longest = points.agg(F.count("*"), F.max(squared)).first()
    count = max(shards, -(-n // shard_rows))
    # vectors of different length never share a shard
    shard = F.size("v") * F.lit(count).cast("long") + F.pmod(F.xxhash64("v"), F.lit(count))
    graphs = stored(build_graphs(points.select(shard.alias("shard"), "v", "ids"), longest or 0.0))
    asked = usable(queries, id_col, vector_col).withColumnRenamed("vec_id", "query_id")
    asked = stored(asked)
    blocks = 1 + asked.count() // QUERY_BLOCK
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    each = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))).withColumn("shard", F.size("v") * F.lit(count).cast("long") + F.col("shard"))
    copies = graphs.withColumnRenamed("shard", "of").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(queries: pa.Table, graph: pa.Table) -> pa.Table:
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not queries.num_rows or not graph.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(kinds.items(), search(queries.combine_chunks(), graph.to_pylist()[0], longest, k, beam))})

    found = each.groupBy("shard", "block").cogroup(copies.groupBy("of", "part")).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
