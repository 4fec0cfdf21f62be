"""Approximate nearest neighbours over learned partitions (operator 4).

  1. A sample of at most SAMPLE vectors (those with the smallest hash of the id) gets a nearest-neighbour graph.
  2. The graph is cut into balanced parts by recursive bisection: the second eigenvector of the walk on the graph,
     split at its median, then pairs are swapped while that removes cut edges.
  3. A small classifier (one hidden layer) learns the part from the vector.
  4. Every vector of the table goes to its most probable part; a query goes to its most probable parts, as many as hold
     RECALL of the sample's true neighbours.
  5. Parts are split into blocks of about BLOCK vectors by a hash of the id, so a part of any size (a third of all
     vectors may be equal) is many tasks.  A block ranks its vectors for its queries by exact double distances.
     A query that found too few vectors is searched again in every part.

The method is the same at every size; tables of fewer than two parts of LEAST vectors are one part.  What is fitted and broadcast is
bounded by SAMPLE and PARTS.  Cases: rows with a null id, and vectors that are null, zero, of another length than the
most frequent one, or that hold null or non-finite components take no part; rows that share an id are distinct
candidates, but none of them answers a query of that id; ties go to the smaller id; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

SAMPLE, PARTS, BLOCK, GRAPH_K, HIDDEN, RECALL = 4096, 64, 4096, 10, 64, 0.96
#: Vectors of the sample that a part holds at least: fewer cannot be told apart.
LEAST = 8


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fine = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    fine = stage(fine, "vectors")
    sizes = fine.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    return fine.where(F.size("v") == (most["d"] if most else 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the product form: good for choosing, not for reporting."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """The k nearest others of each row."""
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    return np.argpartition(d, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]


def bisect(nodes: np.ndarray, near: np.ndarray, rng: np.random.Generator, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of nodes with few graph edges between them."""
    place = np.full(len(near), -1)
    place[nodes] = np.arange(len(nodes))
    to = place[near[nodes]]
    a, b = np.repeat(np.arange(len(nodes)), to.shape[1])[to.reshape(-1) >= 0], to.reshape(-1)[to.reshape(-1) >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(a, minlength=len(nodes)) + 1.0
    y = rng.standard_normal(len(nodes))
    for _ in range(rounds):  # the walk's second eigenvector: the constant one is taken out each time
        y = y - (degree * y).sum() / degree.sum()
        y = 0.5 * y + 0.5 * (np.bincount(a, y[b], len(nodes)) + y) / degree
        y /= np.abs(y).max() + 1e-300
    side = np.zeros(len(nodes), bool)
    side[np.argsort(y, kind="stable")[len(nodes) // 2 :]] = True
    for _ in range(20):
        across = np.bincount(a, (side[a] != side[b]).astype(float), len(nodes))
        gain = 2 * across - (degree - 1)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right), max(1, len(nodes) // 50))
        swap = gain[left[:n]] + gain[right[:n]] > 2  # an edge between the two counts against them
        if not swap.any():
            break
        cut = across.sum()
        side[left[:n][swap]], side[right[:n][swap]] = True, False
        if np.count_nonzero(side[a] != side[b]) >= cut:
            side[left[:n][swap]], side[right[:n][swap]] = False, True
            break
    return nodes[~side], nodes[side]


def partition(near: np.ndarray, parts: int) -> np.ndarray:
    """A part for each node: parts differ by at most one node for each level of bisection."""
    rng, todo = np.random.default_rng(7), [np.arange(len(near))]
    while len(todo) < parts:
        todo.sort(key=len)
        todo += bisect(todo.pop(), near, rng)
    out = np.zeros(len(near), np.int64)
    for k, nodes in enumerate(todo):
        out[nodes] = k
    return out


class Router:
    """A classifier with one hidden layer; probabilities of the parts."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, epochs: int = 60):
        rng, n, d = np.random.default_rng(11), len(x), x.shape[1]
        self.mean, self.scale = x.mean(0), x.std() + 1e-12
        self.w = [rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        z = (x - self.mean) / self.scale
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in np.array_split(order, max(1, n // 128)):
                h = np.maximum(z[at] @ self.w[0] + self.w[1], 0)
                p = self._soft(h @ self.w[2] + self.w[3])
                p[np.arange(len(at)), part[at]] -= 1
                p /= len(at)
                g = (p @ self.w[2].T) * (h > 0)
                t += 1
                for k, grad in enumerate((z[at].T @ g, g.sum(0), h.T @ p, p.sum(0))):
                    grad = grad + 1e-4 * self.w[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                    self.w[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _soft(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._soft(np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def fit(x: np.ndarray, parts: int) -> tuple[Router | None, int]:
    """The router, and how many parts a query needs: chosen on a fifth of the sample that the router has not seen."""
    if parts <= 1:
        return None, 1
    near = neighbour_graph(x)
    part = partition(near, parts)
    unseen = np.arange(len(x)) % 5 == 4
    router = Router(x[~unseen], part[~unseen], parts)
    p = router(x)
    own, order = p.argmax(1), np.argsort(-p[unseen], axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    # rank, among the query's parts, of the part that holds each true neighbour
    at = np.sort(np.take_along_axis(rank, own[near[unseen]], axis=1).reshape(-1))
    return router, int(at[min(len(at) - 1, int(np.ceil(RECALL * len(at))) - 1)]) + 1


def _array(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("v")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def routed(rows: DataFrame, model, top: int) -> DataFrame:
    """(vec_id, part, v): each row with its `top` most probable parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best = np.argsort(-model.value(_array(batch)), axis=1, kind="stable")[:, :top] if model.value else np.zeros((batch.num_rows, 1), np.int64)
                take = pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), pa.array(best.reshape(-1).astype(np.int32)), batch.column("v").take(take)], ["vec_id", "part", "v"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, part int, v array<double>")


def ranked(cells: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): within each cell the k nearest candidates of each query, by exact distances.

    A cell's candidates (a block) come first and are held; its queries, however many, pass by.
    """

    def settle(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(q), 256):
            found = []
            for query, y, dist in zip(asked[i : i + 256], q[i : i + 256], distances(q[i : i + 256], x)):
                dist[ids == query] = np.inf
                n = min(k, int(np.isfinite(dist).sum()))
                if n:
                    edge = np.partition(dist, n - 1)[n - 1]
                    some = np.flatnonzero(dist <= edge + 1e-9 * (1 + edge + (y * y).sum()))
                    score = np.sqrt(((x[some] - y) ** 2).sum(1))
                    best = np.lexsort((ids[some], score))[:n]
                    found.append((np.full(n, query), ids[some[best]], score[best]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "vec_id", "score"])

    def run(batches):
        now, ids, x = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            part, block, vec, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "block", "vec_id", "query"))
            v = _array(batch)
            edges = np.flatnonzero((part[1:] != part[:-1]) | (block[1:] != block[:-1]) | (query[1:] != query[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]):
                if now != (part[a], block[a]):
                    now, ids, x = (part[a], block[a]), [], []
                if not query[a]:
                    ids.append(vec[a:b])
                    x.append(v[a:b])
                elif ids:
                    if len(ids) > 1:
                        ids, x = [np.concatenate(ids)], [np.concatenate(x)]
                    yield from settle(ids[0], x[0], vec[a:b], v[a:b])

    return cells.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k nearest other rows found."""
    spark = vectors.sparkSession
    all_ = usable(vectors)
    n = all_.count()
    # a power of the table's size, so that parts and their sizes grow together; bounded by what the sample can tell apart
    parts = max(1, min(PARTS, min(n, SAMPLE) // LEAST, 1 << max(3, round(math.log2(max(n, 1)) / 2.5))))
    sample = [r["v"] for r in all_.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()] if parts > 1 else []
    router, probes = fit(np.array(sample), parts)
    model = spark.sparkContext.broadcast(router)
    index = stage(routed(all_, model, 1), "index")
    # PARTS rows at most
    blocks = F.broadcast(index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    candidates = index.join(blocks, "part").select("part", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", F.lit(False).alias("query"), "v")

    def search(queries: DataFrame, top: int) -> DataFrame:
        asked = routed(queries, model, top).join(blocks, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", F.lit(True).alias("query"), "v")
        dealt = candidates.unionByName(asked).repartition("part", "block").sortWithinPartitions("part", "block", "query")
        w = W.partitionBy("query_id").orderBy("score", "vec_id")
        return ranked(dealt, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    queries = all_.where(is_query)
    found = stage(search(queries, probes), "found")
    if probes < parts:
        full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
        short = stage(queries.join(full, "vec_id", "left_anti"), "short")
        if not short.isEmpty():
            found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(search(short, parts))
    return found.select("query_id", "rank", "vec_id", "score")
