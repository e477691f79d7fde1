"""Exact top-k inner-product search: a KD-tree per shard, best-first traversal, the k-th score handed on.

Rows are dealt to shards by the hash of their id; each shard is one KD-tree (median splits on the widest side, tight
bounding boxes). A query is first searched in the shard that holds it. Its k-th best score there goes with it to all
other trees, where whole boxes that cannot reach it are passed over, and rises from tree to tree. Trees and queries
meet in groups of bounded size: every group of trees with every group of queries, each pair of groups in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

#: Rows of a shard at most (on average), rows of a leaf, trees of a group, queries of a group.
SHARD, LEAF, TREES, QUERIES = 4096, 32, 32, 16_384
#: So many shards at least, if each then has 128 rows.
LEAST = 64
LONG = 1 << 63


def quantised(column: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for vectors that are null or hold null or non-finite components."""
    usable = F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(usable, F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


class Tree:
    """KD-tree over integer points. Node i has the children 2i+1 and 2i+2; leaves are ranges of the ordered points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.order = np.arange(len(ids))
        depth = max(0, int(np.ceil(np.log2(max(len(ids), 1) / LEAF))))
        self.size, self.first_leaf = 2 ** (depth + 1) - 1, 2**depth - 1
        self.low = np.zeros((self.size, points.shape[1]), np.int64)
        self.high = self.low.copy()
        self.spans = np.zeros((self.size, 2), np.int64)
        self._build(points, 0, 0, len(ids))
        self.ids, self.points = ids[self.order], points[self.order]

    def _build(self, points: np.ndarray, node: int, start: int, end: int) -> None:
        own = points[self.order[start:end]]
        self.low[node], self.high[node], self.spans[node] = own.min(0), own.max(0), (start, end)
        if node < self.first_leaf:
            side = int(np.argmax(self.high[node] - self.low[node]))
            middle = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(own[:, side], middle)]
            self._build(points, 2 * node + 1, start, start + middle)
            self._build(points, 2 * node + 2, start + middle, end)

    def search(self, queries: np.ndarray, best: list[list[tuple[int, int]]], own: np.ndarray, floors: np.ndarray, k: int) -> None:
        """Improve `best`, for each query a heap of its k best (score, -id); `floors` are scores known to be reached."""
        # the largest inner product that any point of a box can have
        bounds = product(np.maximum(queries, 0), self.high) + product(np.minimum(queries, 0), self.low)
        kinds = exact_kind(queries, self.points)
        points = self.points.astype(kinds)
        for q in range(len(queries)):
            heap, reach, query = best[q], bounds[q], queries[q].astype(kinds)
            least = max(floors[q], heap[0][0]) if len(heap) == k else floors[q]
            todo = [(-reach[0], 0)]
            while todo and -todo[0][0] >= least:
                node = heapq.heappop(todo)[1]
                if node < self.first_leaf:
                    for child in (2 * node + 1, 2 * node + 2):
                        if reach[child] >= least:
                            heapq.heappush(todo, (-reach[child], child))
                    continue
                start, end = self.spans[node]
                scores = points[start:end] @ query
                for i in np.flatnonzero(scores >= least):
                    item = (int(scores[i]), -int(self.ids[start + i]))
                    if -item[1] == own[q]:
                        continue
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
                if len(heap) == k:
                    least = max(floors[q], heap[0][0])


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest number type in which inner products of rows of a and b, and their parts, are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    kind = exact_kind(a, b)
    return a.astype(kind) @ b.astype(kind).T


def vectors(blobs: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64).reshape(len(blobs), dim)


def top_k(rows: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """For each query row its k highest scores among all other rows: query_id, rank (from 1), vec_id, score.

    Scores are inner products of floor(scale * x); ties go to the smaller id; a query with fewer than k other rows gets
    them all. A row's own id is no candidate. Rows with a null id, and vectors that are null or hold null or non-finite
    components, take no part; shorter vectors count as padded with zeros; rows that repeat id and vector count once.
    Scores beyond 64 bits are cut to the range of a long. Other columns are not read.
    """
    spark = rows.sparkSession
    usable = rows.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("v"), is_query.alias("query")).filter("id is not null and v is not null")
    n, queries, dim = usable.agg(F.count("*"), F.count_if("query"), F.max(F.size("v"))).first()
    if not queries:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    shards = max(-(-n // SHARD), min(LEAST, -(-n // 128)))
    groups = max(-(-shards // TREES), min(shards, 2 * spark.sparkContext.defaultParallelism))
    chunks = -(-queries // QUERIES)
    own = usable.dropDuplicates(["id", "v"]).withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))

    def build(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("id", kind="stable")
        points = np.zeros((len(shard), dim), np.int64)
        for i, v in enumerate(shard["v"]):
            points[i, : len(v)] = v
        ids = shard["id"].to_numpy()
        at = np.flatnonzero(shard["query"].to_numpy(bool))
        best: list[list] = [[] for _ in at]
        Tree(ids, points).search(points[at], best, ids[at], np.full(len(at), -np.inf), k)
        kth = [h[0][0] if len(h) == k else None for h in best]
        tree = {"shard": key[0], "id": None, "ids": ids.tobytes(), "vectors": points.tobytes(), "floor": None}
        found = [{"shard": key[0], "id": int(ids[a]), "ids": None, "vectors": points[a].tobytes(), "floor": None if f is None else str(f)} for a, f in zip(at, kth, strict=True)]
        return pd.DataFrame([tree, *found], columns=["shard", "id", "ids", "vectors", "floor"])

    built = stored(own.groupBy("shard").applyInPandas(build, "shard int, id bigint, ids binary, vectors binary, floor string"))
    trees = built.filter("ids is not null").select(F.pmod("shard", F.lit(groups)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"), "ids", "vectors")
    asked = built.filter("ids is null").select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("id", "vectors"), F.lit(chunks)).cast("int").alias("c"), "id", "vectors", "floor")

    def search(trees_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        if not len(trees_) or not len(asked_):
            return pd.DataFrame({"query_id": [], "q": [], "vec_id": [], "score": []})
        q, ids = vectors(asked_["vectors"], dim), asked_["id"].to_numpy()
        floors = np.array([-np.inf if f is None else int(f) for f in asked_["floor"]], object)
        best: list[list] = [[] for _ in ids]
        for t in trees_.itertuples():
            Tree(np.frombuffer(t.ids, np.int64), np.frombuffer(t.vectors, np.int64).reshape(-1, dim)).search(q, best, ids, floors, k)
        found = [(i, v, -n_, max(-LONG, min(LONG - 1, s))) for i, v, heap in zip(ids, asked_["vectors"], best, strict=True) for s, n_ in heap]
        return pd.DataFrame(found, columns=["query_id", "q", "vec_id", "score"])

    hits = trees.groupBy("g", "c").cogroup(asked.groupBy("g", "c")).applyInPandas(search, "query_id bigint, q binary, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
