"""Hard-negative mining with anchor spanning-tree bounds.

Anchors are dealt to chunks; in each chunk a minimum spanning tree joins anchors that are near each other. Candidates are
dealt to shards around the same pivots. Over a shard the tree is walked from its root, whose scores are computed. For a
child a = p + e of an anchor p and a candidate x = c + y, with c the shard's centre, the score is <p,x> + <e,c> + <e,y>,
and the last term lies within plus or minus |e||y|: the edge's length times the candidate's norm about the centre. Only
candidates whose interval overlaps the anchor's window are scored again; the others hand their interval on down the tree.

Two walks are made: the first finds each anchor's positives (window: the k-th best of the same label so far and above),
the second the negatives (windows: fixed shares of each positive's score, closed from below by the k-th found).
Chunks and shards meet in groups of bounded size, one task for each pair of groups; the results of tasks are ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored
from .topk import exact_kind, quantised, vectors

#: Anchors of a chunk and candidates of a shard (on average, at most), shards of a group, pivots.
CHUNK, SHARD, SHARDS, PIVOTS = 4096, 4096, 32, 64
LONG = 1 << 63


@dataclass(frozen=True)
class Settings:
    """The first `positives` rows of the anchor's label; for each, the first `negatives` rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score. Scores are inner products of floor(scale * x)."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256


def spanning(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum spanning tree of the points (Prim): each one's parent (-1 for the root), and a walk on which parents come first."""
    n, near = len(points), points.astype(np.float64)
    square = (near**2).sum(1)
    parent, away, out = np.full(n, -1), np.full(n, np.inf), np.ones(n, bool)
    walk = [0]
    for _ in range(n - 1):
        at = walk[-1]
        out[at] = False
        d = square + square[at] - 2 * (near @ near[at])
        closer = out & (d < away)
        away[closer], parent[closer] = d[closer], at
        walk.append(int(np.argmin(np.where(out, away, np.inf))))
    return parent, np.array(walk)


class AnchorTree:
    """Anchors and their spanning tree: `step` is the vector from a parent to its child, `edge` its length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, parent: np.ndarray, walk: np.ndarray):
        self.ids, self.labels, self.points, self.parent, self.walk = ids, labels, points, parent.tolist(), walk.tolist()
        self.children = np.bincount(parent[parent >= 0], minlength=len(ids)).tolist()
        near = points.astype(np.float64)
        self.step = near - near[np.maximum(parent, 0)]
        self.edge = np.sqrt((self.step**2).sum(1))


@dataclass
class Shard:
    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray


def overlapping(tree: AnchorTree, shard: Shard, allowed: Callable[[int], np.ndarray], window: Callable[[int], tuple[float, float]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, candidates, their exact scores) of the allowed candidates whose bounds overlap the anchor's window.

    `window` is asked anew for every anchor, so what was found before closes it further.
    """
    kind = exact_kind(tree.points, shard.points)
    anchors, points, near = tree.points.astype(kind), shard.points.astype(kind), shard.points.astype(np.float64)
    centre = near.mean(0)
    spread = np.sqrt(((near - centre) ** 2).sum(1))
    shift = tree.step @ centre
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    waiting = list(tree.children)
    for a in tree.walk:
        p = tree.parent[a]
        least, most = window(a)
        if p < 0:
            at = np.flatnonzero(allowed(a))
            scores = points @ anchors[a]
            low = high = scores.astype(np.float64)
            found = scores[at]
        else:
            low, high = bounds[p]
            reach = tree.edge[a] * spread
            reach += 1e-9 * (reach + np.abs(low) + np.abs(high) + abs(shift[a])) + 1e-6  # rounding
            low, high = low + (shift[a] - reach), high + (shift[a] + reach)
            at = np.flatnonzero(allowed(a) & (high >= least) & (low <= most))
            if 2 * len(at) > len(points):  # one product over the whole shard is cheaper, and tightens all bounds
                scores = points @ anchors[a]
                low = high = scores.astype(np.float64)
                found = scores[at]
            elif len(at):
                found = points[at] @ anchors[a]
                low[at] = high[at] = found
            else:
                found = np.zeros(0, kind)
            waiting[p] -= 1
            if not waiting[p]:
                del bounds[p]
        if tree.children[a]:
            bounds[a] = low, high
        yield a, at, found


class Best:
    """The k first (score downwards, id upwards) of what was offered."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.least = k, np.zeros(0), np.zeros(0, np.int64), -np.inf

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.least
        if not keep.any():
            return
        scores, ids = scores[keep], ids[keep]
        if len(scores) > 4 * self.k and scores.dtype != object:
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[keep], ids[keep]
        if len(self.scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k] if scores.dtype == object else np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]
        if len(self.ids) == self.k:
            self.least = self.scores[-1]


def find_positives(tree: AnchorTree, shards: list[Shard], k: int) -> list[Best]:
    """For each anchor the k first rows of its label, other than of its own id."""
    best = [Best(k) for _ in tree.ids]
    for shard in shards:
        for a, at, scores in overlapping(tree, shard, lambda a: (shard.labels == tree.labels[a]) & (shard.ids != tree.ids[a]), lambda a: (best[a].least, np.inf)):
            best[a].offer(scores, shard.ids[at])
    return best


def find_negatives(tree: AnchorTree, shards: list[Shard], windows: list[list[tuple[int, int]]], k: int) -> list[list[Best]]:
    """For each window (lowest, highest score) of each anchor the k first rows of other labels in it."""
    best = [[Best(k) for _ in own] for own in windows]

    def window(a: int) -> tuple[float, float]:
        open_ = [(max(lo, b.least), hi) for (lo, hi), b in zip(windows[a], best[a]) if lo <= hi]
        return min((lo for lo, _ in open_), default=np.inf), max((hi for _, hi in open_), default=-np.inf)

    for shard in shards:
        for a, at, scores in overlapping(tree, shard, lambda a: shard.labels != tree.labels[a], window):
            for (lo, hi), b in zip(windows[a], best[a], strict=True):
                inside = (scores >= max(lo, b.least)) & (scores <= hi)
                b.offer(scores[inside], shard.ids[at[inside]])
    return best


def mine(rows: DataFrame, is_anchor: Column, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null id or label, and vectors that are null or hold null or non-finite components, take no part;
    shorter vectors count as padded with zeros; rows that repeat id, label and vector count once. An anchor's positives
    are other rows (of another id) of its label; ties go to the smaller id; fewer rows than asked for give what there
    is. An anchor without positives, or a positive without rows in its window, gives no rows. Scores beyond 64 bits are
    cut to the range of a long. Other columns are not read; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantised(vector_col, s.scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    usable = usable.filter("id is not null and label is not null and v is not null")
    n, anchors, dim = usable.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("v"))).first()
    if not anchors:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    dim = max(dim, 1)
    placed = _placed(usable, n, anchors, dim)
    trees, shards = _trees(placed, dim), _shards(placed, dim)
    chunks, pieces = trees.count(), shards.count()
    groups = max(-(-pieces // SHARDS), min(pieces, 2 * spark.sparkContext.defaultParallelism))
    shards = shards.select(F.pmod("part", F.lit(groups)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "ids", "labels", "vectors")
    over = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")

    def opened(rows_: pd.DataFrame) -> list[Shard]:
        return [Shard(np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64), np.frombuffer(r.vectors, np.int64).reshape(-1, dim)) for r in rows_.itertuples()]

    def tree_of(row) -> AnchorTree:
        ids, labels, points, parent, walk = (np.frombuffer(x, np.int64) for x in (row.ids, row.labels, row.vectors, row.parents, row.walk))
        return AnchorTree(ids, labels, points.reshape(-1, dim), parent, walk)

    def positives(trees_: pd.DataFrame, shards_: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in trees_.itertuples() if len(shards_) else ():
            best = find_positives(tree_of(row), opened(shards_), s.positives)
            found += [(row.chunk, a, int(i), _long(x)) for a, b in enumerate(best) for x, i in zip(b.scores, b.ids)]
        return pd.DataFrame(found, columns=["chunk", "a", "id", "score"])

    def negatives(trees_: pd.DataFrame, shards_: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in trees_.itertuples() if len(shards_) else ():
            tree = tree_of(row)
            own: list[list] = [[] for _ in tree.ids]
            for p in row.positives:
                own[p["a"]].append((p["place"], p["id"], p["score"]))
            windows = [[(-(-s.low * x // 100), s.high * x // 100) for *_, x in o] for o in own]
            best = find_negatives(tree, opened(shards_), windows, s.negatives)
            found += [(row.chunk, a, place, int(tree.ids[a]), i, x, int(j), _long(y)) for a in range(len(own)) for (place, i, x), b in zip(own[a], best[a]) for y, j in zip(b.scores, b.ids)]
        return pd.DataFrame(found, columns=["chunk", "a", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    def met(trees_: DataFrame) -> object:
        return trees_.groupBy("chunk", "g").cogroup(shards.groupBy("chunk", "g"))

    first = met(trees.select("*", over)).applyInPandas(positives, "chunk int, a int, id bigint, score bigint")
    place = F.row_number().over(W.partitionBy("chunk", "a").orderBy(F.desc("score"), "id"))
    ranked = stored(first.withColumn("place", place).filter(F.col("place") <= s.positives))
    # at most `positives` rows for each of a chunk's anchors
    windowed = trees.join(ranked.groupBy("chunk").agg(F.collect_list(F.struct("a", "place", "id", "score")).alias("positives")), "chunk")
    columns = "chunk int, a int, place int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    second = met(windowed.select("*", over)).applyInPandas(negatives, columns)
    rank = F.row_number().over(W.partitionBy("chunk", "a", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return second.withColumn("rank", rank).filter(F.col("rank") <= s.negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _long(x) -> int:
    return max(-LONG, min(LONG - 1, int(x)))


def _placed(usable: DataFrame, n: int, anchors: int, dim: int) -> DataFrame:
    """(id, label, vector, anchor, part): every row in a shard (anchor false), anchors once more in a chunk (anchor true).

    Rows go to the nearest of a few pivot anchors; what a pivot draws is split by hash into parts of bounded size, so a
    pivot that draws most of the rows makes many parts. Anchors of pivots that draw few share a chunk.
    """
    pivots = [r.v for r in usable.filter("anchor").select("v").orderBy(F.xxhash64("id", "v")).limit(PIVOTS if anchors > CHUNK or n > SHARD else 1).collect()]
    at = np.zeros((len(pivots), dim))
    for i, v in enumerate(pivots):
        at[i, : len(v)] = v

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            points = np.zeros((len(b), dim), np.int64)
            for i, v in enumerate(b["v"]):
                points[i, : len(v)] = v
            cell = np.argmin((at**2).sum(1) - 2 * (points.astype(np.float64) @ at.T), axis=1)
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "anchor": b["anchor"], "vector": [p.tobytes() for p in points], "cell": cell.astype(np.int32)})

    celled = stored(usable.dropDuplicates(["id", "label", "v"]).select("id", "label", "anchor", "v").mapInPandas(place, "id bigint, label bigint, anchor boolean, vector binary, cell int"))
    roles = celled.withColumn("anchor", F.explode(F.when(F.col("anchor"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    counts = sorted((r.anchor, r.cell, r["count"]) for r in roles.groupBy("anchor", "cell").count().collect())  # two rows for a pivot
    parts, after, room = {}, {False: 0, True: 0}, 0
    for anchor, cell, n_ in counts:
        if anchor and n_ <= room:  # small cells share a chunk: every chunk meets every shard
            parts[anchor, cell], room = (after[anchor] - 1, 1), room - n_
            continue
        many = -(-n_ // (CHUNK if anchor else SHARD))
        parts[anchor, cell] = after[anchor], many
        after[anchor] += many
        room = CHUNK - n_ if anchor and many == 1 else 0  # the last shard has no room for anchors
    table = F.create_map(*[F.lit(x) for (anchor, cell), v in parts.items() for x in (f"{anchor} {cell}".lower(), list(v))])
    own = table[F.concat_ws(" ", F.col("anchor").cast("string"), F.col("cell").cast("string"))]
    return roles.select("id", "label", "vector", "anchor", (own[0] + F.pmod(F.xxhash64("id", "label", "vector"), own[1])).cast("int").alias("part"))


def _trees(placed: DataFrame, dim: int) -> DataFrame:
    """One row per chunk: its anchors, and their spanning tree as parents and a walk. Chunks are numbered from 0."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "label", "vector"], kind="stable")
        points = vectors(rows["vector"], dim)
        parts = (rows["id"].to_numpy(), rows["label"].to_numpy(), points, *spanning(points))
        return pd.DataFrame([(key[0], *[np.asarray(x, np.int64).tobytes() for x in parts])], columns=["chunk", "ids", "labels", "vectors", "parents", "walk"])

    built = placed.filter("anchor").select("id", "label", "vector", "part").groupBy("part").applyInPandas(build, "chunk int, ids binary, labels binary, vectors binary, parents binary, walk binary")
    return stored(built)


def _shards(placed: DataFrame, dim: int) -> DataFrame:
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "label", "vector"], kind="stable")
        return pd.DataFrame([(key[0], rows["id"].to_numpy().tobytes(), rows["label"].to_numpy().tobytes(), b"".join(rows["vector"]))], columns=["part", "ids", "labels", "vectors"])

    return stored(placed.filter("not anchor").select("id", "label", "vector", "part").groupBy("part").applyInPandas(pack, "part int, ids binary, labels binary, vectors binary"))
