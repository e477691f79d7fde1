"""Exact k nearest neighbours (Euclidean) of every point in a table, without comparing all pairs.

Equal points are merged first and carry a weight, so copies cost nothing. The distinct points are cut
into cells of about equal size, level by level, at the median of each cell's widest dimension; the
number of levels follows the number of points. Inside its cell a point finds k candidates; the
distance to the k-th bounds the search. Only cells whose bounding box reaches into that ball are
asked as well, found by going down the tree of boxes, which is a table like any other; the answers
are merged. Any cell that could hold a nearer point is asked, and among equal distances the smaller
point counts, so the result is exact and the same for every layout and cell size.
"""

from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.plans.pick import top_per_key
from holdfast.sources.tables import ensure_checkpoint_dir

CELL_ROWS = 2048
STRIDE = 4  # levels of the tree of boxes that one join goes down
_BLOCK = 4_000_000  # numbers per block of a distance computation, 32 MB


def weighted_points(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct points `v` with their weight `m`."""
    point = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    return df.groupBy(point.alias("v")).agg(F.count("*").alias("m"))


def _few(cells: DataFrame, rows: int) -> DataFrame:
    """Mark a table of at most `rows` cells for broadcast while that is a few MB."""
    return F.broadcast(cells) if rows <= 1 << 14 else cells


def _split_level(points: DataFrame, d: int, level: int) -> DataFrame:
    dims = [F.col("v")[i] for i in range(d)]
    stats = points.groupBy("cell").agg(
        F.array(*[F.max(x) - F.min(x) for x in dims]).alias("spread"), F.array(*[F.percentile_approx(x, 0.5, 1000) for x in dims]).alias("middle"),
        F.array(*[F.max(x) for x in dims]).alias("top"), F.array(*[F.min(x) for x in dims]).alias("bottom"),
    )
    axis = (F.array_position("spread", F.array_max("spread")) - 1).cast("int")
    cut = stats.withColumn("axis", axis).withColumn("at", F.get("middle", "axis"))
    # a median equal to the greatest value would leave one side empty
    at = F.when(F.col("at") < F.get("top", "axis"), F.col("at")).otherwise((F.get("top", "axis") + F.get("bottom", "axis")) / 2)
    cut = cut.select("cell", "axis", at.alias("at"))
    placed = points.join(_few(cut, 2**level), "cell")
    return placed.select("v", "m", (F.col("cell") * 2 + (F.get("v", "axis") > F.col("at")).cast("long")).alias("cell"))


def _nearest(asking: np.ndarray, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and positions of up to k nearest held points for each asking point."""
    size = min(k, len(held))
    dist, place = [], []
    step = max(1, _BLOCK // held.size)
    for start in range(0, len(asking), step):
        part = asking[start:start + step]
        d2 = ((part[:, None, :] - held[None, :, :]) ** 2).sum(axis=2)
        best = np.argsort(d2, axis=1, kind="stable")[:, :size]
        dist.append(np.take_along_axis(d2, best, axis=1))
        place.append(best)
    return np.concatenate(dist), np.concatenate(place)


_FOUND = "v array<double>, d2 double, near array<double>, near_m bigint"


def _answers(asking: pd.Series, held: pd.DataFrame, k: int) -> pd.DataFrame:
    points = np.stack(held.v.to_numpy())
    # in the order of the points themselves, so that a stable sort by distance settles ties
    order = np.lexsort(points.T[::-1])
    points, held = points[order], held.iloc[order]
    # one more than k, since a point may find itself
    dist, place = _nearest(np.stack(asking.to_numpy()), points, k + 1)
    size = dist.shape[1]
    rows = np.repeat(np.arange(len(asking)), size)
    flat = place.ravel()
    return pd.DataFrame({"v": asking.to_numpy()[rows], "d2": dist.ravel(), "near": held.v.to_numpy()[flat], "near_m": held.m.to_numpy()[flat]})


def _reached(reach: DataFrame, celled: DataFrame, d: int, levels: int) -> DataFrame:
    """(v, cell) for every other cell whose box the ball around a point touches, found by going down the tree of boxes."""
    asking = reach.withColumn("at", F.lit(0).cast("long"))
    for done in range(0, levels, STRIDE):
        deeper = min(STRIDE, levels - done)
        node = F.shiftright("cell", levels - done - deeper)
        boxes = celled.groupBy(node.alias("node")).agg(
            F.array(*[F.min(F.col("v")[i]) for i in range(d)]).alias("low"), F.array(*[F.max(F.col("v")[i]) for i in range(d)]).alias("high"))
        boxes = boxes.withColumn("at", F.shiftright("node", deeper))
        gaps = [F.greatest(F.col("low")[i] - F.col("v")[i], F.col("v")[i] - F.col("high")[i], F.lit(0.0)) for i in range(d)]
        # a rounding error must not pass over a box that just touches
        touches = sum((g * g for g in gaps), F.lit(0.0)) <= F.col("far") * (1 + 1e-9)
        asking = asking.join(_few(boxes, 2 ** (done + deeper)), "at").where(touches).select("v", "cell", "far", F.col("node").alias("at"))
    return asking.where("at != cell").select("v", F.col("at").alias("cell"))


def nearest_points(points: DataFrame, d: int, k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(v, m, near): for each distinct point up to k nearest other points as sorted (d2, v, m) structs.

    `points` is (v, m); it is read several times and should be a stored or checkpointed table.
    """
    n = points.count()
    ensure_checkpoint_dir(points.sparkSession)
    levels = max(0, ceil(log2(max(n, 1) / cell_rows)))
    celled = points.withColumn("cell", F.lit(0).cast("long"))
    for level in range(levels):
        celled = _split_level(celled, d, level)
        if level % 4 == 3:
            celled = celled.checkpoint()  # keeps the plan and the recovery short
    if levels:
        celled = celled.checkpoint()

    def inside(held: pd.DataFrame) -> pd.DataFrame:
        return _answers(held.v, held, k)

    own = celled.groupBy("cell").applyInPandas(inside, _FOUND).where(F.col("near") != F.col("v"))
    found = own
    if levels:
        kth = top_per_key(own, ["v"], [F.col("d2"), F.col("near")], k).groupBy("v").agg(F.count("*").alias("c"), F.max("d2").alias("far"))
        reach = celled.join(kth, "v", "left").select("v", "cell", F.when(F.col("c") >= k, F.col("far")).otherwise(F.lit(float("inf"))).alias("far"))

        guests = _reached(reach, celled, d, levels).checkpoint().select(F.col("v").alias("v"), F.col("cell").alias("cell"))
        # a cell that many points ask is copied, so that no task gets more than its share of them
        load = guests.groupBy("cell").agg(F.ceil(F.count("*") / (4 * cell_rows)).alias("shares"))
        asking = guests.join(_few(load, 2**levels), "cell").select("cell", "v", F.pmod(F.xxhash64("v"), "shares").alias("share"))
        copies = load.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
        held = celled.join(copies, "cell").select("cell", "share", "v", "m")

        def asked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"v": [], "d2": [], "near": [], "near_m": []})
            return _answers(left.v, right, k)

        elsewhere = asking.groupBy("cell", "share").cogroup(held.groupBy("cell", "share")).applyInPandas(asked, _FOUND)
        found = own.unionByName(elsewhere)
    best = top_per_key(found, ["v"], [F.col("d2"), F.col("near")], k)
    # at most k entries per point by the line above
    lists = best.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("d2", F.col("near").alias("v"), F.col("near_m").alias("m")))).alias("near"))
    return points.join(lists, "v", "left")
