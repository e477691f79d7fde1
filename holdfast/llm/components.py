"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, stored

#: Rows of a written part: small graphs are not spread over more files than they fill.
PART = 50_000


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (a, b); the component is the smallest id in it.

    Large stars hang the greater neighbours of a node on the least node around it, small stars the smaller ones, until
    only stars are left: few rounds however long the chains are. Neighbourhoods are only ever reduced to their minimum,
    never gathered, so a hub with most of the links costs one row per task. The minima are broadcast while the counted
    links bound their size; beyond that they are written and joined, where Spark can split a hub's rows.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    n = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: v > u goes to the least of u and its neighbours
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = _written(both.filter("v > u").join(_bounded(least, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v"), n)
        # small star: u and its smaller neighbours go to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(_bounded(least, n), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = _written(moved.select("e.*").filter("u != v").distinct(), n)
        # only stars: no node hangs on two others, or on one while others hang on it
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1")
        if open_.isEmpty():
            break
        n = edges.count()
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return _written(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), 2 * n)


def _bounded(least: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(least) if rows * 24 <= BROADCAST_BYTES else stored(least)


def _written(df: DataFrame, rows: int) -> DataFrame:
    return stored(df.coalesce(max(12, rows // PART)))
