"""Reproducible stratified samples and folds by hash order, spread over many tasks.

A row's place inside its stratum is its rank by md5(key, seed). Hashes are uniform, so their leading
hex digits cut every stratum into even cells whatever the data looks like; a rank is then the
cell's offset plus a rank inside the cell. Only the (stratum, cell) counts are ever gathered.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CELL_DIGITS = 3  # 16**3 cells per stratum


def hash_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")).cast("binary"))


def _cells(df: DataFrame, stratum: str, key: str, seed: int, digits: int) -> tuple[DataFrame, DataFrame]:
    celled = df.withColumn("_hash", hash_key(key, seed)).withColumn("_cell", F.substring("_hash", 1, digits))
    below = W.partitionBy(stratum).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    sizes = celled.groupBy(stratum, "_cell").agg(F.count("*").alias("_size"))
    sizes = sizes.select(
        stratum, "_cell", "_size",
        F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_below"),
        F.sum("_size").over(W.partitionBy(stratum)).alias("_all"),
    )
    return celled, sizes


def stratum_rank(df: DataFrame, stratum: str, key: str, seed: int, name: str = "rank", digits: int = CELL_DIGITS) -> DataFrame:
    """Add the exact 1-based hash rank of each row inside its stratum."""
    celled, sizes = _cells(df, stratum, key, seed, digits)
    inside = F.row_number().over(W.partitionBy(stratum, "_cell").orderBy("_hash", key))
    # at most 16**digits rows per stratum, a class label: bounded
    ranked = celled.join(F.broadcast(sizes.select(stratum, "_cell", "_below")), [stratum, "_cell"])
    return ranked.select(*df.columns, (F.col("_below") + inside).cast("long").alias(name))


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.2, seed: int = 42, digits: int = CELL_DIGITS) -> DataFrame:
    """Tag each row train/test; exactly round(n * test_fraction) rows of every stratum are test.

    Only the cell that holds the cut is ranked (one cell in 16**digits); all other rows are tagged
    by comparing their hash, so the table itself is never shuffled.
    """
    celled, sizes = _cells(df, label, key, seed, digits)
    wanted = F.floor(F.col("_all") * F.lit(test_fraction) + F.lit(0.5)).cast("long")
    cut_cell = sizes.withColumn("_want", wanted).where(
        (F.col("_below") < F.col("_want")) & (F.col("_below") + F.col("_size") >= F.col("_want"))
    )
    # one row per class label
    cut_cell = F.broadcast(cut_cell.select(label, "_cell", (F.col("_want") - F.col("_below")).alias("_nth")))
    ranked = celled.join(cut_cell, [label, "_cell"]).withColumn(
        "_rank", F.row_number().over(W.partitionBy(label, "_cell").orderBy("_hash", key))
    )
    last = ranked.where(F.col("_rank") == F.col("_nth")).select(label, F.col("_hash").alias("_last"), F.col(key).alias("_last_key"))
    tagged = celled.join(F.broadcast(last), label, "left")
    chosen = (F.col("_hash") < F.col("_last")) | ((F.col("_hash") == F.col("_last")) & (F.col(key) <= F.col("_last_key")))
    split = F.when(chosen, F.lit("test")).otherwise(F.lit("train"))
    return tagged.select(*df.columns, split.alias("split"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add `fold` 0..k-1, dealt in hash order inside each stratum (fold sizes differ by at most one)."""
    ranked = stratum_rank(df, label, key, seed, name="_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")
