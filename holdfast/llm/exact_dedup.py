"""Exact deduplication: groups by a 128-bit content hash, byte comparison inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored, text_of

PICKS = {"smallest": F.min, "largest": F.max}


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are equal byte by byte; null counts as empty. Of equal rows the one with the
    smallest (or `keep="largest"`) id stays; null ids lose against any other, and a group of null ids keeps null.
    Rows that repeat both id and text all count in group_size and share their `kept`; `deduplicate` reduces them to
    one. Other columns are not read. An empty table gives an empty result.

    Only (id, hash) pairs are shuffled for all rows, with partial counts first, so a group with a third of all rows
    costs one row per task. Texts move only for groups of two and more: each is compared with one text of its group
    by a join that Spark can split at a hot hash. Should texts of one hash differ, the groups of two and more are
    formed by (hash, text) instead.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), digest(text).alias("h"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    groups, dups, collided = _compared(rows, keep)
    if collided:
        by, groups = ["h", "text"], dups.groupBy("h", "text").agg(F.count("*").alias("n"), PICKS[keep]("id").alias("first"))
    else:
        by, groups = ["h"], small(groups, 48)
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first"))
    return rows.select("id", "sha", *by).join(groups, by, "left").select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of `docs` that stay, whole: one for each different text (see `exact_groups`)."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), digest(text).alias("h"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    groups, dups, collided = _compared(rows, keep)
    by = ["h", "text"] if collided else ["h"]
    if collided:
        own = dups.groupBy("h", "text").agg(PICKS[keep]("id").alias("own"))
        dups = dups.join(own, ["h", "text"]).filter(F.col("id").eqNullSafe(F.col("own")))
    else:
        dups = dups.filter(F.col("id").eqNullSafe(F.col("first")))
    single = rows.join(small(groups, 48), "h", "left_anti")
    return single.select("row.*").unionByName(dups.dropDuplicates(by).select("row.*"))


def _compared(rows: DataFrame, keep: str) -> tuple[DataFrame, DataFrame, bool]:
    """The hashes that occur twice or more, their rows, and whether any of these differ in bytes under one hash."""
    groups = stored(rows.groupBy("h").agg(F.count("*").alias("n"), PICKS[keep]("id").alias("first")).filter("n > 1"))
    dups = stored(rows.drop("sha").join(small(groups.select("h", "first"), 40), "h"))
    firsts = stored(dups.filter(F.col("id").eqNullSafe(F.col("first"))).groupBy("h").agg(F.min("text").alias("first_text")))
    return groups, dups, not dups.select("h", "text").join(firsts, "h").filter("text != first_text").isEmpty()
