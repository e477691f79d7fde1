"""CASE chains built from fixed tables (they stay inside whole-stage code generation)."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(col: Column, table: Mapping[str, object], default: object = None) -> Column:
    """Value of `col` in a small fixed table, else `default`."""
    out = None
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def band(col: Column, bounds: Sequence[float], labels: Sequence[str], closed: str = "right") -> Column:
    """Label of the band holding `col`; `closed` says which end of a band belongs to it."""
    out = F
    for bound, label in zip(bounds, labels):
        out = out.when(col <= bound if closed == "right" else col < bound, F.lit(label))
    return F.when(col.isNotNull(), out.otherwise(F.lit(labels[-1])))


def listed(col: Column, levels: Sequence[str]) -> Column:
    """`col`, or an error when a row holds anything else than the listed levels (a pivot would drop it silently)."""
    return F.when(col.isin(*levels), col).otherwise(F.raise_error(F.concat(F.lit("Unlisted level: "), F.coalesce(col, F.lit("NULL")))).cast("string"))


def position(col: Column, levels: Sequence[str]) -> Column:
    """1-based place of `col` in a fixed order; NULL when it is not listed."""
    return lookup(col, {level: i + 1 for i, level in enumerate(levels)})
