"""Decimal rounding: half away from zero on the decimal value, as SQL NUMERIC rounds."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(col: Column, digits: int) -> Column:
    """Round to `digits` through a decimal, so that a tie never depends on binary noise."""
    return F.round(col.cast("decimal(38,8)"), digits).cast("double")


def exact_sum(col: Column | str, digits: int = 8) -> Column:
    """Sum of amounts through decimals: the order of addition, and so the task layout, cannot change it."""
    col = F.col(col) if isinstance(col, str) else col
    return F.sum(col.cast(f"decimal(28,{digits})")).cast("decimal(38,8)")


def exact_avg(col: Column | str) -> Column:
    """Mean of amounts through an exact sum."""
    col = F.col(col) if isinstance(col, str) else col
    return exact_sum(col).cast("double") / F.nullif(F.count(col), F.lit(0))


def rate_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; NULL when `whole` is zero."""
    return half_up(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)
