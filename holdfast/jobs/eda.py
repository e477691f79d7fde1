"""EDA job: headline figures of the customers as one long table."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.functions import customer as C
from holdfast.functions.rounding import rate_pct
from holdfast.operators import quality, stats


def eda_summary(rc: DataFrame) -> DataFrame:
    """(section, label, value): churn rate, top correlations, rates by contract and tenure, charges by churn.

    The tenure section ends at the greatest valid tenure; later values are left out of it.
    """
    y = C.churned(F.col("churn"))
    inside = F.col("tenure").between(0, K.TENURE_MAX)
    dims = F.array_compact(F.array(
        F.struct(F.lit("churn_rate").alias("section"), F.lit("overall").alias("label")),
        F.struct(F.lit("contract").alias("section"), F.col("contract").alias("label")),
        F.when(inside, F.struct(F.lit("tenure_group").alias("section"), C.tenure_group(F.col("tenure"), K.TENURE_LABELS_SQL).alias("label"))),
    ))
    rates = rc.select(F.inline(dims), y.alias("y")).groupBy("section", "label").agg(rate_pct(F.sum("y"), F.count("*")).alias("value"))
    top = stats.top_correlations(rc, 5).select(F.lit("top_correlation").alias("section"), F.col("feature").alias("label"), F.col("correlation").alias("value"))
    charges = quality.charge_stats_by_churn(rc)
    entries = F.array(*[F.struct(F.concat(F.lit("charges_"), F.lit(c)).alias("section"), F.col("churn").alias("label"), F.col(c).alias("value")) for c in ("mean", "std", "min", "max")])
    return reduce(DataFrame.unionByName, [rates, top, charges.select(F.inline(entries))])
