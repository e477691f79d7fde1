"""Joins between predictions and customers."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast import constants as K
from holdfast.functions import customer as C
from holdfast.functions import risk as R
from holdfast.functions.rounding import half_up
from holdfast.plans.pick import top_per_key

PROFILE = ["gender", "senior_citizen", "tenure", "contract", "internet_service", "payment_method", "monthly_charges", "total_charges"]


def predictions_with_profile(cp: DataFrame, rc: DataFrame, now: Column) -> DataFrame:
    """Predictions with the customer profile, actual churn and age of the score in days."""
    scores = cp.select("customer_id", "churn_probability", "risk_segment", "model_version", "predicted_at")
    profile = rc.select("customer_id", *PROFILE, F.col("churn").alias("actual_churn"))
    joined = scores.join(profile, "customer_id")
    return joined.withColumn("days_since_prediction", R.whole_days(F.col("predicted_at"), now))


def unscored_customers(rc: DataFrame, cp: DataFrame) -> DataFrame:
    """Customers that were never scored."""
    return rc.join(cp.select("customer_id"), "customer_id", "left_anti")


def stale_customers(rc: DataFrame, cp: DataFrame, now: Column, days: int = K.STALE_DAYS) -> DataFrame:
    """Customers with a score older than `days`; a semi join keeps one row each."""
    old = cp.where(F.col("predicted_at") < now - F.make_dt_interval(F.lit(days)))
    return rc.join(old.select("customer_id"), "customer_id", "left_semi")


def customers_in_segment(rc: DataFrame, cp: DataFrame, segment: str) -> DataFrame:
    return rc.join(cp.where(F.col("risk_segment") == segment).select("customer_id"), "customer_id", "left_semi")


def customers_in_list(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("customer_id"), "customer_id", "left_semi")


def compare_to_average(rc: DataFrame) -> DataFrame:
    """Six figures per customer next to the population average, in long form."""
    wide = rc.select(
        "customer_id",
        C.charge_per_month(F.col("total_charges"), F.col("tenure")).alias("charge_per_month"),
        C.services_count().cast("double").alias("services_count"),
        C.contract_risk(F.col("contract")).cast("double").alias("contract_risk_score"),
        C.payment_risk(F.col("payment_method")).cast("double").alias("payment_risk_score"),
        F.col("tenure").cast("double").alias("tenure"), "monthly_charges",
    )
    names = wide.columns[1:]
    averages = wide.agg(F.struct(*[F.avg(c).alias(c) for c in names])).scalar()
    entries = F.array(*[
        F.struct(
            F.lit(c).alias("feature"), half_up(F.col(c), 4).alias("customer_value"),
            half_up(averages.getField(c), 4).alias("population_average"), half_up(F.col(c) - averages.getField(c), 4).alias("diff"),
        )
        for c in names
    ])
    return wide.select("customer_id", F.inline(entries))


def tag_split(rc: DataFrame, split: DataFrame) -> DataFrame:
    """Raw rows with the train/test tag of their customer; untagged customers drop out."""
    return rc.join(split.select("customer_id", "split"), "customer_id")


def similar_customers(df: DataFrame, k: int = 5) -> DataFrame:
    """For every customer the k others nearest in tenure with the same segment and contract.

    Exact without comparing customers in pairs. Equal tenures form a cell, and a cell can only give
    its k+1 smallest ids to anybody (one may be the customer itself). The k nearest others lie in
    the own cell or the k+1 nearest filled cells on either side. So every cell ranks the candidates
    of that window once and keeps k+1; a customer takes the list of its cell and leaves itself out.
    """
    group = ["risk_segment", "contract"]
    member = F.struct("customer_id", "tenure", "monthly_charges", "churn_probability")
    givers = top_per_key(df.select(*group, "tenure", "customer_id", "monthly_charges", "churn_probability"),
                         [*group, "tenure"], [F.col("customer_id")], k + 1)
    # at most k+1 members per cell by the line above
    cells = givers.groupBy(*group, "tenure").agg(F.collect_list(member).alias("members"))
    near = W.partitionBy(*group).orderBy("tenure").rowsBetween(-(k + 1), k + 1)
    pools = cells.select(*group, "tenure", F.flatten(F.collect_list("members").over(near)).alias("pool"))
    keyed = F.transform("pool", lambda m: F.struct(
        F.abs(m["tenure"] - F.col("tenure")).alias("tenure_diff"), m["customer_id"].alias("similar_id"),
        m["tenure"].alias("similar_tenure"), m["monthly_charges"].alias("similar_charges"),
        m["churn_probability"].alias("similar_probability"),
    ))
    lists = pools.select(*group, "tenure", F.slice(F.array_sort(keyed), 1, k + 1).alias("nearest"))

    # one short list per segment, contract and tenure in months: bounded by the schema
    probes = df.select("customer_id", *group, "tenure").join(F.broadcast(lists), [*group, "tenure"])
    others = F.slice(F.filter("nearest", lambda m: m["similar_id"] != F.col("customer_id")), 1, k)
    ranked = probes.select("customer_id", *group, F.posexplode(others).alias("_place", "_s"))
    return ranked.select("customer_id", *group, (F.col("_place") + 1).alias("rank"), "_s.*")
