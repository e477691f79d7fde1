"""Column expressions over the raw customer table."""

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.functions.lookups import band, lookup


def tenure_group(tenure: Column, labels: list[str] = K.TENURE_LABELS_MODEL) -> Column:
    """Right-closed tenure band. Model labels leave a negative tenure empty; SQL labels do not."""
    label = band(tenure, K.TENURE_BOUNDS, labels)
    return F.when(tenure >= 0, label) if labels == K.TENURE_LABELS_MODEL else label


def charge_tier(charge: Column) -> Column:
    return band(charge, K.CHARGE_TIER_BOUNDS, K.CHARGE_TIERS, closed="left")


def charge_per_month(total: Column, tenure: Column) -> Column:
    """Lifetime charges per month; a tenure of zero counts as one month."""
    return total / F.when(tenure == 0, F.lit(1)).otherwise(tenure)


def service_flags() -> list[Column]:
    subscribed = [F.col(c) == "Yes" for c in ["phone_service", *K.ADDON_COLUMNS]]
    return [*subscribed, F.col("internet_service") != "No"]


def services_count() -> Column:
    """Subscribed services out of eight; NULL if any flag is NULL (multiple lines do not count)."""
    return reduce(add, [flag.cast("int") for flag in service_flags()])


def contract_risk(contract: Column) -> Column:
    return lookup(contract, K.CONTRACT_RISK)


def payment_risk(method: Column) -> Column:
    return lookup(method, K.PAYMENT_RISK)


def churned(churn: Column) -> Column:
    return F.coalesce(churn == "Yes", F.lit(False)).cast("int")


def senior_label(senior: Column) -> Column:
    return F.when(senior == 1, F.lit("Senior")).otherwise(F.lit("Non-Senior"))


def household(partner: Column, dependents: Column) -> Column:
    alone_or_both = {("Yes", "Yes"): "Partner+Dependents", ("Yes", "No"): "Partner Only", ("No", "Yes"): "Dependents Only"}
    out = F
    for (p, d), label in alone_or_both.items():
        out = out.when((partner == p) & (dependents == d), F.lit(label))
    return out.otherwise(F.lit("Neither"))
