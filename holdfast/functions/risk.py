"""Column expressions over scores: segments, retention tiers, actions, value, drift status."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.functions.lookups import lookup
from holdfast.functions.rounding import half_up


def risk_segment(p: Column, high: float = K.HIGH_THRESHOLD, medium: float = K.MEDIUM_THRESHOLD) -> Column:
    return F.when(p >= high, F.lit("High")).when(p >= medium, F.lit("Medium")).otherwise(F.lit("Low"))


def thresholds(high: float | None = None) -> tuple[float, float]:
    """(high, medium) cut-offs; a custom high cut-off pulls the medium one down to half of it."""
    if high is None:
        return K.HIGH_THRESHOLD, K.MEDIUM_THRESHOLD
    return high, min(K.MEDIUM_THRESHOLD, high / 2)


def retention_tier(charges: Column, spelled: str = "Tier %d") -> Column:
    """Tier by monthly charges; the list spells 'Tier 1', the predictions table 'Tier1'."""
    tier = [F.lit(spelled % n) for n in (1, 2, 3)]
    return F.when(charges > K.RETENTION_UPPER, tier[0]).when(charges >= K.RETENTION_LOWER, tier[1]).otherwise(tier[2])


def retention_priority(segment: Column, charges: Column) -> Column:
    return F.when(segment == "High", retention_tier(charges, "Tier%d"))


def recommended_action(segment: Column, priority: Column) -> Column:
    key = F.concat_ws("/", segment, F.when(segment == "High", priority))
    table = {"/".join(filter(None, pair)): text for pair, text in K.RECOMMENDED_ACTIONS.items()}
    return lookup(key, table)


def retention_actions(segment: Column) -> Column:
    """All actions for a segment as an array; unknown segments get the low-risk list."""
    listed = {s: F.array(*[F.lit(a) for a in acts]) for s, acts in K.RETENTION_ACTIONS.items()}
    return F.when(segment == "High", listed["High"]).when(segment == "Medium", listed["Medium"]).otherwise(listed["Low"])


def expected_loss(charges: Column, p: Column) -> Column:
    return half_up(charges * p, 2)


def whole_days(since: Column, now: Column) -> Column:
    """Complete 24-hour days between two zoneless timestamps, truncated toward zero."""
    return F.extract(F.lit("DAY"), now - since).cast("int")


def expected_months(p: Column) -> Column:
    """Expected remaining months 1/p, capped; p = 0 gives the cap (least() skips NULL)."""
    return F.least(F.lit(float(K.CLV_MONTH_CAP)), F.lit(1.0) / F.nullif(p, F.lit(0.0)))


def lifetime_value(charges: Column, p: Column) -> Column:
    return charges * expected_months(p)


def psi_status(psi: Column) -> Column:
    return F.when(psi < K.PSI_MODERATE, F.lit("Stable")).when(psi < K.PSI_SIGNIFICANT, F.lit("Moderate")).otherwise(F.lit("Significant"))
