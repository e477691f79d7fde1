"""Tail probabilities as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the continued fraction (it converges in under 50 for any degrees of freedom), and of the shift of the gamma ratio.
STEPS, SHIFT = 120, 60


def _gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a) for a > 0: an asymptotic series after a shift upwards."""
    z = a + SHIFT
    series = 1 - 1 / (8 * z) + 1 / (128 * z**2) + 5 / (1024 * z**3) - 21 / (32768 * z**4)
    down = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(1.0), lambda p, i: p * (a + i) / (a + i + 0.5))
    return F.sqrt(z) * series * down


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, evaluated from the front by running ratios."""

    def step(s: Column, i: Column) -> Column:
        m = i.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / (1 + even * s["d"]), 1 + even / s["c"]
        d2, c2 = 1 / (1 + odd * d1), 1 + odd / c1
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

    first = 1 / (1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["h"])


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) of Student's t with `df` degrees of freedom: the regularised incomplete beta function at
    df / (df + t^2) with parameters df / 2 and 1/2. Null for a null t or fewer than one degree of freedom."""
    a, y = df / 2.0, t * t / (df + t * t)
    front = _gamma_ratio(a) / F.sqrt(F.pi()) * F.exp(a * F.log1p(-y) + 0.5 * F.log(y))
    left = front * _fraction(a, F.lit(0.5), 1 - y) / a
    right = 1 - front * _fraction(F.lit(0.5), a, y) / 0.5
    tail = F.when(t == 0, 1.0).when(1 - y < (a + 1) / (a + 2.5), left).otherwise(right)
    return F.when(t.isNotNull() & (df >= 1), F.when(F.abs(t) == float("inf"), 0.0).otherwise(tail))
