"""Stored quantile sketches and tail probabilities against exact figures."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.functions.tails import student_two_sided
from holdfast.operators import drift as D
from holdfast.operators import sketches as S
from holdfast.sources.tables import TableStore

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def values(spark):
    """A third of all values are equal; days differ in their distribution."""
    n = 120_000
    day = RNG.integers(0, 12, n)
    x = np.where(np.arange(n) % 3 == 0, 0.5, RNG.beta(2, 3 + day / 4, n).round(6))
    pdf = pd.DataFrame({"day": pd.to_datetime("2024-01-01") + pd.to_timedelta(day, "D"), "x": x, "y": (day > 5).astype(float)})
    return pdf, spark.createDataFrame(pdf).withColumn("day", F.to_date("day"))


def test_merged_shares_stay_within_the_bound(spark, values, tmp_path):
    pdf, df = values
    store = TableStore(spark, str(tmp_path))
    S.record(store, df, ["x", "y"], "load")
    for first, last in (("2024-01-01", "2024-01-12"), ("2024-01-03", "2024-01-05"), ("2024-01-07", "2024-01-07")):
        part = pdf[(pdf.day >= first) & (pdf.day <= last)]
        merged = S.merge(S.stored(store, first, last)).where("feature = 'x'").withColumn("q", S.grid(F.col("sketch")))
        probes = [0.05, 0.2, 0.35, 0.5, 0.500001, 0.8]
        row = merged.select("n", "total", *[S.share_below(F.col("q"), F.lit(p)).alias(f"p{i}") for i, p in enumerate(probes)]).first()
        assert row.n == len(part) and row.total == pytest.approx(part.x.sum())
        for i, p in enumerate(probes):
            assert abs(row[f"p{i}"] - (part.x < p).mean()) <= S.rank_error()


def test_rerun_takes_its_old_place_and_days_are_read_alone(spark, values, tmp_path):
    pdf, df = values
    store = TableStore(spark, str(tmp_path))
    S.record(store, df.where("day < '2024-01-04'"), ["x"], "a")
    S.record(store, df.where("day >= '2024-01-04'"), ["x"], "b")
    S.record(store, df.where("day < '2024-01-04'"), ["x"], "a")
    assert S.stored(store, "2024-01-01", "2024-12-31").count() == 12
    assert S.merge(S.stored(store, "2024-01-01", "2024-01-03")).first().n == (pdf.day < "2024-01-04").sum()


@pytest.mark.parametrize("feature", ["x", "y"])
def test_drift_is_near_the_exact_one(values, feature):
    _, df = values
    old, new = df.where("day < '2024-01-05'"), df.where("day >= '2024-01-09'")
    found = S.distribution_drift(S.sketch(old, [feature], ["day"]), S.sketch(new, [feature], ["day"])).first()
    exact = D.psi(old, new, feature).first().psi
    assert found.psi == pytest.approx(exact, abs=0.02 + 0.05 * exact)
    same = S.distribution_drift(S.sketch(old, [feature]), S.sketch(old, [feature], ["day"])).first()
    assert same.psi < 0.005 and same.greatest_shift <= 2 * same.rank_error and same.status == "Stable"


def test_empty_and_null_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan"))], "x double, y double")
    rows = {r.feature: r.n for r in S.sketch(df, ["x", "y"]).collect()}
    assert rows == {"y": 1}
    assert S.distribution_drift(S.sketch(df, ["x"]), S.sketch(df, ["y"])).count() == 0
    one = S.sketch(df, ["y"])
    assert S.distribution_drift(one, one).first().psi == 0.0


def tail(t, df):
    """P(|T| > t): closed forms for few degrees of freedom, the normal tail with its corrections for very many, Simpson between."""
    t = abs(t)
    if df == 1:
        return 1 - 2 / math.pi * math.atan(t)
    if df == 2:
        return 1 - t / math.sqrt(2 + t * t)
    if df > 100_000:
        z = statistics.NormalDist()
        return 2 * (z.cdf(-t) + z.pdf(t) * ((t**3 + t) / (4 * df) + (3 * t**7 - 7 * t**5 - 5 * t**3 - 3 * t) / (96 * df * df)))

    def whole(end):
        x = np.linspace(0, end, 20_001)
        w = np.where(np.arange(20_001) % 2 == 1, 4.0, 2.0)
        w[[0, -1]] = 1
        return (w * np.cos(x) ** (df - 1)).sum() * end

    return 1 - whole(math.atan(t / math.sqrt(df))) / whole(math.pi / 2)


def test_student_tail(spark):
    cases = [(t, float(df)) for df in (1, 2, 3, 4, 5, 10, 29, 100, 1498, 20_000, 1_000_000, 9_999_998) for t in (0.0, 1e-6, 0.1, -0.7, 1.0, 1.29, 1.3, 1.645, -1.96, 2.576, 4.0, 12.7, 63.66)]
    got = spark.createDataFrame(cases, "t double, df double").select("t", "df", student_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(tail(r.t, r.df), abs=1e-9), r
    odd = spark.createDataFrame([(None, 5.0), (1.0, 0.0), (float("inf"), 5.0)], "t double, df double").select(student_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    assert [r.p for r in odd] == [None, None, 0.0]
