"""Nearest neighbours against brute force, with copies, hot values and many cells; class balance."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.operators import balancing as B
from holdfast.plans.neighbours import nearest_points, weighted_points
from holdfast.sources.tables import TableStore

RNG = np.random.default_rng(11)


@pytest.mark.parametrize("cell_rows", [1000, 40, 6])
def test_nearest_points_brute_force(spark, cell_rows):
    n, k = 400, 4
    x = np.column_stack([RNG.integers(0, 6, n), RNG.random(n).round(2) * 100, np.where(np.arange(n) % 3 == 0, 7.0, RNG.normal(0, 50, n).round(1))])
    x[: n // 3] = x[0]  # a third of the rows are copies
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))
    got = nearest_points(weighted_points(df, ["a", "b", "c"]), 3, k, cell_rows).collect()
    distinct, counts = np.unique(x, axis=0, return_counts=True)
    assert len(got) == len(distinct)
    for r in got:
        d2 = np.sort(((distinct - np.array(r.v)) ** 2).sum(axis=1))[1 : k + 1]
        assert np.allclose([p.d2 for p in r.near], d2)
        assert r.m == counts[(distinct == np.array(r.v)).all(axis=1)][0]


def test_smote_balances(spark, tables, tmp_path):
    from holdfast.operators.features import engineer, with_churn_label

    df = with_churn_label(engineer(tables.rc))
    out = B.smote(df, TableStore(spark, str(tmp_path)), "r1", cell_rows=16)
    sizes = {r.churn_label: r["count"] for r in out.groupBy("churn_label").count().collect()}
    assert sizes[0] == sizes[1]
    assert out.where("not synthetic").count() == tables.rc.count()
    made, real = out.where("synthetic"), out.where("not synthetic and churn_label = 1")
    assert made.count() == made.select("customer_id").distinct().count() > 0
    for f in B.BALANCE_FEATURES:
        lo, hi = real.agg(F.min(f), F.max(f)).first()
        assert made.where(~F.col(f).between(lo - 1e-9, hi + 1e-9)).count() == 0


def test_smote_needs_enough_rows(spark, tables, tmp_path):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 0, 2.0), ("c", 0, 3.0)], "customer_id string, churn_label int, x double")
    with pytest.raises(ValueError, match="too few"):
        B.smote(df, TableStore(spark, str(tmp_path)), "r1", ["x"])
