"""Plan helpers against brute force, with hot values and hot keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.operators import drift as D
from holdfast.operators import evaluation as E
from holdfast.operators import history as H
from holdfast.operators import joins as J
from holdfast.operators import segments as G
from holdfast.operators import stats as S
from holdfast.plans.ordered import quantiles, running_totals, value_counts
from holdfast.plans.pick import first_per_key, latest_per_key, top_per_key
from holdfast.plans.strata import stratified_folds, stratified_split, stratum_rank

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value and one key."""
    n = 3000
    value = np.where(np.arange(n) % 3 == 0, 0.5, RNG.random(n).round(4))
    pdf = pd.DataFrame({"id": [f"r{i:05d}" for i in range(n)], "g": np.where(np.arange(n) % 3 == 0, "hot", RNG.integers(0, 5, n).astype(str)), "x": value})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("parts", [1, 64, 5000])
def test_running_totals(spark, skewed, parts):
    """Exact however many partitions the ranges are dealt to, empty ones among them."""
    pdf, df = skewed
    want = pdf.groupby("x").size().cumsum()
    got = running_totals(df.groupBy("x").agg(F.count("*").alias("n")), "x", ["n"], rows=len(want) / parts).orderBy("x").toPandas()
    assert got.n_upto.tolist() == want.tolist() and set(got.n_total) == {len(pdf)}


def test_running_totals_use_the_ranges(skewed):
    pdf, df = skewed
    out = running_totals(df.groupBy("g", "x").agg(F.count("*").alias("n")), "x", ["n"], ["g"], rows=100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" in plan and "_part" in plan
    want = pdf.groupby(["g", "x"]).size().groupby(level=0).cumsum()
    assert out.orderBy("g", "x").toPandas().n_upto.tolist() == want.tolist()
    empty = running_totals(df.where("x < 0").groupBy("x").agg(F.count("*").alias("n")), "x", ["n"])
    assert empty.count() == 0 and empty.columns == ["x", "n", "n_upto", "n_total"]


def test_running_totals_by_group(skewed):
    pdf, df = skewed
    got = running_totals(df.groupBy("g", "x").agg(F.count("*").alias("n")), "x", ["n"], ["g"]).orderBy("g", "x").toPandas()
    want = pdf.groupby(["g", "x"]).size().groupby(level=0).cumsum()
    assert got.n_upto.tolist() == want.tolist()


def test_quantiles(skewed):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = quantiles(value_counts(df, ["x"]), probs).first()
    assert got.n == len(pdf) and np.allclose(got.quantiles, np.quantile(pdf.x, probs))
    by = {r.g: r.quantiles for r in quantiles(value_counts(df, ["x"], ["g"]), probs, ["g", "feature"]).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(by[g], np.quantile(part.x, probs))


def test_picks(skewed):
    pdf, df = skewed
    last = latest_per_key(df, ["g"], ["x", "id"]).toPandas().set_index("g")
    first = first_per_key(df, ["g"], ["id"]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert last.loc[g, "id"] == part.sort_values(["x", "id"]).id.iloc[-1]
        assert first.loc[g, "id"] == part.id.min()
    top = top_per_key(df, ["g"], [F.desc("x"), F.col("id")], 3)
    assert top.groupBy("g").count().where("count <> 3").count() == 0
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("digits", [1, 3])
def test_stratified_split_is_exact(spark, digits):
    df = spark.range(1, 1004).select(F.concat(F.lit("k"), "id").alias("customer_id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    out = stratified_split(df, "y", "customer_id", 0.2, digits=digits)
    sizes = {r.y: (r.n, r.t) for r in out.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()}
    assert out.count() == 1003
    for n, t in sizes.values():
        assert t == int(np.floor(n * 0.2 + 0.5))


def test_ranks_and_folds(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("customer_id"), (F.col("id") % 3).cast("int").alias("y"))
    ranks = stratum_rank(df, "y", "customer_id", 42, digits=2).toPandas()
    for _, part in ranks.groupby("y"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
    folds = stratified_folds(df, "y", "customer_id", 5).groupBy("y", "fold").count().toPandas()
    assert (folds.groupby("y")["count"].max() - folds.groupby("y")["count"].min()).max() <= 1


def test_deciles(spark, skewed):
    pdf, _ = skewed
    for n in (3000, 2999, 7):
        part = pdf.x.head(n).sort_values().to_numpy()
        tiles = np.array_split(part, 10) if n >= 10 else [[v] for v in part]
        got = H.score_deciles(spark.createDataFrame(pd.DataFrame({"churn_probability": part}))).toPandas()
        assert got.customer_count.tolist() == [len(t) for t in tiles]
        assert np.allclose(got.min_score, [round(min(t), 4) for t in tiles]) and np.allclose(got.max_score, [round(max(t), 4) for t in tiles])


def brute_psi(e, a, buckets=10):
    edges = np.quantile(e, np.linspace(0, 1, buckets + 1))[1:-1]
    edges = np.unique(np.concatenate([[-np.inf], edges, [np.inf]]))
    if len(edges) < 3:
        return 0.0
    ep, ap = (np.histogram(v, edges)[0] / max(len(v), 1) for v in (e, a))
    ep, ap = np.where(ep == 0, 1e-4, ep), np.where(ap == 0, 1e-4, ap)
    return round(float(np.sum((ap - ep) * np.log(ap / ep))), 4)


@pytest.mark.parametrize("kind", ["same", "shifted", "rare", "constant", "disjoint"])
def test_psi(spark, kind):
    e = RNG.normal(50, 10, 800).round(3)
    a = {"same": e, "shifted": RNG.normal(60, 10, 300).round(3), "rare": e, "constant": e, "disjoint": e + 1000}[kind]
    if kind == "rare":
        e, a = (RNG.random(800) < 0.05).astype(float), (RNG.random(300) < 0.5).astype(float)
    if kind == "constant":
        e, a = np.full(50, 3.0), np.full(20, 3.0)
    frames = [spark.createDataFrame(pd.DataFrame({"x": v})) for v in (e, a)]
    got = D.psi(*frames, "x").first().psi
    assert got == pytest.approx(brute_psi(e, a), abs=2e-4) and got >= 0
    if kind in ("same", "constant", "rare"):
        assert got == 0.0


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(x > neg).mean() + 0.5 * (x == neg).mean() for x in pos])


def test_auc_symmetry_and_confusion(spark):
    n = 600
    y = (RNG.random(n) < 0.3).astype(int)
    p = np.clip(0.3 * y + RNG.random(n).round(2) * 0.7, 0, 1).round(2)
    df = spark.createDataFrame(pd.DataFrame({"customer_id": [str(i) for i in range(n)], "churn_label": y, "churn_probability": p}))
    auc = E.evaluate(df).first().auc
    assert auc == pytest.approx(brute_auc(y, p), abs=1e-6)
    flipped = E.evaluate(df.withColumn("churn_probability", 1 - F.col("churn_probability"))).first().auc
    assert auc + flipped == pytest.approx(1.0, abs=1e-5)
    c = E.confusion(df).first()
    assert c.tn + c.fp + c.fn + c.tp == n
    roc = E.roc_curve(df).toPandas().sort_values(["fpr", "tpr"])
    assert (np.diff(roc.tpr) >= -1e-9).all() and roc.fpr.iloc[0] == 0 and roc.tpr.iloc[-1] == 1
    assert E.threshold_sweep(df).where("is_best").count() == 1


def test_similar_customers_brute_force(spark):
    n, k = 240, 3
    pdf = pd.DataFrame({
        "customer_id": [f"c{i:04d}" for i in range(n)], "risk_segment": np.where(np.arange(n) % 3 == 0, "High", RNG.choice(["Low", "Medium"], n)),
        "contract": RNG.choice(["A", "B"], n), "tenure": np.where(np.arange(n) % 3 == 0, 5, RNG.integers(0, 73, n)), "monthly_charges": RNG.random(n), "churn_probability": RNG.random(n),
    })
    got = J.similar_customers(spark.createDataFrame(pdf), k).toPandas()
    for _, r in pdf.iterrows():
        pool = pdf[(pdf.risk_segment == r.risk_segment) & (pdf.contract == r.contract) & (pdf.customer_id != r.customer_id)].copy()
        pool["d"] = (pool.tenure - r.tenure).abs()
        want = pool.sort_values(["d", "customer_id"]).customer_id.head(k).tolist()
        assert got[got.customer_id == r.customer_id].sort_values("rank").similar_id.tolist() == want


def test_value_terciles_need_distinct_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5)] * 5, "customer_id string, monthly_charges double, churn_probability double")
    with pytest.raises(Exception, match="Bin edges must be unique"):
        G.segment_by_value(df).collect()


def test_histogram_covers_all_rows(skewed):
    pdf, df = skewed
    h = S.histogram(df, "x", 30).toPandas()
    want, _ = np.histogram(pdf.x, 30)
    assert h.n.sum() == len(pdf) and h.bin.max() <= 29 and abs(h.n.max() - want.max()) <= 2
