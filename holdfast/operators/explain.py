"""Attributions, drivers, explanation texts, what-if scenarios for fitted models over whole tables.

For a scorecard the Shapley value of a feature on the logit is coef * (x - mean x), so an
attribution is a set of columns; a fitted logistic regression is read as one. Tree models, single,
forest or boosted, are in `trees`.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.functions import risk as R
from holdfast.functions.lookups import lookup
from holdfast.functions.rounding import exact_avg, half_up
from holdfast.operators import trees
from holdfast.operators.features import model_features
from holdfast.operators.scoring import LinearScorer
from holdfast.plans.pick import top_per_key

DIGITS = 6


def feature_means(features: DataFrame, model: LinearScorer) -> Column:
    """Mean of every model input as a one-value struct subquery."""
    return features.agg(F.struct(*[F.avg(F.col(f"`{f}`")).alias(f) for f, _ in model.terms()])).scalar()


def _contributions(features: DataFrame, model: LinearScorer) -> tuple[DataFrame, list[str], list[Column]]:
    """(frame with value, contribution and rank columns per feature, those columns, factor structs).

    A feature's rank is one more than the number of stronger features (ties by feature order). The
    feature list is short, so comparing it with itself inside generated code beats sorting an array.
    """
    terms = model.terms()
    out = features.withColumn("_means", feature_means(features, model))

    def mean(f: str) -> Column:
        return F.col("_means").getField(f)

    base = F.lit(float(model.intercept))
    for f, coef in terms:
        base = base + F.lit(float(coef)) * mean(f)
    added = {f"_v{i}": F.round(F.lit(float(coef)) * (F.col(f"`{f}`") - mean(f)), DIGITS) for i, (f, coef) in enumerate(terms)}
    added |= {f"_x{i}": F.round(F.col(f"`{f}`").cast("double"), DIGITS) for i, (f, _) in enumerate(terms)}
    out = out.withColumns({**added, "base_value": F.round(base, DIGITS)}).drop("_means")
    ranks = {}
    for i in range(len(terms)):
        mine, rank = F.abs(f"_v{i}"), F.lit(1)
        for j in range(len(terms)):
            if j != i:
                other = F.abs(f"_v{j}")
                rank = rank + (other >= mine if j < i else other > mine).cast("int")
        ranks[f"_r{i}"] = rank
    out = out.withColumns(ranks)
    structs = []
    for i, (f, _) in enumerate(terms):
        direction = F.when(F.col(f"_v{i}") > 0, F.lit("increases risk")).otherwise(F.lit("decreases risk"))
        structs.append(F.struct(
            F.col(f"_r{i}").alias("rank"), F.lit(f).alias("feature"), F.col(f"_x{i}").alias("feature_value"),
            F.col(f"_v{i}").alias("shap_value"), direction.alias("direction"),
        ))
    return out, [*added, *ranks], structs


def as_scorer(model) -> LinearScorer | None:
    """The scorecard that a model is or amounts to; None for tree models."""
    if isinstance(model, LinearScorer):
        return model
    c = model.classifier
    if not hasattr(c, "coefficients"):
        return None
    return LinearScorer(model.name, model.version, float(c.intercept), dict(zip(K.MODEL_FEATURES, map(float, c.coefficients.toArray()))))


def with_factors(features: DataFrame, model) -> DataFrame:
    """Add `base_value` and `factors`: one entry per feature, strongest first, for any fitted model."""
    card = as_scorer(model)
    return _card_factors(features, card) if card else trees.with_factors(features, model, DIGITS)


def _card_factors(features: DataFrame, model: LinearScorer) -> DataFrame:
    out, helpers, structs = _contributions(features, model)
    ordered = F.transform(F.array_sort(F.array(*structs)), lambda e: e.dropFields("rank"))
    return out.withColumn("factors", ordered).drop(*helpers)


def explain(rc: DataFrame, model, keep: Sequence[str] = ("customer_id",)) -> DataFrame:
    """(customer, base value, rank, feature, value, contribution, direction) for every customer."""
    card = as_scorer(model)
    if card is None:
        rows = trees.with_factors(model_features(rc), model, DIGITS).select(*keep, "base_value", F.posexplode("factors").alias("_place", "_e"))
        return rows.select(*keep, "base_value", (F.col("_place") + 1).alias("rank"), "_e.*")
    out, _, structs = _contributions(model_features(rc), card)
    return out.select(*keep, "base_value", F.inline(F.array(*structs)))


def _mean_abs(features: DataFrame, model: LinearScorer) -> Column:
    """Array of (feature, mean |contribution|) as an aggregate expression; needs `_means`."""
    entries = []
    for f, coef in model.terms():
        value = F.abs(F.round(F.lit(float(coef)) * (F.col(f"`{f}`") - F.col("_means").getField(f)), DIGITS))
        entries.append(F.struct(F.lit(f).alias("feature"), half_up(F.avg(value), DIGITS).alias("mean_abs_shap")))
    return F.array(*entries)


def _mean_abs_of_factors(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same from rows with `factors`: (by..., feature, mean |contribution|)."""
    long = rows.select(*by, F.inline("factors"))
    return long.groupBy(*by, "feature").agg(half_up(exact_avg(F.abs("shap_value")), DIGITS).alias("mean_abs_shap"))


def top_drivers(rc: DataFrame, model, n: int = 10) -> DataFrame:
    """Features by mean |contribution|; for a scorecard from one aggregate row."""
    features, card = model_features(rc), as_scorer(model)
    if card is None:
        means = _mean_abs_of_factors(with_factors(features, model))
    else:
        rows = features.withColumn("_means", feature_means(features, card))
        means = rows.agg(_mean_abs(rows, card).alias("e")).select(F.inline("e"))
    return means.orderBy(F.desc("mean_abs_shap"), "feature").limit(n)


def drivers_by_segment(rc: DataFrame, cp: DataFrame, model, n: int = 5) -> DataFrame:
    """The n strongest features of each risk segment; contributions are against the whole population."""
    features, card = model_features(rc), as_scorer(model)
    segments = cp.select("customer_id", "risk_segment")
    if card is None:
        per_segment = _mean_abs_of_factors(with_factors(features, model).join(segments, "customer_id"), ["risk_segment"])
    else:
        rows = features.withColumn("_means", feature_means(features, card)).join(segments, "customer_id")
        per_segment = rows.groupBy("risk_segment").agg(_mean_abs(rows, card).alias("e")).select("risk_segment", F.inline("e"))
    return top_per_key(per_segment, ["risk_segment"], [F.desc("mean_abs_shap"), F.col("feature")], n)


def actionable_insights(drivers: DataFrame) -> DataFrame:
    """A recommendation per driver; features without one get the default text."""
    return drivers.withColumn("insight", lookup(F.col("feature"), K.DRIVER_INSIGHTS, K.DEFAULT_INSIGHT))


def factor_sentence(factors: Column) -> Column:
    """'a (…), b (…), and c (…)' over the top factors."""
    said = F.transform(factors, lambda f: F.concat(F.replace(f["feature"], F.lit("_"), F.lit(" ")), F.lit(" ("), f["direction"], F.lit(")")))
    n = F.size(factors)
    several = F.concat(F.array_join(F.slice(said, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(said, -1))
    listed = F.when(n == 1, F.array_join(said, "")).otherwise(several)
    text = F.concat(F.lit("The top factors influencing this prediction are "), listed, F.lit("."))
    return F.when(n == 0, F.lit("No contributing factors were provided.")).otherwise(text)


def explanation_text(rc: DataFrame, model, n: int = 5) -> DataFrame:
    """One sentence per customer from the n strongest factors."""
    rows = with_factors(model_features(rc), model).withColumn("top", F.slice("factors", 1, n))
    return rows.select("customer_id", factor_sentence(F.col("top")).alias("explanation"))


def template_explanation(rc: DataFrame, model) -> DataFrame:
    """The short template text: segment, probability and three strongest factors."""
    rows = with_factors(model.transform(model_features(rc)), model)
    p = F.col("churn_probability")
    names = [F.replace(F.col("factors")[i]["feature"], F.lit("_"), F.lit(" ")) for i in range(3)]
    text = F.concat(
        F.lit("This customer has a "), F.lower(R.risk_segment(p)), F.lit(" churn risk ("), F.format_string("%.0f%%", half_up(p * 100, 0)),
        F.lit(" probability), driven mainly by "), names[0], F.lit(", "), names[1], F.lit(", and "), names[2], F.lit("."),
    )
    return rows.select("customer_id", text.alias("explanation"))


# --- what-if -------------------------------------------------------------------


@dataclass(frozen=True)
class Scenario:
    """A hypothetical change: replaced columns and a factor on both charges."""

    name: str
    replace: tuple[tuple[str, str], ...] = ()
    charge_factor: float = 1.0


def contract_change(contract: str = "One year") -> Scenario:
    return Scenario(f"Switch to {contract} contract", (("contract", contract),))


def add_security() -> Scenario:
    return Scenario("Add online security", (("online_security", "Yes"),))


def reduce_charges(percent: float = 10.0) -> Scenario:
    return Scenario(f"Reduce charges by {percent:.0f}%", charge_factor=1 - percent / 100.0)


DEFAULT_SCENARIOS = (contract_change("One year"), add_security(), reduce_charges(10.0))


def what_if(rc: DataFrame, model, scenarios: Sequence[Scenario] = DEFAULT_SCENARIOS) -> DataFrame:
    """Every customer under every scenario: old and new probability, change and segments.

    The scenario list is exploded in the row (no join); features are derived again and scored once.
    The score does not read monthly charges, so a price cut works through total charges.
    """
    base = model.transform(model_features(rc)).select(*rc.columns, F.col("churn_probability").alias("_p0"))
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s.name).alias("scenario")) for i, s in enumerate(scenarios)])
    rows = base.select("*", F.inline(names))

    def changed(column: str, options: dict[int, Column]) -> Column:
        out = F
        for i, value in options.items():
            out = out.when(F.col("i") == i, value)
        return out.otherwise(F.col(column)) if options else F.col(column)

    replaced: dict[str, dict[int, Column]] = {}
    for i, s in enumerate(scenarios):
        for column, value in s.replace:
            replaced.setdefault(column, {})[i] = F.lit(value)
        if s.charge_factor != 1.0:
            for column in ("total_charges", "monthly_charges"):
                replaced.setdefault(column, {})[i] = F.col(column) * F.lit(s.charge_factor)
    altered = rows.withColumns({c: changed(c, options) for c, options in replaced.items()})
    old, new = F.col("_p0"), F.col("churn_probability")
    return model.transform(model_features(altered)).select(
        "customer_id", "scenario", half_up(old, 4).alias("original_probability"), half_up(new, 4).alias("new_probability"),
        half_up(new - old, 4).alias("probability_change"), R.risk_segment(old).alias("original_segment"), R.risk_segment(new).alias("new_segment"),
    )


def scenario_advice(results: DataFrame) -> DataFrame:
    """What a scenario result suggests: segment change, clear, modest or no effect."""
    moved = F.concat(F.lit("Strong lever — this alone would move the customer from "), F.col("original_segment"), F.lit(" to "), F.col("new_segment"), F.lit(" risk."))
    change = F.col("probability_change")
    text = (
        F.when(F.col("new_segment") != F.col("original_segment"), moved)
        .when(change <= -0.05, F.lit("Meaningful risk reduction — worth pursuing alongside other retention actions."))
        .when(change < 0, F.lit("Modest effect on its own — likely needs to be combined with other actions."))
        .otherwise(F.lit("Minimal or no effect for this customer — consider a different lever."))
    )
    return results.withColumn("advice", text)


# --- full prediction record ------------------------------------------------------


def predict_records(rc: DataFrame, model, now: Column, n: int = 5) -> DataFrame:
    """Probability, segment, top factors (array of structs), actions, version and time per input row."""
    rows = with_factors(model.transform(model_features(rc)), model)
    segment = R.risk_segment(F.col("churn_probability"))
    factors = F.transform(F.slice("factors", 1, n), lambda f: f.dropFields("feature_value"))
    return rows.select(
        F.coalesce("customer_id", F.lit("UNSPECIFIED")).alias("customer_id"), "churn_probability", segment.alias("risk_segment"),
        factors.alias("top_risk_factors"), R.retention_actions(segment).alias("recommended_actions"),
        F.lit(model.model_version).alias("model_version"), now.alias("predicted_at"),
    )
