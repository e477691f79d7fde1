"""Preprocessing, training, tuning and cross-validation with MLlib."""

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.operators import search
from holdfast.operators.evaluation import evaluate, summarize_folds
from holdfast.plans.kept import kept
from holdfast.plans.strata import stratified_folds
from holdfast.sources.tables import ensure_checkpoint_dir, work_dir

LABEL = "churn_label"
SEED = 42

# fixed search spaces, with the nearest MLlib parameters (it has no least size of a node to be split)
FOREST_GRID = {"numTrees": [100, 200, 300], "maxDepth": [3, 5, 7, 30], "minInstancesPerNode": [1, 2, 4]}
BOOSTING_GRID = {"maxIter": [100, 200, 300], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1, 0.2], "subsamplingRate": [0.8, 1.0], "featureSubsetStrategy": ["0.8", "all"]}
BOOSTING_DISTRIBUTIONS = {
    "maxIter": [100, 200, 300, 400], "maxDepth": [3, 4, 5, 6, 7], "stepSize": [0.01, 0.03, 0.05, 0.1, 0.15, 0.2],
    "subsamplingRate": [0.7, 0.8, 0.9, 1.0], "featureSubsetStrategy": ["0.7", "0.8", "0.9", "all"], "minInstancesPerNode": [1, 3, 5], "minInfoGain": [0.0, 0.1, 0.3],
}


# --- preprocessing -------------------------------------------------------------


def fit_preprocessor(df: DataFrame, numerics: Sequence[str] = K.NUMERIC_COLUMNS, categories: Sequence[str] = K.CATEGORICAL_COLUMNS) -> PipelineModel:
    """Median imputation and scaling of numerics, mode imputation and one-hot of categories.

    A level that was not seen in training becomes all zeros. The fitted model saves and loads as any
    MLlib pipeline. The scaler divides by the sample deviation.
    """
    # counted by (column, level), which combines on the map side; ties go to the smaller level
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("level")) for c in categories])
    levels = df.select(F.inline(pairs)).where("level is not null").groupBy("c", "level").agg(F.count("*").alias("n"))
    modes = {r.c: r.level for r in levels.groupBy("c").agg(F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("level")).collect()}

    def quoted(c: str) -> str:
        return "'" + str(modes.get(c)).replace("'", "''") + "'"

    filled = ", ".join(f"coalesce(`{c}`, {quoted(c)}) AS `{c}_filled`" for c in categories)
    numbers = ", ".join(f"cast(`{c}` AS double) AS `{c}_num`" for c in numerics)
    stages = [
        SQLTransformer(statement=f"SELECT *, {filled}, {numbers} FROM __THIS__"),
        Imputer(strategy="median", relativeError=0.0001, inputCols=[f"{c}_num" for c in numerics], outputCols=[f"{c}_imputed" for c in numerics]),
        VectorAssembler(inputCols=[f"{c}_imputed" for c in numerics], outputCol="numeric_vector"),
        StandardScaler(inputCol="numeric_vector", outputCol="numeric_scaled", withMean=True, withStd=True),
        StringIndexer(inputCols=[f"{c}_filled" for c in categories], outputCols=[f"{c}_index" for c in categories], handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"{c}_index" for c in categories], outputCols=[f"{c}_onehot" for c in categories]),
        VectorAssembler(inputCols=["numeric_scaled", *[f"{c}_onehot" for c in categories]], outputCol="prepared"),
    ]
    return Pipeline(stages=stages).fit(df)


# --- models --------------------------------------------------------------------


@dataclass(frozen=True)
class FittedModel:
    """A trained pipeline with the scorer interface; of a search also its table of candidates."""

    name: str
    version: str
    pipeline: PipelineModel
    found: DataFrame | None = field(default=None, compare=False)

    @property
    def model_version(self) -> str:
        return f"{self.name}_{self.version}"

    @property
    def classifier(self) -> Model:
        return self.pipeline.stages[-1]

    def transform(self, features: DataFrame) -> DataFrame:
        out = self.pipeline.transform(features)
        return out.withColumn("churn_probability", vector_to_array("probability")[1]).select(*features.columns, "churn_probability")


@dataclass(frozen=True)
class Ensemble:
    """Soft vote of fitted models."""

    name: str
    version: str
    members: tuple

    @property
    def model_version(self) -> str:
        return f"{self.name}_{self.version}"

    def transform(self, features: DataFrame) -> DataFrame:
        out, votes = features, []
        for i, member in enumerate(self.members):
            out = member.transform(out).withColumnRenamed("churn_probability", f"_vote{i}")
            votes.append(F.col(f"_vote{i}"))
        mean = sum(votes[1:], votes[0]) / len(votes)
        return out.withColumn("churn_probability", mean).select(*features.columns, "churn_probability")


def _pipeline(classifier: Estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(K.MODEL_FEATURES), outputCol="model_vector"), classifier])


#: Training rows of a partition: so many make one worth while, and so many at most (on average).
PART_ROWS, MOST_PART_ROWS = 2_000, 500_000


def spread(train: DataFrame) -> DataFrame:
    """What a learner reads of `train`, derived once and dealt evenly over the cluster's cores.

    Learners pass over the rows hundreds of times, in as many tasks as there are partitions; a join's result has few.
    """
    n = train.count()
    parts = max(min(train.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS)), -(-n // MOST_PART_ROWS), 1)
    ensure_checkpoint_dir(train.sparkSession)
    return train.select(*[F.col(f"`{c}`") for c in (*K.MODEL_FEATURES, LABEL, "weight") if c in train.columns]).repartition(parts).checkpoint()


def _fit(name: str, classifier: Estimator, train: DataFrame, version: str = "v1") -> FittedModel:
    return FittedModel(name, version, _pipeline(classifier).fit(spread(train)))


_COLS = {"featuresCol": "model_vector", "labelCol": LABEL}
# a level of a forest looks up where its rows stand instead of walking every row down every tree again; the trees are the same
_OWN = {"forest": {"cacheNodeIds": True}, "boosting": {}}


def with_balanced_weight(train: DataFrame) -> DataFrame:
    """Add `weight` = n / (2 * n of the class), the usual class balancing."""
    sizes = train.agg(F.struct(F.count("*").alias("n"), F.sum(LABEL).alias("pos"))).scalar()
    of_class = F.when(F.col(LABEL) == 1, sizes.getField("pos")).otherwise(sizes.getField("n") - sizes.getField("pos"))
    return train.withColumn("weight", sizes.getField("n") / (2.0 * of_class))


def fit_logistic(train: DataFrame, max_iter: int = 1000) -> FittedModel:
    """L2 logistic regression; the penalty 1/n equals a unit penalty on the summed loss."""
    lr = LogisticRegression(**_COLS, maxIter=max_iter, regParam=1.0 / max(train.count(), 1), standardization=False)
    return _fit("logistic_regression", lr, train)


def fit_tree(train: DataFrame, depth: int = 5) -> FittedModel:
    return _fit("decision_tree", DecisionTreeClassifier(**_COLS, maxDepth=depth, seed=SEED), train)


def fit_forest(train: DataFrame, trees: int = 100, depth: int = 30) -> FittedModel:
    """Random forest, grown as deep as MLlib allows (30 levels) unless told otherwise."""
    return _fit("random_forest", RandomForestClassifier(**_COLS, **_OWN["forest"], numTrees=trees, maxDepth=depth, seed=SEED), train)


def fit_gbt(train: DataFrame, rounds: int = 100, depth: int = 5, step: float = 0.1, balanced: bool = False) -> FittedModel:
    """Gradient boosting; the balanced variant weights the classes equally."""
    gbt = GBTClassifier(**_COLS, maxIter=rounds, maxDepth=depth, stepSize=step, seed=SEED)
    if balanced:
        return _fit("boosting_balanced", gbt.setWeightCol("weight"), with_balanced_weight(train))
    return _fit("boosting", gbt, train)


def fit_balanced(train: DataFrame) -> FittedModel:
    """The balanced preset: twice the rounds at half the step, classes weighted equally."""
    return fit_gbt(train, rounds=200, step=0.05, balanced=True)


def fit_ensemble(train: DataFrame, boosting=None, balanced=None, forest=None) -> Ensemble:
    """Soft vote of tuned boosting, balanced boosting and a tuned forest; fitted members may be passed in."""
    return Ensemble("ensemble", "v1", (boosting or tune_boosting(train), balanced or fit_balanced(train), forest or tune_forest(train)))


# --- tuning --------------------------------------------------------------------


_LEARNERS = {"forest": (RandomForestClassifier, RandomForestClassificationModel, "DecisionTreeClassificationModel"), "boosting": (GBTClassifier, GBTClassificationModel, "DecisionTreeRegressionModel")}


def tune(name: str, kind: str, candidates: Sequence[dict], train: DataFrame, version: str = "v2", folds: int = 5, seed: int = SEED) -> FittedModel:
    """Best candidate by mean AUC over stratified folds (see `search.search`), fitted to all of `train`.

    `kind` is "forest" or "boosting"; the model's `found` holds the result of every candidate. The rows are counted once
    for the search and the fit: MLlib's learners start a job for every level of a tree, thousands for hundreds of rounds.
    """
    spark, cells = train.sparkSession, search.counted(train, folds, seed=seed)
    if cells.skipped or not cells.whole.learned.any():
        raise ValueError(f"the model cannot be fitted: {cells.skipped} rows have a null label or feature, {cells.whole.learned.sum()} have none")
    rows = search.searched(spark, cells, kind, candidates, seed)
    found = spark.createDataFrame(rows.collect(), rows.schema)  # one row per candidate
    best = search.best_of(found, candidates)
    classifier = assembled(spark, kind, best, search.grown(spark, cells.whole, kind, best, seed), seed)
    return FittedModel(name, version, PipelineModel([VectorAssembler(inputCols=list(K.MODEL_FEATURES), outputCol="model_vector"), classifier]), found)


#: Trees that are read into the driver at a time: MLlib collects them, and what a read holds besides the model goes before the next.
_READ = 20


def assembled(spark: SparkSession, kind: str, params: dict, nodes: DataFrame, seed: int = SEED) -> Model:
    """MLlib's model of the trees that `search.grown` gives, read from files in the form in which MLlib stores its own."""
    learner, model, tree = _LEARNERS[kind]
    estimator = learner(**_COLS, **_OWN[kind], seed=seed, **params)
    own, defaults = ({p.name: v for p, v in m.items()} for m in (estimator._paramMap, estimator._defaultParamMap))
    trees, package = params[search.LENGTH[kind]], "org.apache.spark.ml"
    path, package_of_tree = f"{work_dir(spark)}/fitted/{uuid.uuid4().hex}", "classification" if kind == "forest" else "regression"
    is_leaf = F.col("left") < 0
    split = F.struct(
        F.col("feature").alias("featureIndex"), F.when(is_leaf, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    node = F.struct("id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("n").alias("rawCount"), "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"))
    nodes = kept(nodes.select("tree", node.alias("nodeData")))

    def metadata(name: str, uid: str, own: dict, defaults: dict, **more) -> str:
        return json.dumps({"class": f"{package}.{name}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid, "paramMap": own, "defaultParamMap": defaults, **more})

    def read(first: int, n: int) -> Model:
        """The model of `n` trees from `first` on."""
        at, classes = f"{path}/{first}", {"numClasses": 2} if kind == "forest" else {}
        whole = metadata(f"classification.{model.__name__}", estimator.uid, own, defaults, numFeatures=len(K.MODEL_FEATURES), numTrees=n, **classes)
        spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{at}/metadata")
        each = [(i, metadata(f"{package_of_tree}.{tree}", f"{estimator.uid}_{first + i}", {"featuresCol": "model_vector"}, {}), search.tree_weight(kind, params, first + i)) for i in range(n)]
        spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{at}/treesMetadata")
        nodes.where(F.col("tree").between(first, first + n - 1)).select((F.col("tree") - first).alias("treeID"), "nodeData").write.parquet(f"{at}/data")
        return model.load(at)

    if kind != "forest":
        return read(0, trees)
    jvm = getattr(spark._jvm, package).classification
    joined = spark.sparkContext._gateway.new_array(getattr(jvm, tree), trees)
    for first in range(0, trees, _READ):
        for i, one in enumerate(read(first, min(_READ, trees - first))._java_obj.trees()):
            joined[first + i] = one
    out = estimator._copyValues(model(jvm.RandomForestClassificationModel(estimator.uid, joined, len(K.MODEL_FEATURES), 2)))
    out._transfer_params_to_java()
    return out


def tune_forest(train: DataFrame, grid: Mapping[str, Sequence] = FOREST_GRID, **options) -> FittedModel:
    return tune("random_forest_tuned", "forest", search.grid_candidates(grid), train, **options)


def tune_boosting(train: DataFrame, grid: Mapping[str, Sequence] = BOOSTING_GRID, **options) -> FittedModel:
    return tune("boosting_tuned", "boosting", search.grid_candidates(grid), train, **options)


def random_search(train: DataFrame, distributions: Mapping[str, Sequence] = BOOSTING_DISTRIBUTIONS, draws: int = 50, seed: int = SEED, **options) -> FittedModel:
    """Best of `draws` seeded parameter draws for gradient boosting (distinct while there are enough)."""
    return tune("boosting_challenger", "boosting", search.random_candidates(distributions, draws, seed), train, **options)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


# --- evaluation ------------------------------------------------------------------


def score_with(models: Sequence, features: DataFrame) -> DataFrame:
    """Long scores (model_name, model_version, id, label, probability) of several fitted models."""
    frames = [
        m.transform(features).select(F.lit(m.name).alias("model_name"), F.lit(m.version).alias("model_version"), "customer_id", LABEL, "churn_probability") for m in models
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def dealt_folds(features: DataFrame, folds: int = 5) -> DataFrame:
    """The features with their fold, computed once and written to the shared checkpoint folder."""
    ensure_checkpoint_dir(features.sparkSession)
    return stratified_folds(features, LABEL, "customer_id", folds, SEED).checkpoint()


def cross_validate_all(features: DataFrame, fits: Mapping[str, object], folds: int = 5) -> DataFrame:
    """Mean and deviation of every metric for each named `fit`, over the same folds."""
    dealt, out = dealt_folds(features, folds), None
    for name, fit in fits.items():
        rows = summarize_folds(cross_validate(features, fit, folds, dealt)).select(F.lit(name).alias("model_name"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def cross_validate(features: DataFrame, fit, folds: int = 5, dealt: DataFrame | None = None) -> DataFrame:
    """Metrics per fold: `fit(train)` on the other folds, scores on the left-out one."""
    dealt = dealt_folds(features, folds) if dealt is None else dealt
    scored = None
    for i in range(folds):
        model = fit(dealt.where(F.col("fold") != i))
        part = model.transform(dealt.where(F.col("fold") == i)).select("fold", "customer_id", LABEL, "churn_probability")
        scored = part if scored is None else scored.unionByName(part)
    return evaluate(scored, ["fold"])


def feature_importances(model: FittedModel) -> DataFrame:
    """(feature, importance): tree importances, or |coefficient| of a linear model."""
    c = model.classifier
    values = c.featureImportances.toArray() if hasattr(c, "featureImportances") else [abs(v) for v in c.coefficients.toArray()]
    rows = [(f, float(v)) for f, v in zip(K.MODEL_FEATURES, values)]
    return _session().createDataFrame(rows, "feature string, importance double")


def importance_drift(models: Sequence[FittedModel]) -> DataFrame:
    """One row per feature, one column per model."""
    out = None
    for m in models:
        frame = feature_importances(m).withColumnRenamed("importance", m.model_version)
        out = frame if out is None else out.join(F.broadcast(frame), "feature")  # one row per feature
    return out
