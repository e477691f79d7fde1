"""Fitted models beside the tables, one folder per registry entry (model name and version).

A folder is written completely before the registry row that names it is committed, so every model
that the registry knows can be loaded.
"""

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from holdfast.operators.modeling import Ensemble, FittedModel
from holdfast.operators.scoring import LinearScorer
from holdfast.sources.tables import TableStore

Fitted = FittedModel | Ensemble | LinearScorer


class NoActiveModel(RuntimeError):
    """The registry holds no active model."""


def _path(store: TableStore, name: str, version: str) -> str:
    return f"{store.base}/models/{name}/{version}"


def _describe(model: Fitted) -> dict:
    if isinstance(model, LinearScorer):
        return {"kind": "scorecard", "intercept": model.intercept, "coefficients": dict(model.coefficients)}
    if isinstance(model, Ensemble):
        return {"kind": "ensemble", "members": [{"name": m.name, "version": m.version, **_describe(m)} for m in model.members]}
    return {"kind": "pipeline"}


def _save_pipelines(model: Fitted, path: str) -> None:
    if isinstance(model, Ensemble):
        for i, member in enumerate(model.members):
            _save_pipelines(member, f"{path}/member_{i}")
    elif isinstance(model, FittedModel):
        model.pipeline.write().overwrite().save(f"{path}/pipeline")


def save(store: TableStore, model: Fitted) -> str:
    """Write the model (of a search its best pipeline); returns its folder."""
    path = _path(store, model.name, model.version)
    _save_pipelines(model, path)
    text = json.dumps(_describe(model), sort_keys=True)
    store.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
    return path


def _build(store: TableStore, what: dict, name: str, version: str, path: str) -> Fitted:
    if what["kind"] == "scorecard":
        return LinearScorer(name, version, what["intercept"], what["coefficients"])
    if what["kind"] == "ensemble":
        return Ensemble(name, version, tuple(_build(store, m, m["name"], m["version"], f"{path}/member_{i}") for i, m in enumerate(what["members"])))
    return FittedModel(name, version, PipelineModel.load(f"{path}/pipeline"))


def load(store: TableStore, name: str, version: str) -> Fitted:
    path = _path(store, name, version)
    return _build(store, json.loads(store.spark.read.text(f"{path}/model").first().value), name, version, path)


def load_active(store: TableStore, registry: DataFrame | None = None) -> Fitted:
    """The model of the active registry row; an error when there is none."""
    rows = store.snapshot("model_registry") if registry is None else registry
    row = rows.where("is_active").orderBy("id").first()
    if row is None:
        raise NoActiveModel("No active model found in model_registry.")
    return load(store, row.model_name, row.model_version)
