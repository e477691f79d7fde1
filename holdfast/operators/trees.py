"""Path-dependent Shapley attributions for tree ensembles, in polynomial time.

A leaf is reached by tests on a few features. For the game "features in S are known" the leaf counts
value * prod(o_f for f in S) * prod(z_f otherwise), where o_f says whether the row passes all tests of
feature f on the path and z_f is the share of training weight that does. The weight of a coalition is
a Beta integral, so the Shapley value of f is

    value * (o_f - z_f) * integral over t in [0, 1] of prod over g != f of (t * o_g + (1 - t) * z_g).

The integrand is a polynomial of a degree below the number of features; Gauss-Legendre nodes, half as
many as features, integrate it exactly. Features off the path have o = z = 1 and drop out by themselves.

Which tests a row passes follows from where its values lie between the ensemble's thresholds. MLlib has fewer thresholds
of a feature than bins, so rows share few such cells; each cell is attributed once in a task, other rows look it up.
"""

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.util import MLWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.operators.modeling import FittedModel
from holdfast.sources.tables import work_dir

#: Numbers per block of the computation, 32 MB; cells that a task remembers.
_BLOCK = 4_000_000
_CELLS = 200_000


@dataclass(frozen=True)
class Leaves:
    """All leaves of an ensemble: bounds and share of training weight by feature, value, and the mean of the margin."""

    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray
    base: float

    def cuts(self) -> list[np.ndarray]:
        """The thresholds of each feature, ascending."""
        both = np.concatenate([self.low, self.high])
        return [np.unique(c[np.isfinite(c)]) for c in both.T]

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley value of each feature for each row of `x`; values are right where NaN has been filled."""
        return self.of_cells(cells_of(x, self.cuts()))

    def of_cells(self, cells: np.ndarray) -> np.ndarray:
        """The same by cells (see `cells_of`): which tests a row passes follows from its cells alone."""
        cuts, d = self.cuts(), cells.shape[1]
        out = np.zeros(cells.shape)
        nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
        # of each feature one value per cell; that of the last cell passes no test
        inside = [np.concatenate([c, [c[-1] + 1 if len(c) else 0.0, np.nan]]) for c in cuts]
        leaves = max(1, _BLOCK // (2 * d * max(map(len, inside))))
        for start in range(0, len(self.value), leaves):
            part = slice(start, start + leaves)
            passed = [(v[:, None] > self.low[None, part, f]) & (v[:, None] <= self.high[None, part, f]) for f, v in enumerate(inside)]
            rows = max(1, _BLOCK // len(self.value[part]))
            for t, w in zip((nodes + 1) / 2, weights / 2):
                each = [t * o + (1 - t) * self.share[part, f] for f, o in enumerate(passed)]
                owed = [w * self.value[part] * (o - self.share[part, f]) / e for f, (o, e) in enumerate(zip(passed, each))]
                for first in range(0, len(cells), rows):
                    own = cells[first : first + rows]
                    whole = each[0][own[:, 0]]
                    for f in range(1, d):
                        whole *= each[f][own[:, f]]
                    for f in range(d):
                        out[first : first + rows, f] += np.einsum("ij,ij->i", whole, owed[f][own[:, f]])
        return out


def cells_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """For each value the number of its feature's cuts below it; one more than there are cuts for what passes no test, NaN or minus infinity."""
    return np.stack([np.where(v > -np.inf, np.searchsorted(c, v), len(c) + 1) for v, c in zip(x.T, cuts)], axis=1)


def attributed(leaves: Leaves, batches: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The attributions of each batch; rows of the same cells are computed once in a task, the last `_CELLS` cells are remembered."""
    cuts, known = leaves.cuts(), {}
    for x in batches:
        cells, at = np.unique(cells_of(x, cuts), axis=0, return_inverse=True)
        names = [c.tobytes() for c in cells]
        new = [i for i, name in enumerate(names) if name not in known]
        found = dict(zip((names[i] for i in new), leaves.of_cells(cells[new]))) if new else {}
        yield np.array([known[name] if name in known else found[name] for name in names]).reshape(cells.shape)[at.ravel()]
        known = known | found if len(known) + len(found) <= _CELLS else found


def leaves_of(model: FittedModel, spark: SparkSession) -> Leaves:
    """Read the trees' node tables (their size is set by the training parameters) and follow every path."""
    c = model.classifier
    if not hasattr(c, "depth") and not hasattr(c, "treeWeights"):
        raise TypeError(f"{type(c).__name__} is no tree model")
    boosted = type(c).__name__.startswith("GBT")
    weights = [2.0 * w for w in c.treeWeights] if boosted else [1.0 / len(c.treeWeights)] * len(c.treeWeights) if hasattr(c, "treeWeights") else [1.0]
    path = f"{work_dir(spark)}/nodes/{uuid.uuid4().hex}"
    assert isinstance(c, MLWritable)
    c.write().save(path)
    table = spark.read.parquet(f"{path}/data")
    rows = table.select("treeID", "nodeData.*") if "nodeData" in table.columns else table.withColumn("treeID", F.lit(0))
    trees: dict[int, dict] = {}
    for r in rows.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", "split").collect():
        trees.setdefault(r.treeID, {})[r.id] = r
    d = len(K.MODEL_FEATURES)
    found: list[tuple] = []
    for t, nodes in sorted(trees.items()):

        def count(node) -> float:
            return node.impurityStats[0] if boosted else sum(node.impurityStats)

        todo = [(nodes[0], np.full(d, -np.inf), np.full(d, np.inf), np.ones(d))]
        while todo:
            node, low, high, share = todo.pop()
            if node.leftChild < 0:
                value = node.prediction if boosted else node.impurityStats[1] / sum(node.impurityStats)
                found.append((low, high, share, weights[t] * value))
                continue
            f, cut = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
            for child, bounds, side in ((nodes[node.leftChild], high, min), (nodes[node.rightChild], low, max)):
                new, part = bounds.copy(), share.copy()
                new[f] = side(new[f], cut)
                part[f] *= count(child) / count(node)
                todo.append((child, low, new, part) if side is min else (child, new, high, part))
    low, high, share, value = (np.array(x) for x in zip(*found))
    return Leaves(low, high, share, value, float((value * share.prod(axis=1)).sum()))


def _attribution(features: DataFrame, leaves: Leaves) -> Column:
    shipped = features.sparkSession.sparkContext.broadcast(leaves)

    @F.pandas_udf("array<double>")
    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for found in attributed(shipped.value, (x.to_numpy(dtype=float) for x in batches)):
            yield pd.Series(list(found))

    return attribute(F.struct(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(K.MODEL_FEATURES)]))


def with_factors(features: DataFrame, model: FittedModel, digits: int | None = None) -> DataFrame:
    """Add `base_value` and `factors`: one entry per feature, strongest first, ties by feature order.

    On the model margin: the log-odds for boosting, the probability for a tree or forest; base value
    plus contributions equals it.
    """
    leaves = leaves_of(model, features.sparkSession)
    rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    out = features.withColumn("_phi", _attribution(features, leaves))
    entries = []
    for i, f in enumerate(K.MODEL_FEATURES):
        value = rounded(F.col("_phi")[i])
        direction = F.when(value > 0, F.lit("increases risk")).otherwise(F.lit("decreases risk"))
        entries.append(F.struct(
            (-F.abs(value)).alias("k"), F.lit(i).alias("i"), F.lit(f).alias("feature"), rounded(F.col(f"`{f}`").cast("double")).alias("feature_value"),
            value.alias("shap_value"), direction.alias("direction")))
    ordered = F.transform(F.array_sort(F.array(*entries)), lambda e: e.dropFields("k", "i"))
    return out.withColumns({"base_value": rounded(F.lit(leaves.base)), "factors": ordered}).drop("_phi")


def explain_trees(features: DataFrame, model: FittedModel) -> DataFrame:
    """(customer, base value, rank, feature, value, contribution, direction) for every customer."""
    rows = with_factors(features, model).select("customer_id", "base_value", F.posexplode("factors").alias("_place", "_e"))
    return rows.select("customer_id", "base_value", (F.col("_place") + 1).alias("rank"), "_e.*")
