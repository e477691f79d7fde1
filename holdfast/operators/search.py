"""Whole parameter searches by prefix evaluation: the longest model of a group also gives the scores of the shorter ones.

A boosted model of 300 rounds holds those of 100 and 200 rounds, a forest of 300 trees those of 100 and 200. Candidates
that differ in nothing but that number form a group; each group is fitted once per fold at its largest number, and the
left-out fold is scored at every asked number on the way. Fits (group x fold) are dealt over the cluster, one row each.

Every candidate learns from all labelled rows outside its fold and is scored on all rows of it. A learner reads nothing
of a row but its bins and label, so the tasks count the rows of each cell (equal bins and label) and the fits work on the
counts. The cuts are exact quantiles of the learned rows. At most 32 bins a feature bound the cells: the model features
(one of money, the others levels and scores) have about 21,000 for each fold, however many rows there are.

The learner follows MLlib's definitions: quantile bins, variance or Gini gain, a Poisson bag and a random choice of
features at every node for forests, rounds on the gradient of the log loss for boosting. The draws of a cell's n rows
sum to Poisson(n) in a bag and to Binomial(n, rate) in a subsample, so a cell draws once. Randomness is seeded by the
number of the tree, so a prefix is exactly the model that a separate fit gives.
"""

import itertools
import json
import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.plans.kept import kept
from holdfast.plans.ordered import running_totals
from holdfast.plans.strata import stratified_folds, stratum_rank

BINS = 32
LENGTH = {"forest": "numTrees", "boosting": "maxIter"}


@dataclass(frozen=True)
class Cells:
    """The cells of one model: its cuts by feature; bins and label of each cell, how many of its rows are learned and how many left out."""

    cuts: list[np.ndarray]
    codes: np.ndarray
    label: np.ndarray
    learned: np.ndarray
    out: np.ndarray


@dataclass(frozen=True)
class Counted:
    """All rows as cells: `folds[f]` leaves fold f out, `whole` learns from every row. `skipped` rows have a null label or feature."""

    folds: list[Cells]
    whole: Cells
    skipped: int


def counted(train: DataFrame, folds: int = 5, label: str = "churn_label", key: str = "customer_id", features: Sequence[str] = K.MODEL_FEATURES, seed: int = 42, bins: int = BINS) -> Counted:
    """Every row of `train` in stratified folds, counted by cells. Rows with a null label or feature take no part, those without a key are in no fold."""
    names = [f"x{i}" for i in range(len(features))]
    given = kept(train.select(F.col(key).alias("key"), F.col(label).alias("y"), *[F.col(f"`{f}`").cast("double").alias(x) for f, x in zip(features, names)]))
    whole = given.dropna(subset=["y", *names])
    dealt = stratified_folds(whole.dropna(subset=["key"]), "y", "key", folds, seed).unionByName(whole.where("key is null").withColumn("fold", F.lit(-1)))
    dealt = kept(dealt.select("fold", F.col("y").cast("int").alias("y"), *names))
    found = _counts(dealt, names, learned_cuts(dealt, names, folds, bins))
    return Counted(found[:folds], found[folds], given.count() - int(found[folds].learned.sum()))


def learned_cuts(dealt: DataFrame, names: Sequence[str], folds: int, bins: int = BINS) -> list[list[np.ndarray]]:
    """What `binned` cuts at, by model (each fold left out, then none) and feature, of all rows of `dealt` (fold, y, features)."""
    models = range(folds + 1)
    long = dealt.select("fold", F.posexplode(F.array(*names)).alias("feature", "value"))
    learns = [(F.col("fold") >= 0) & (F.col("fold") != m) for m in range(folds)] + [F.lit(True)]
    counts = long.groupBy("feature", "value").agg(*[F.count_if(c).alias(f"n{m}") for m, c in zip(models, learns)])
    spans = running_totals(counts, "value", [f"n{m}" for m in models], ["feature"])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"n{m}").alias("n"), F.col(f"n{m}_upto").alias("upto"), F.col(f"n{m}_total").alias("total")) for m in models]))
    spans = spans.select("feature", "value", each.alias("_m")).select("feature", "value", "_m.*").where("n > 0")
    distinct = {(r.model, r.feature): r.n for r in spans.groupBy("model", "feature").agg(F.count("*").alias("n")).collect()}  # models x features
    few = [m * len(names) + f for (m, f), n in distinct.items() if n <= bins]
    # the least k from 1 on whose place k * total div bins is not below this value's rows, and the greatest within them
    first = F.greatest(F.lit(1), F.expr(f"(({bins} * (upto - n)) + total - 1) div total"))
    last = F.least(F.lit(bins - 1), F.expr(f"(({bins} * upto) + total - 1) div total - 1"))
    kind = F.col("model") * len(names) + F.col("feature")
    rows = spans.where((first <= last) & ~kind.isin(few) | kind.isin(few)).select("model", "feature", "value").collect()  # at most `bins` a model and feature
    values: dict[tuple, list[float]] = {}
    for r in rows:
        values.setdefault((r.model, r.feature), []).append(r.value)
    cuts = [[np.unique(np.array(values.get((m, f), []), float)) for f in range(len(names))] for m in models]
    return [[(c[1:] + c[:-1]) / 2 if distinct.get((m, f), 0) <= bins else c for f, c in enumerate(own)] for m, own in enumerate(cuts)]


#: Cells that a task holds before it adds up what it has of equal ones.
HELD = 200_000


def _counts(dealt: DataFrame, names: Sequence[str], cuts: list[list[np.ndarray]]) -> list[Cells]:
    """The cells of each model; the tasks add up their rows, so what moves is a few rows per cell and task."""
    folds, width = len(cuts) - 1, len(names) + 2
    shipped = dealt.sparkSession.sparkContext.broadcast(cuts)  # at most `bins` numbers a model and feature

    def added(cells: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(cells.view(f"V{width}").ravel(), return_inverse=True)
        sums = np.stack([np.bincount(at.ravel(), n[:, j], len(found)) for j in (0, 1)], axis=1).astype(np.int64)
        return found.view(np.uint8).reshape(-1, width), sums

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, n = np.zeros((0, width), np.uint8), np.zeros((0, 2), np.int64)
        for batch in batches:
            x, y, fold = batch[list(names)].to_numpy(float), batch["y"].to_numpy(), batch["fold"].to_numpy()
            for m, own in enumerate(shipped.value):
                codes = np.column_stack([*[np.searchsorted(c, x[:, f]) for f, c in enumerate(own)], y, np.full(len(y), m)]).astype(np.uint8)
                out = fold == m
                learned = (fold >= 0) & ~out if m < folds else np.ones(len(y), bool)
                more, sums = added(np.ascontiguousarray(codes), np.stack([learned, out], axis=1).astype(np.int64))
                cells, n = np.concatenate([cells, more]), np.concatenate([n, sums])
            if len(cells) > HELD:
                cells, n = added(cells, n)
        cells, n = added(cells, n)
        yield pd.DataFrame({"cell": [c.tobytes() for c in cells], "learned": n[:, 0], "left_out": n[:, 1]})

    sums = dealt.mapInPandas(count, "cell binary, learned long, left_out long").groupBy("cell").agg(F.sum("learned").alias("learned"), F.sum("left_out").alias("left_out"))
    found = sums.orderBy("cell").toArrow()  # one row per cell and model
    cells = np.frombuffer(b"".join(found["cell"].to_pylist()), np.uint8).reshape(-1, width)
    learned, out = (found[c].to_numpy().astype(np.int64) for c in ("learned", "left_out"))
    return [Cells(own, cells[of, :-2].astype(np.int64), cells[of, -2].astype(np.int64), learned[of], out[of]) for m, own in enumerate(cuts) for of in [cells[:, -1] == m]]


@dataclass(frozen=True)
class Sample:
    """Bounded labelled rows as arrays: features, label (0/1), fold."""

    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray


def sample(train: DataFrame, folds: int, rows: int = 50_000, label: str = "churn_label", key: str = "customer_id", features: Sequence[str] = K.MODEL_FEATURES, seed: int = 42) -> Sample:
    """At most about `rows` labelled rows in stratified folds, for trials on the driver; no search and no fit reads it. Rows with a null label or feature take no part."""
    whole = train.select(key, label, *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]).dropna()
    sizes = {r[label]: r["n"] for r in whole.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row per class
    most = {y: math.ceil(n * min(1.0, rows / max(1, sum(sizes.values())))) for y, n in sizes.items()}
    limit = F.lit(0)
    for y, n in most.items():
        limit = F.when(F.col(label) == y, n).otherwise(limit)
    picked = stratum_rank(whole, label, key, seed + 1, name="_place").where(F.col("_place") <= limit).drop("_place")
    found = stratified_folds(picked, label, key, folds, seed).orderBy(key).toPandas()
    return Sample(found[[f"x{i}" for i in range(len(features))]].to_numpy(float), found[label].to_numpy(int), found["fold"].to_numpy(int))


def grid_candidates(grid: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of a grid, the last parameter varying fastest."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def random_candidates(space: Mapping[str, Sequence], draws: int, seed: int = 42) -> list[dict]:
    """`draws` different combinations, drawn with a seed (all of them if there are no more)."""
    rng, seen = random.Random(seed), {}
    while len(seen) < min(draws, math.prod(len(v) for v in space.values())):
        pick = tuple(rng.choice(list(v)) for v in space.values())
        seen[pick] = dict(zip(space, pick))
    return list(seen.values())


def groups_of(kind: str, candidates: Sequence[dict]) -> list[tuple[dict, dict[int, int]]]:
    """(parameters without the length, {candidate: length}) of candidates that differ in the length only."""
    found: dict[str, tuple[dict, dict[int, int]]] = {}
    for i, c in enumerate(candidates):
        rest = {k: v for k, v in c.items() if k != LENGTH[kind]}
        found.setdefault(json.dumps(rest, sort_keys=True), (rest, {}))[1][i] = c[LENGTH[kind]]
    return list(found.values())


def search(train: DataFrame, kind: str, candidates: Sequence[dict], folds: int = 5, seed: int = 42) -> DataFrame:
    """(candidate, params, folds, n_scored, mean_auc, std_auc): every candidate's AUC over stratified folds of all rows.

    A fold without both classes counts no AUC. Only the counted cells pass the driver; the fits run in the tasks.
    """
    return searched(train.sparkSession, counted(train, folds, seed=seed), kind, candidates, seed)


def searched(spark: SparkSession, cells: Counted, kind: str, candidates: Sequence[dict], seed: int = 42) -> DataFrame:
    """`search` over rows that are counted already."""
    data = spark.sparkContext.broadcast(cells.folds)
    fits = [(json.dumps(params), json.dumps(lengths), f) for params, lengths in groups_of(kind, candidates) for f in range(len(cells.folds))]
    dealt = spark.createDataFrame(fits, "params string, lengths string, fold int").repartition(len(fits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.itertuples():
                own, lengths = data.value[r.fold], {int(i): n for i, n in json.loads(r.lengths).items()}
                scores = cell_scores(kind, own, sorted(set(lengths.values())), json.loads(r.params), seed)
                found += [(i, r.fold, auc(own.label, scores[n], own.out), int(own.out.sum())) for i, n in lengths.items()]
            yield pd.DataFrame(found, columns=["candidate", "fold", "auc", "n"])

    per_fold = dealt.mapInPandas(run, "candidate int, fold int, auc double, n long")
    per_fold = per_fold.withColumn("auc", F.when(~F.isnan("auc"), F.col("auc")))
    named = spark.createDataFrame([(i, ", ".join(f"{k}={v}" for k, v in sorted(c.items()))) for i, c in enumerate(candidates)], "candidate int, params string")
    summed = per_fold.groupBy("candidate").agg(F.count("*").cast("int").alias("folds"), F.sum("n").alias("n_scored"), F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))
    return named.join(summed, "candidate").select("candidate", "params", "folds", "n_scored", "mean_auc", "std_auc")


def best_of(results: DataFrame, candidates: Sequence[dict]) -> dict:
    """The parameters of the best mean AUC; ties go to the earlier candidate."""
    first = results.agg(F.max_by("candidate", F.struct(F.coalesce("mean_auc", F.lit(-1.0)), -F.col("candidate")))).first()[0]
    return candidates[first]


def auc(y: np.ndarray, score: np.ndarray, counts: np.ndarray | None = None) -> float:
    """Area under the ROC curve, equal scores half; NaN unless both classes occur. `counts`: how many rows each entry stands for."""
    counts = np.ones(len(y), np.int64) if counts is None else counts
    _, at = np.unique(score, return_inverse=True)
    own = np.bincount(at.ravel(), counts)
    rank = (np.cumsum(own) - (own - 1) / 2)[at.ravel()]
    pos, n = int(counts[y == 1].sum()), int(counts.sum())
    return float(((rank * counts)[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos))) if 0 < pos < n else math.nan


# --- the learner -----------------------------------------------------------------


def binned(x: np.ndarray, learned: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The bin of each value; the cuts are quantiles of the learned rows' distinct values, or lie between all of them."""
    codes = np.empty(x.shape, np.int64)
    for f in range(x.shape[1]):
        own = np.sort(x[learned, f])
        distinct = np.unique(own)
        cuts = (distinct[1:] + distinct[:-1]) / 2 if len(distinct) <= bins else np.unique(own[np.arange(1, bins) * len(own) // bins])
        codes[:, f] = np.searchsorted(cuts, x[:, f])
    return codes


def grow(codes: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, least: float, least_gain: float, tried: int, rng: np.random.Generator, levels: list | None = None) -> np.ndarray:
    """One tree, level by level; returns its value for every row. Rows of weight 0 are only carried along.

    `least`: rows of a child at least; `tried`: features tried at a node, drawn anew for each. `levels` gets the nodes of
    each level: rows, sum and sum of squares, whether it is split, at which feature and bin, and the gain.
    """
    n, features = codes.shape
    bins = int(codes.max()) + 1
    value, alive, node, nodes = np.zeros(n), np.arange(n), np.zeros(n, np.int64), 1
    for level in range(depth + 1):
        w, t = weight[alive], target[alive]
        total, mass = np.bincount(node, w * t, nodes), np.bincount(node, w, nodes)
        mean = total / np.maximum(mass, 1e-300)
        if levels is not None:
            none = np.zeros(nodes, np.int64)
            levels.append((mass, total, np.bincount(node, w * t * t, nodes), none > 0, none, none, none))
        if level == depth:
            break
        learned = np.flatnonzero(w > 0)
        at = ((node[learned, None] * features + np.arange(features)) * bins + codes[alive[learned]]).ravel()
        shape = (nodes, features, bins)
        left = np.bincount(at, np.repeat(w[learned], features), nodes * features * bins).reshape(shape).cumsum(2)[:, :, :-1]
        left_sum = np.bincount(at, np.repeat((w * t)[learned], features), nodes * features * bins).reshape(shape).cumsum(2)[:, :, :-1]
        right, right_sum = mass[:, None, None] - left, total[:, None, None] - left_sum
        fits = (left >= least) & (right >= least) & (left > 0) & (right > 0)
        if tried < features:
            drawn = np.argsort(rng.random((nodes, features)), axis=1)[:, :tried]
            chosen = np.zeros((nodes, features), bool)
            np.put_along_axis(chosen, drawn, True, 1)
            fits &= chosen[:, :, None]
        gain = left_sum**2 / np.where(fits, left, 1) + right_sum**2 / np.where(fits, right, 1)
        gain = np.where(fits, gain, -np.inf).reshape(nodes, -1)
        if not gain.shape[1]:
            break
        best = gain.argmax(1)
        won = (gain[np.arange(nodes), best] - total * mean) / np.maximum(mass, 1e-300)
        split = (won > 1e-12) & (won >= least_gain)
        if levels is not None:
            levels[-1] = (*levels[-1][:3], split, best // (bins - 1), best % (bins - 1), won)
        goes_on = split[node]
        value[alive[~goes_on]] = mean[node[~goes_on]]
        alive, node = alive[goes_on], node[goes_on]
        if not len(alive):
            return value
        right_of = codes[alive, best[node] // (bins - 1)] > best[node] % (bins - 1)
        number = np.cumsum(split) - 1
        node, nodes = 2 * number[node] + right_of, 2 * int(split.sum())
    value[alive] = mean[node]
    return value


def _share(strategy: str, features: int, forest: bool) -> int:
    """Features tried at a node by MLlib's strategy names."""
    named = {"all": features, "sqrt": math.ceil(features**0.5), "auto": math.ceil(features**0.5) if forest else features}
    return named[strategy] if strategy in named else math.ceil(float(strategy) * features)


def prefix_scores(kind: str, x: np.ndarray, y: np.ndarray, learned: np.ndarray, lengths: Sequence[int], params: dict, seed: int = 42) -> dict[int, np.ndarray]:
    """The probability of label 1 for every row after each of `lengths` trees or rounds, learned from the marked rows (0.5 if there are none)."""
    if not learned.any():
        return {n: np.full(len(y), 0.5) for n in lengths}
    # rows of the same bins and label share every sum and every value: a tree is grown on these cells and their weights
    cells, cell = np.unique(np.column_stack([binned(x, learned), y]), axis=0, return_inverse=True)
    cell, base, rate = cell.ravel(), learned.astype(float), params.get("subsamplingRate", 1.0)

    def drawn(rng: np.random.Generator) -> np.ndarray:
        bag = rng.poisson(1.0, len(y)) if kind == "forest" else rng.random(len(y)) < rate if rate < 1 else 1.0
        return np.bincount(cell, base * bag, len(cells))

    return {n: p[cell] for n, p in _prefixes(kind, cells[:, :-1], cells[:, -1], drawn, lengths, params, seed).items()}


def cell_scores(kind: str, cells: Cells, lengths: Sequence[int], params: dict, seed: int = 42) -> dict[int, np.ndarray]:
    """The same for every cell, learned from its counted rows."""
    if not cells.learned.any():
        return {n: np.full(len(cells.label), 0.5) for n in lengths}
    return _prefixes(kind, cells.codes, cells.label, _draws(kind, cells, params), lengths, params, seed)


def _draws(kind: str, cells: Cells, params: dict) -> Callable[[np.random.Generator], np.ndarray]:
    """What the draws of a cell's rows sum to: Poisson(1) each for a tree of a forest, a part of `subsamplingRate` for a round."""
    rate = params.get("subsamplingRate", 1.0)

    def drawn(rng: np.random.Generator) -> np.ndarray:
        return (rng.poisson(cells.learned) if kind == "forest" else rng.binomial(cells.learned, rate) if rate < 1 else cells.learned).astype(float)

    return drawn


def _grower(kind: str, codes: np.ndarray, label: np.ndarray, drawn: Callable[[np.random.Generator], np.ndarray], params: dict, seed: int) -> Callable[..., np.ndarray]:
    """A function of (number of the tree, margin so far) that grows this tree; it returns the tree's value for every cell."""
    least, least_gain = params.get("minInstancesPerNode", 1), params.get("minInfoGain", 0.0)
    forest = kind == "forest"
    tried = _share(params.get("featureSubsetStrategy", "auto"), codes.shape[1], forest)
    label = label.astype(float)
    sign = 2.0 * label - 1

    def tree(i: int, margin: np.ndarray, *levels: list) -> np.ndarray:
        rng = np.random.default_rng([seed, i])
        weight = drawn(rng)
        if forest:
            # the gain of Gini impurity is twice that of the variance of 0 and 1
            return grow(codes, label, weight, params["maxDepth"], least, least_gain / 2, tried, rng, *levels)
        target = sign if i == 0 else 4 * sign / (1 + np.exp(np.clip(2 * sign * margin, -500, 500)))
        return grow(codes, target, weight, params["maxDepth"], least, least_gain, tried, rng, *levels)

    return tree


def _prefixes(kind: str, codes: np.ndarray, label: np.ndarray, drawn: Callable[[np.random.Generator], np.ndarray], lengths: Sequence[int], params: dict, seed: int) -> dict[int, np.ndarray]:
    tree, out, total = _grower(kind, codes, label, drawn, params, seed), {}, np.zeros(len(label))
    for i in range(max(lengths)):
        total += tree_weight(kind, params, i) * tree(i, total)
        if i + 1 in lengths:
            out[i + 1] = total / (i + 1) if kind == "forest" else 1 / (1 + np.exp(np.clip(-2 * total, -500, 500)))
    return out


def tree_weight(kind: str, params: dict, i: int) -> float:
    """What tree `i` counts: one in a forest and for the first round, the step size for later rounds."""
    return 1.0 if kind == "forest" or i == 0 else params.get("stepSize", 0.1)


# --- the fitted trees ------------------------------------------------------------


NODES = "tree int, id int, prediction double, impurity double, stats array<double>, n long, gain double, left int, right int, feature int, threshold double"


def grown(spark: SparkSession, cells: Cells, kind: str, params: dict, seed: int = 42) -> DataFrame:
    """The nodes of the model that `params` ask for, in the tasks: trees of a forest are dealt, rounds follow each other in one task."""
    data, length = spark.sparkContext.broadcast(cells), params[LENGTH[kind]]
    parts = min(length, 100) if kind == "forest" else 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = data.value
        tree = _grower(kind, own.codes, own.label, _draws(kind, own, params), params, seed)
        for batch in batches:
            for part in batch["part"]:
                margin = np.zeros(len(own.label))
                for i in range(part, length, parts):
                    levels: list[tuple] = []
                    value = tree(i, margin, levels)
                    if kind != "forest":
                        margin += tree_weight(kind, params, i) * value
                    yield nodes_of(levels, own.cuts, kind == "forest").assign(tree=i)

    return spark.range(parts).withColumnRenamed("id", "part").repartition(parts).mapInPandas(run, NODES)


def nodes_of(levels: Sequence[tuple], cuts: list[np.ndarray], forest: bool) -> pd.DataFrame:
    """The nodes that `grow` noted, numbered level by level, with MLlib's statistics."""
    found, below = [], 0
    for n, total, squares, split, feature, at, gain in levels:
        ids = below + np.arange(len(n))
        below += len(n)
        child = np.where(split, below + 2 * (np.cumsum(split) - 1), -1)
        mean = total / np.maximum(n, 1e-300)
        variance = squares / np.maximum(n, 1e-300) - mean**2
        found.append(pd.DataFrame({
            "id": ids, "prediction": (mean > 0.5).astype(float) if forest else mean, "impurity": variance * (2 if forest else 1),
            "stats": list(np.stack([n - total, total] if forest else [n, total, squares], axis=1)), "n": n.astype(np.int64),
            "gain": np.where(split, gain * (2 if forest else 1), -1.0), "left": child, "right": np.where(split, child + 1, -1),
            "feature": np.where(split, feature, -1), "threshold": [cuts[f][c] if s else math.nan for s, f, c in zip(split, feature, at)]}))
    return pd.concat(found)
