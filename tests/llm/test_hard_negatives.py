import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int, v int, part int, anchor boolean, chunk string, id string"


def brute(rows, s, anchors):
    known = sorted({(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for a, label, av in known:
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, other) for i, other, v in known)
        for minus, p, _ in [x for x in scored if x[2] == label and x[1] != a][: s.positives]:
            fits = [(i, -n) for n, i, other in scored if other != label and s.low * -minus <= 100 * -n <= s.high * -minus]
            out += [(a, p, r + 1, i, -minus, n) for r, (i, n) in enumerate(fits[: s.negatives])]
    return sorted(out)


def run(spark, rows, s=H.Settings()):
    df = spark.createDataFrame([(i, v, label, 1, 2, False, "x", "y") for i, v, label in rows], SCHEMA)
    return sorted(map(tuple, H.mine(df, F.col("vec_id") % 10 == 0, s).collect()))


@pytest.mark.parametrize("chunk,shard", [(4096, 4096), (7, 40)])
def test_against_brute_force(spark, monkeypatch, chunk, shard):
    monkeypatch.setattr(H, "CHUNK", chunk)
    monkeypatch.setattr(H, "SHARD", shard)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0.4, 1) for _ in range(6)], rng.choice([0, 0, 1, 2, None])) for i in range(300)]
    rows += [(i, [0.5] * 6, i % 3) for i in range(300, 420)]  # many ties, a third of all rows
    rows += [(500, None, 1), (510, [0.1, None], 1), (520, [float("nan")] * 6, 1), (530, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (540, [1.0, 2.0], 1), (550, [], 1), (0, rows[0][1], rows[0][2]), (1, [1.0] * 6, 9), (10, [2.0] * 6, 0)]
    want = brute(rows, H.Settings(), lambda i: i % 10 == 0)
    assert len(want) > 500
    assert run(spark, rows) == want


def test_few_rows(spark):
    s = H.Settings(positives=2, negatives=1)
    rows = [(0, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [0.5, 0.5], 1), (3, [0.5, 0.5], 1), (10, [-1.0, 0.0], 3)]
    assert run(spark, rows, s) == brute(rows, s, lambda i: i % 10 == 0) != []
    assert run(spark, []) == run(spark, [(0, [1.0], 1)]) == run(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == run(spark, [(0, [], 1), (1, [], 1)]) == []


def test_large_numbers(spark):
    """Products beyond the exact range of a double."""
    rows = [(0, [1.1e7, 2.0], 0), (1, [1e7, 3.0], 0), (2, [8e6, 1.0], 1), (3, [8e6, -5.0], 2), (4, [1e7, 0.0], 2)]
    assert run(spark, rows) == brute(rows, H.Settings(), lambda i: i % 10 == 0) != []


def test_chunks_are_numbered_from_0(spark, monkeypatch):
    """A small last shard leaves its room to no chunk, however few the anchors are."""
    monkeypatch.setattr(H, "SHARD", 8)
    rng = random.Random(4)
    for n in (6, 30, 300):
        rows = [(i, [rng.gauss(0.4, 1) for _ in range(3)], i % 2) for i in range(n)]
        usable = spark.createDataFrame(rows, "id bigint, v array<double>, label bigint").selectExpr("id", "label", "transform(v, x -> floor(256 * x)) v", "id % 10 = 0 anchor")
        parts = H._placed(usable, n, n // 10 + (n % 10 > 0), 3).groupBy("anchor").agg(F.min("part"), F.max("part"), F.count_distinct("part")).collect()
        assert len(parts) == 2 and all(least == 0 and most == many - 1 for _, least, most, many in parts)
        assert run(spark, rows) == brute(rows, H.Settings(), lambda i: i % 10 == 0)


def clustered(rng, n):
    centres = rng.normal(0, 300, (20, 64))
    return (centres[rng.integers(0, 20, n)] + rng.normal(0, 3, (n, 64))).round().astype(np.int64)


def test_bounds_hold_and_pass_over_candidates():
    """Every candidate in a window is among those scored again; on clustered vectors few are.

    The 19 edges of the 99 that lead to another cluster are too long to bound anything; along the others a cluster's
    own twentieth is scored: together about a quarter.
    """
    rng = np.random.default_rng(3)
    points, anchors = clustered(rng, 2000), np.arange(0, 2000, 20)
    tree = H.AnchorTree(anchors, np.zeros(100, np.int64), points[anchors], *H.spanning(points[anchors]))
    shard = H.Shard(np.arange(2000), np.ones(2000, np.int64), points)
    exact, again = points[anchors] @ points.T, 0
    for a, at, scores in H.overlapping(tree, shard, lambda a: np.ones(2000, bool), lambda a: (int(np.sort(exact[a])[-20]), np.inf)):
        assert set(np.flatnonzero(exact[a] >= np.sort(exact[a])[-20])) <= set(at) and (scores == exact[a][at]).all()
        again += len(at) * (tree.parent[a] >= 0)
    assert again < (19 / 99 + 80 / 99 / 20) * 1.1 * 99 * 2000


def test_spanning_tree_is_the_least():
    rng = np.random.default_rng(5)
    points = rng.integers(-50, 50, (60, 3))
    parent, walk = H.spanning(points)
    length = sum(np.linalg.norm(points[i] - points[p]) for i, p in enumerate(parent) if p >= 0)
    pairs = sorted((np.linalg.norm(points[i] - points[j]), i, j) for i in range(60) for j in range(i))
    group, want = list(range(60)), 0.0
    for d, i, j in pairs:  # Kruskal
        if group[i] != group[j]:
            want += d
            group = [group[i] if g == group[j] else g for g in group]
    assert length == pytest.approx(want) and sorted(walk) == list(range(60))
    assert all(p < 0 or list(walk).index(p) < list(walk).index(i) for i, p in enumerate(parent))
