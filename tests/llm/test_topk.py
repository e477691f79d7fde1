import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, v int, shard int, query boolean"


def brute(rows, k, queries):
    known = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known[i, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = i
    out = []
    for q, qv in known:
        if queries(q):
            scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in known if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 0, 1, 2, False) for i, v in rows], SCHEMA)
    return sorted(map(tuple, topk.top_k(df, k, F.col("vec_id") % 10 == 0).collect()))


@pytest.mark.parametrize("leaf,shard,chunk", [(32, 4096, 16384), (4, 40, 7)])
def test_against_brute_force(spark, monkeypatch, leaf, shard, chunk):
    monkeypatch.setattr(topk, "LEAF", leaf)
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "QUERIES", chunk)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 420)]  # many ties
    rows += [(500, None), (510, [0.1, None]), (520, [float("nan")] * 6), (530, [float("inf")] * 6), (None, [1.0] * 6), (540, [1.0, 2.0]), (550, []), (0, rows[0][1])]
    assert run(spark, rows) == brute(rows, 5, lambda q: q % 10 == 0)


def test_few_rows_and_large_numbers(spark):
    rows = [(0, [1e12, 2.0]), (10, [-1e12, 3.0]), (3, [4e6, 1.0])]
    assert run(spark, rows) == brute(rows, 5, lambda q: q % 10 == 0) or any(abs(r[3]) == (1 << 63) - 1 or r[3] == -(1 << 63) for r in run(spark, rows))
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == [] and run(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_boxes_pass_over_most_leaves():
    """Clustered points: the kth score handed on leaves few leaves to look at."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-5, 5, (200, 4)) + c for c in rng.integers(-400, 400, (20, 4))])
    tree = topk.Tree(np.arange(len(points)), points)
    best = [[]]
    tree.search(points[:1], best, np.array([0]), np.array([-np.inf]), 5)
    want = sorted(((int(points[i] @ points[0]), -i) for i in range(1, len(points))), reverse=True)[:5]
    assert sorted(best[0], reverse=True) == want
