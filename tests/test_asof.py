"""As-of join against brute force: ties, equal instants, a key with most of the rows, any number of partitions."""

import random

import pytest

from holdfast.plans.asof import asof_join

LEFT, RIGHT = "k string, t int, id int, _part int", "k string, t int, v int, w string"


def rows(n=400, seed=1):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot", "hot", "a", "b", "c", "lonely", None])
    left = [(key(), rng.choice([None, *range(60)]), i, 5) for i in range(n)]
    right = [(key(), rng.choice([None, *range(60)]), i, f"w{i}") for i in range(n // 2)]
    return left, [r for r in right if r[0] != "lonely"]


def brute(left, right, same_instant):
    out = []
    for k, t, i, _ in left:
        fits = [r for r in right if None not in (k, t, r[0], r[1]) and r[0] == k and (r[1] <= t if same_instant else r[1] < t)]
        out.append((i, max(fits, key=lambda r: (r[1], r[2]))[2] if fits else None))
    return sorted(out)


@pytest.mark.parametrize("same_instant", [True, False])
@pytest.mark.parametrize("per_part", [10_000, 60, 7])
def test_against_brute_force(spark, same_instant, per_part):
    left, right = rows()
    out = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", "t", ties=["v"], same_instant=same_instant, rows=per_part)
    assert out.columns == ["k", "t", "id", "_part", "asof"]
    got = sorted(((r["id"], r["asof"] and r["asof"]["v"]) for r in out.collect()))
    assert got == brute(left, right, same_instant)


def test_a_hot_key_is_spread(spark):
    left = [("hot", i, i, 0) for i in range(3000)]
    right = [("hot", 3 * i, i, "") for i in range(300)]
    out = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", "t", rows=100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert {r["id"]: r["asof"] and r["asof"]["v"] for r in out.collect()} == {i: min(299, (i - 1) // 3) if i else None for i in range(3000)}


def test_empty_sides(spark):
    left, right = rows(20)
    l, r = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    assert asof_join(l.limit(0), r, ["k"], "t", "t").count() == 0
    assert {x["asof"] for x in asof_join(l, r.limit(0), ["k"], "t", "t").collect()} == {None}
