"""Copy-on-write bucket tables against a plain dictionary, and what they read and write."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators import scoring
from holdfast.sources.buckets import BucketTable
from holdfast.sources.tables import TableStore

SCHEMA = "customer_id string, score double, note string"


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, str(tmp_path / "t"), "customer_id", 16)


def frame(spark, rows):
    return spark.createDataFrame([(k, float(v), f"n{v}") for k, v in rows.items()], SCHEMA)


def content(df):
    rows = df.collect()
    out = {r.customer_id: int(r.score) for r in rows}
    assert len(out) == len(rows) and all(r.note == f"n{int(r.score)}" for r in rows)
    return out


def test_any_sequence_of_upserts(spark, table):
    rng = random.Random(2)
    want = {f"c{i}": i for i in range(500)}
    table.replace(frame(spark, want), "load")
    states = {"load": dict(want)}
    for n in range(6):
        run, changes = f"run{n}", {f"c{rng.randrange(700)}": 1000 * n + j for j in range(rng.choice([1, 3, 40]))}
        before = dict(want)
        gone = content(table.upsert(frame(spark, changes), run))
        assert gone == {k: v for k, v in before.items() if k in changes}
        want |= changes
        assert content(table.snapshot()) == want and content(table.snapshot(before=run)) == before
        states[run] = dict(want)
    # the last run again, with other rows, takes its old place
    table.upsert(frame(spark, {"c1": 77_000}), "run5")
    want = states["run4"] | {"c1": 77_000}
    assert content(table.snapshot()) == want and content(table.snapshot(before="run5")) == states["run4"]
    with pytest.raises(ValueError, match="later runs"):
        table.upsert(frame(spark, {"c1": 5}), "run3")
    assert content(BucketTable(spark, table.path, "customer_id", 99).snapshot()) == want


def test_only_touched_buckets_are_read_and_written(spark, table):
    table.replace(frame(spark, {f"c{i}": i for i in range(400)}), "load")
    plain = table.snapshot()
    table.upsert(frame(spark, {"c7": 70, "c8": 80}), "one")
    written = glob.glob(f"{table.path}/run_id=one/attempt=*/_bucket=*")
    assert 1 <= len(written) <= 2
    kept_files = {os.path.dirname(f) for f in table.snapshot().inputFiles()}
    assert len(kept_files) == 16 and sum("run_id=one" in f for f in kept_files) == len(written)
    assert content(plain)["c7"] == 7  # a reader of the older state is not disturbed
    found = table.lookup("c7", "none")
    assert content(found) == {"c7": 70} and len({os.path.dirname(f) for f in found.inputFiles()}) <= 2


def test_expire_keeps_what_is_listed(spark, table):
    table.replace(frame(spark, {f"c{i}": i for i in range(100)}), "load")
    for n in range(8):
        table.upsert(frame(spark, {f"c{i}": 1000 + n for i in range(60)}), f"r{n}")
    want = content(table.snapshot())
    assert table.expire(keep=2) > 3 and content(table.snapshot()) == want
    assert content(table.snapshot(before="r7")) == want | {f"c{i}": 1006 for i in range(60)}


def test_empty_tables(spark, table):
    with pytest.raises(ValueError, match="no table"):
        table.snapshot()
    assert table.upsert(frame(spark, {"a": 1}), "first").count() == 0 and content(table.snapshot()) == {"a": 1}
    assert table.upsert(frame(spark, {"a": 1}).limit(0), "nothing").count() == 0 and content(table.snapshot()) == {"a": 1}
    assert table.lookup("zzz").count() == 0
    table.replace(frame(spark, {"a": 1}).limit(0), "emptied")
    assert table.snapshot().count() == 0 and table.snapshot().columns == ["customer_id", "score", "note"]
    table.upsert(frame(spark, {"b": 2}), "again")
    assert content(table.snapshot()) == {"b": 2}


def test_scores_upsert_equals_the_whole_rewrite(spark, tables, tmp_path):
    store, table = TableStore(spark, str(tmp_path)), BucketTable(spark, str(tmp_path / "p"), "customer_id", 8)
    table.replace(tables.cp.select(*scoring.PREDICTION, *scoring.RETENTION), "load")
    fresh = scoring.score(tables.rc.where(F.col("customer_id") < "CUST-000000030"), tables.card, tables.now)
    want, archived = scoring.publish_scores(fresh, tables.cp, tables.now, "new")
    scoring.upsert_scores(table, store, fresh, tables.now, "r")
    got = table.snapshot().select(*want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    log = store.snapshot("churn_predictions_history").select(*archived.columns)
    assert log.exceptAll(archived).count() == archived.exceptAll(log).count() == 0
