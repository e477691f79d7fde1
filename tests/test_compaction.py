"""Compaction and removal of parts: the rows stay, the files become few, what still counts is never removed."""

import glob

import pytest
from pyspark.sql import functions as F

from holdfast.sources.tables import TableStore


def ids(df):
    return sorted(r.id for r in df.collect())


def part(spark, *numbers):
    return spark.createDataFrame([(n, f"row {n}") for n in numbers], "id long, text string")


def test_many_appends_become_few_files(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    for n in range(40):
        store.write("t", part(spark, n, n + 1000), f"batch-{n:04d}", "append")
    old = store.snapshot("t")
    assert store.compact("t") == 40
    now = store.snapshot("t")
    assert len(now.inputFiles()) == 1 and ids(now) == ids(old) and len(ids(now)) == 80
    store.write("t", part(spark, 5000), "batch-0040", "append")
    store.write("t", part(spark, 5001), "batch-0040", "append")  # again: takes its old place
    assert ids(store.snapshot("t"))[-1] == 5001 and store.snapshot("t").count() == 81
    assert store.compact("t") == 2 and store.compact("t") == 1
    with pytest.raises(ValueError, match="gathered"):
        store.write("t", part(spark, 1), "batch-0003", "append")
    assert ids(old) == sorted([*range(40), *range(1000, 1040)])  # readers of the older parts
    assert store.expire("t") == 43
    assert store.snapshot("t").count() == 81 and len(glob.glob(f"{tmp_path}/t/run_id=*/attempt=*")) == 1 and len(store.commits("t")) == 1
    store.write("t", part(spark, 9), "batch-0041", "append")
    assert store.snapshot("t").count() == 82


def test_replaced_tables(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert store.expire("none") == 0 and store.compact("none") == 0
    store.write("t", part(spark, 1), "a")
    store.write("t", part(spark, 2), "b", "append")
    store.write("t", part(spark, 3), "c")
    store.write("t", part(spark, 4), "d", "append")
    spark.range(3).write.parquet(f"{store.path('t')}/run_id=e/attempt=unfinished")
    assert store.compact("t") == 2 and ids(store.snapshot("t")) == [3, 4]
    assert store.expire("t") == 4 and ids(store.snapshot("t")) == [3, 4]
    assert glob.glob(f"{tmp_path}/t/run_id=e/attempt=*")
    assert store.snapshot("t").where(F.col("id") > 3).count() == 1
