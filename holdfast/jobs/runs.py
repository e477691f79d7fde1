"""Run log around a job: a row for success, a row, the error and an alert for failure."""

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.operators import drift, registry
from holdfast.sources.tables import TableStore


def recorded(store: TableStore, name: str, run_id: str, now: Column, work: Callable[[], tuple[int, str]]) -> DataFrame:
    """Do `work` (which returns rows processed and details), log the run, return its row."""
    start = time.time()
    one = store.spark.range(1)
    try:
        rows, details = work()
    except Exception as error:
        failed = registry.record_run(name, "failed", F.lit(0), time.time() - start, F.lit(str(error)), now, one)
        store.write("pipeline_runs", failed, f"{run_id}-{name}", "append")
        alert = drift.failure_alerts(failed).select(F.xxhash64("alert_type", F.lit(name), now).alias("id"), "*", now.alias("created_at"))
        store.write("alerts", alert, f"{run_id}-{name}", "append")
        raise
    done = registry.record_run(name, "success", F.lit(rows), time.time() - start, F.lit(details), now, one)
    store.write("pipeline_runs", done, f"{run_id}-{name}", "append")
    return done
