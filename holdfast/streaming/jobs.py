"""Micro-batch versions of ingest, scoring and the daily trend.

Each micro-batch is committed to the same tables as the batch jobs use, as rows appended under a run id
of its own. It looks only at what was committed before it, so a batch that is replayed after a failure
replaces its own output and nothing else. The streams keep no state: what is known is read from the
tables.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from holdfast import schemas
from holdfast.operators import ingest, scoring
from holdfast.plans.pick import first_per_key
from holdfast.sources.tables import TableStore


def run_id(stream: str, batch: int) -> str:
    """Run id of a micro-batch. Streams into one table need names of their own."""
    return f"{stream}-{batch:012d}"


def landing_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_ingest(rows: DataFrame, store: TableStore, checkpoint: str, order: list[str], name: str = "ingest") -> StreamingQuery:
    """Append valid customers with unknown ids to `raw_customers`, rejected rows whole to the quarantine."""

    def add(batch: DataFrame, number: int) -> None:
        this = run_id(name, number)
        good, quarantine, _ = ingest.prepare(batch, order)
        fresh = ingest.new_rows_of_few(good, store.snapshot("raw_customers", before=this))
        store.write("raw_customers", fresh.select(*schemas.RAW_CUSTOMERS.names), this, "append")
        store.write("quarantine", quarantine, this, "append")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_score(rows: DataFrame, store: TableStore, model, checkpoint: str, now: Column, order: list[str] | None = None, name: str = "score") -> StreamingQuery:
    """Score customers without a score and append them to the predictions; of several rows the first by `order` (all columns if not given) counts."""

    def add(batch: DataFrame, number: int) -> None:
        this = run_id(name, number)
        scored_before = store.snapshot("churn_predictions", before=this)
        first = first_per_key(batch, ["customer_id"], order or batch.columns)
        fresh = scoring.score(ingest.new_rows_of_few(first, scored_before), model, now)
        current, _ = scoring.publish_scores(fresh, scored_before.limit(0), now, "new")
        store.write("churn_predictions", current, this, "append")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_windows(h: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Average score and count per day of `archived_at`; rows later than `lateness` are dropped.

    A watermark needs a zoned timestamp and day windows are cut in UTC, so the session must be in UTC.
    """
    zone = h.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"daily windows need a UTC session, not {zone}")
    timed = h.withColumn("event_time", F.col("archived_at").cast("timestamp"))
    daily = timed.withWatermark("event_time", lateness).groupBy(F.window("event_time", "1 day")).agg(
        F.avg("churn_probability").alias("avg_probability"), F.count("*").alias("n")
    )
    return daily.select(F.to_date("window.start").alias("day"), "avg_probability", "n")


def stream_daily(h: DataFrame, path: str, checkpoint: str, lateness: str = "1 day") -> StreamingQuery:
    """Write each day to Parquet once its window has closed."""
    return daily_windows(h, lateness).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
