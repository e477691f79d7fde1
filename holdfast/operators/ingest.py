"""Full and incremental loads, new-data check."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.operators import quality
from holdfast.sources.tables import TableStore

#: Ids of a load are broadcast only while their counted number stays below this.
BROADCAST_IDS = 500_000


def prepare(source: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good, quarantine, rule counts) of a raw load: required columns, cleaning, first row per id, rules."""
    cleaned = quality.clean_raw(quality.require_columns(source))
    return quality.validate_rows(quality.dedupe_customers(cleaned, order))


def new_rows(source: DataFrame, table: DataFrame) -> DataFrame:
    """Source rows whose customer id is not in the table yet."""
    return source.join(table.select("customer_id"), "customer_id", "left_anti")


def new_rows_of_few(source: DataFrame, table: DataFrame) -> DataFrame:
    """The same for a source that is usually small beside the table (a micro-batch).

    The table's ids are first reduced to those of the source, without a shuffle of the table while the
    source is small; the source is counted to know.
    """
    ids = source.select("customer_id")
    ids = F.broadcast(ids) if source.count() <= BROADCAST_IDS else ids
    return new_rows(source, table.select("customer_id").join(ids, "customer_id", "left_semi"))


def check_for_new_data(source: DataFrame, table: DataFrame) -> DataFrame:
    """Number of distinct source ids that the table lacks."""
    ids = new_rows(source.select("customer_id"), table).distinct()
    return ids.agg(F.count("*").alias("new_customers")).withColumn("has_new_data", F.col("new_customers") > 0)


def ingest(store: TableStore, source: DataFrame, run_id: str, mode: str = "full", order: list[str] | None = None) -> None:
    """Load customers into `raw_customers`: replace the table, or append only unknown ids."""
    good, quarantine, _ = prepare(source, order or source.columns)
    columns = schemas.RAW_CUSTOMERS.names
    if mode == "incremental":
        current = store.snapshot("raw_customers", before=run_id)
        store.write("raw_customers", new_rows(good, current).select(*columns), run_id, "append")
    elif mode == "full":
        store.write("raw_customers", good, run_id)
    else:
        raise ValueError(f"Unknown mode: {mode}")
    store.write("quarantine", quarantine, run_id, "append")
