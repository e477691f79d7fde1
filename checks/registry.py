"""Registration of queries: a callable over `Tables` and, where one exists, an equivalent SQL text."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.sqltext import with_ctes
from checks.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_ctes(oracle)
        return build

    return register
