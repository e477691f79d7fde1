"""File sources and sinks: customer CSV, prediction exports, report files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import schemas


def read_customers_csv(spark: SparkSession, path: str) -> DataFrame:
    """Customer CSV with a header and an explicit schema; broken lines land in `_corrupt_record`."""
    return (
        spark.read.schema(schemas.CUSTOMER_CSV).option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)
    )


def write_customers_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_predictions(df: DataFrame, path: str, run_date: str, fmt: str = "csv") -> None:
    """One dated partition per run; a rerun of the same day replaces only that day."""
    cols = ["customer_id", "churn_probability", "risk_segment", "model_version"]
    dated = df.select(*cols, F.lit(run_date).alias("run_date"))
    writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date")
    writer.option("header", True).format(fmt).save(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A result table as CSV, JSON or Parquet files."""
    df.write.mode("overwrite").option("header", True).format(fmt).save(path)


def markdown_table(df: DataFrame, title: str) -> DataFrame:
    """A small result table as one-column markdown lines (`place`, `value`), header first."""
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = df.select(F.lit(len(head)).alias("place"), line.alias("value"))
    lines = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(h) for h in head])).alias("place", "value"))
    return lines.unionByName(body).orderBy("place", "value")


def write_markdown(df: DataFrame, title: str, path: str) -> None:
    """Markdown report of a small aggregate, as a text file."""
    markdown_table(df, title).coalesce(1).select("value").write.mode("overwrite").text(path)


def section_lines(title: str, sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """A report of several small tables as ordered lines (`place`, `line`): the title, then each section with its table.

    Rows of a section keep the order of its frame if that is sorted, else they are sorted as text.
    """
    spark = sections[0][1].sparkSession
    parts = [spark.createDataFrame([(0, 0, 0, f"# {title}")], "section int, part int, row long, line string")]
    for i, (name, df) in enumerate(sections, 1):
        head = ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        parts.append(spark.createDataFrame([(i, 0, k, h) for k, h in enumerate(head)], "section int, part int, row long, line string"))
        cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
        # reports hold small aggregates; the id follows the order of a sorted frame
        parts.append(df.select(F.lit(i).alias("section"), F.lit(1).alias("part"), F.monotonically_increasing_id().alias("row"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines.orderBy("section", "part", "row", "line")


def write_sections(title: str, sections: list[tuple[str, DataFrame]], path: str) -> None:
    """The lines of a report as text; long lists fill several files, in order."""
    section_lines(title, sections).select("line").write.mode("overwrite").text(path)


def ensure_columns(df: DataFrame, columns: dict[str, str | T.DataType]) -> DataFrame:
    """Additive migration: columns the table lacks appear as typed NULLs."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}) if columns else df
