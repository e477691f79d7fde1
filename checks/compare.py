"""Run registered queries against DuckDB: python -m checks.compare <sf_dir> [--exact] [name prefix ...]."""

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def local_session() -> SparkSession:
    from holdfast.session import tune

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in GIVEN:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


EXACT = "--exact" in sys.argv


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (v if EXACT else round(v, 6)) + 0.0
    if isinstance(v, bool):
        return v
    return v


def rows_of(columns, rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark: SparkSession, con, sf_dir: str, build, sql: str) -> str:
    """Empty string when equal, else a description of the first difference."""
    df = build(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    res = con.sql(sql)
    want = rows_of(res.columns, res.fetchall())
    if sorted(df.columns) != sorted(res.columns):
        return f"columns {sorted(df.columns)} != {sorted(res.columns)}"
    if got == want:
        simple = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
        kinds = dict(zip(res.columns, map(str, res.types)))
        odd = [f"{c}:{k}/{kinds[c]}" for c, k in df.dtypes if simple.get(k, k) != kinds[c]]
        return f"types differ {odd}" if odd else ""
    diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
    return f"rows {len(got)} vs {len(want)}; first differences {diff}"


def main() -> None:
    from checks.catalog import ORACLES, QUERIES

    sf_dir, wanted = sys.argv[1], [a for a in sys.argv[2:] if not a.startswith("--")]
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name, build in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, sf_dir, build, ORACLES[name])
                n = len(con.sql(ORACLES[name]).fetchall())
            else:
                n = build(spark, sf_dir).count()
                problem = ""
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n} {time.time() - start:.2f}s {'' if name in ORACLES else '(rows only) '}{problem}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
