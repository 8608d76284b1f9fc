"""The catalogue's side of the engine: databases, statistics of tables, and small results as JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession


def _quoted(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def ensure_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(name)}")


def analyse(spark: SparkSession, name: str, columns: tuple[str, ...] = ()) -> None:
    """Has Spark count a table's rows, and ranges and nulls of the columns named, for its cost-based choices."""
    wanted = f" FOR COLUMNS {', '.join(_quoted(c) for c in columns)}" if columns else ""
    spark.sql(f"ANALYZE TABLE {_quoted(name)} COMPUTE STATISTICS{wanted}")


def statistics(spark: SparkSession, name: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """(table_name, n_rows, n_bytes, column, low, high, nulls) as the catalogue has them; without columns one row, whose last four are null."""
    stated = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {_quoted(name)}").collect()}
    found = re.match(r"(\d+) bytes(?:, (\d+) rows)?", stated.get("Statistics", ""))
    size, rows = (int(x) if x else None for x in found.groups()) if found else (None, None)
    out = []
    for column in columns or (None,):
        facts = {r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE EXTENDED {_quoted(name)} {_quoted(column)}").collect()} if column else {}
        known = [None if facts.get(k) in (None, "NULL") else facts[k] for k in ("min", "max", "num_nulls")]
        out.append((name, rows, size, column, known[0], known[1], int(known[2]) if known[2] else None))
    return spark.createDataFrame(out, "table_name string, n_rows long, n_bytes long, column string, low string, high string, nulls long")


def write_metrics(spark: SparkSession, path: str, metrics: dict) -> None:
    """One JSON object of a stage's figures in a file of any store that Spark reaches; it replaces an older one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(at, True)
    try:
        out.write(bytearray(json.dumps(metrics, ensure_ascii=False, indent=1, sort_keys=True, default=str).encode()))
    finally:
        out.close()
