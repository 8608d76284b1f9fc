"""Data-quality checks in the place of a database's constraints, which Parquet tables don't have.

Each gives one row (check, violations) and reads only the columns it names; keys are compared by a grouped count or an anti join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _violations(rows: DataFrame, name: str, count: Column) -> DataFrame:
    return rows.agg(F.lit(name).alias("check"), F.coalesce(count, F.lit(0)).cast("bigint").alias("violations"))


def not_null(rows: DataFrame, table: str, column: str) -> DataFrame:
    return _violations(rows, f"{table}.{column} not null", F.count(F.when(F.col(column).isNull(), 1)))


def unique(rows: DataFrame, table: str, *key: str) -> DataFrame:
    """Rows beyond the first of each key; a key with a null in it equals no other, as in a database."""
    sizes = rows.select(*key).dropna().groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return _violations(sizes, f"{table}.{'+'.join(key)} unique", F.sum(F.col("_n") - 1))


def references(rows: DataFrame, table: str, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose value, if any, the parent's key doesn't have."""
    orphans = rows.select(F.col(column).alias("_key")).dropna().join(parent.select(F.col(key).alias("_key")), "_key", "left_anti")
    return _violations(orphans, f"{table}.{column} references {key}", F.count(F.lit(1)))


def holds(rows: DataFrame, table: str, condition: str) -> DataFrame:
    """Rows for which the condition is false; unknown passes, as in a CHECK."""
    return _violations(rows, f"{table} {condition}", F.count(F.when(~F.expr(condition), 1)))
