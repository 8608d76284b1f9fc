"""Readers of the Parquet tables under a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of `sf_dir`; only Spark touches the path, so any store it can read will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
