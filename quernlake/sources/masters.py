"""Master data and other outside sources: a database by JDBC, an object store, the finance file, an SQL script of inserts."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas of the masters; the validity ranges are closed at both ends, an open one ends on 9999-12-31.
MASTERS = {
    "stores": "store_id string, store_name string, address_line string, city string, state string, region string, floor_area_sqft int, opened_on date",
    "product_categories": "category_id string, category_name string, department string, gst_rate decimal(4,3)",
    "products": "product_sk bigint, product_code string, product_name string, category_id string, brand string, pack_size string, uom string, valid_from date, valid_to date, is_current boolean",
    "price_revisions": "revision_id bigint, product_sk bigint, mrp decimal(12,2), selling_price decimal(12,2), effective_from date, effective_to date",
}
FINANCE = "month string, closed_on date, revenue_inr decimal(14,2), signed_off_by string"


def read_database(spark: SparkSession, url: str, table: str, user: str, password: str, key: str | None = None, parts: int = 8, driver: str = "org.postgresql.Driver") -> DataFrame:
    """A table of a database by JDBC; with a numeric `key`, in `parts` ranges of it that executors read side by side."""
    options = {"url": url, "dbtable": table, "user": user, "password": password, "driver": driver, "pushDownPredicate": "true", "pushDownAggregate": "true"}
    reader = spark.read.format("jdbc").options(**options)
    if key:
        bounds = spark.read.format("jdbc").options(**options | {"dbtable": f"(SELECT min({key}) AS low, max({key}) AS high FROM {table}) AS bounds"}).load().first()
        if bounds and bounds["low"] is not None:
            reader = reader.options(partitionColumn=key, lowerBound=str(bounds["low"]), upperBound=str(bounds["high"]), numPartitions=str(parts))
    return reader.load()


def write_database(frame: DataFrame, url: str, table: str, user: str, password: str, mode: str = "append", driver: str = "org.postgresql.Driver") -> None:
    frame.write.format("jdbc").options(url=url, dbtable=table, user=user, password=password, driver=driver, truncate="true").mode(mode).save()


def object_store_settings(endpoint: str, access_key: str, secret_key: str, ssl: bool = False) -> dict[str, str]:
    """Session settings for an S3-compatible store that is addressed by path."""
    base = "spark.hadoop.fs.s3a"
    return {f"{base}.endpoint": endpoint, f"{base}.access.key": access_key, f"{base}.secret.key": secret_key, f"{base}.path.style.access": "true", f"{base}.connection.ssl.enabled": str(ssl).lower()}


def read_finance(spark: SparkSession, path: str) -> DataFrame:
    """(month, finance_revenue) of the finance file. The schema is given, as a month would be taken for a time."""
    rows = spark.read.csv(path, schema=FINANCE, header=True)
    return rows.select(F.substring("month", 1, 7).alias("month"), F.col("revenue_inr").alias("finance_revenue"))


def read_csv_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose quoted fields hold line breaks and doubled quotes; null strings become empty."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"').na.fill("")


def _values(script: str) -> Iterator[tuple[str, list[str | None]]]:
    """(table, fields) of every row of the INSERT statements."""
    field = r"\s*(?:'((?:[^']|'')*)'|([^,()'\s][^,()']*))\s*"
    row = re.compile(rf"\(({field}(?:,{field})*)\)")
    for statement in re.finditer(r"INSERT\s+INTO\s+([\w.]+)\s*(?:\([^)]*\))?\s*VALUES\s*((?:[^';]|'(?:[^']|'')*')*);", script, re.I):
        for found in row.finditer(statement[2]):
            yield statement[1].rsplit(".", 1)[-1].lower(), [a.replace("''", "'") if b == "" else None if b.strip().upper() == "NULL" else b.strip() for a, b in re.findall(field, found[1])]


def load_script(spark: SparkSession, path: str, schemas: dict[str, str] = MASTERS) -> dict[str, DataFrame]:
    """The tables that an SQL script of multi-row inserts fills. The script is read by Spark; masters are small by nature."""
    script = "\n".join(row[0] or "" for row in spark.read.text(path, wholetext=True).collect())
    rows: dict[str, list[list[str | None]]] = {name: [] for name in schemas}
    for name, fields in _values(script):
        if name in rows:
            rows[name].append(fields)
    made = {}
    for name, schema in schemas.items():
        types = T.StructType.fromDDL(schema)
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in types])
        made[name] = spark.createDataFrame(rows[name], text).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in types])
    return made
