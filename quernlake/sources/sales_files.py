"""Sales exports of the three till dialects, as one table of canonical lines.

A file's name is its contract: SALES_<store>_<yyyymmdd>[__R<n>].<csv|parquet>. The store, the business date and the number
of the re-send come from there, never from the rows, so a bill after midnight belongs to the day that its file names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The dialects' separators, column names and time formats, and the file name.
FILE_NAME = r"SALES_(S\d+)_(\d{8})(?:__R(\d+))?\.(csv|parquet)"
CANONICAL = ["bill_no", "line_no", "product_code", "qty", "unit_price", "line_type", "ts"]
DIALECTS = {
    "A": {"stores": ["S01", "S02", "S03", "S04", "S05"], "sep": ",", "columns": CANONICAL},
    "B": {"stores": ["S06", "S07", "S08", "S09"], "sep": ";", "columns": ["bill_no", "line_no", "item_code", "quantity", "rate", "type", "txn_time"]},
    "C": {"stores": ["S10", "S11", "S12"], "sep": ",", "columns": CANONICAL},
}

LINE_SCHEMA = T.StructType(
    [
        T.StructField("store_id", T.StringType()),
        T.StructField("business_date", T.DateType()),
        T.StructField("bill_no", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("product_code", T.StringType()),
        T.StructField("qty", T.DecimalType(12, 3)),
        T.StructField("unit_price", T.DecimalType(12, 2)),
        T.StructField("line_type", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("resend_no", T.IntegerType()),
    ]
)


def _time(column: str, dialect: str, already: bool) -> Column:
    if already:
        return F.col(column).cast("timestamp")
    if dialect == "A":
        return F.try_to_timestamp(F.col(column))
    if dialect == "B":
        return F.try_to_timestamp(F.col(column), F.lit("dd-MM-yyyy HH:mm:ss"))
    return F.timestamp_seconds(F.col(column).try_cast("bigint"))


def canonical(rows: DataFrame, dialect: str, file_name: Column) -> DataFrame:
    """The canonical columns of one dialect's rows; values that don't parse become null."""
    names = DIALECTS[dialect]["columns"]
    stamped = dict(rows.dtypes)[names[6]].startswith("timestamp")
    part = lambda k: F.regexp_extract(file_name, FILE_NAME, k)
    code, qty, price, kind = (F.col(names[k]) for k in (2, 3, 4, 5))
    return rows.select(
        part(1).alias("store_id"),
        F.try_to_date(part(2), "yyyyMMdd").alias("business_date"),
        F.col(names[0]).cast("string").alias("bill_no"),
        F.col(names[1]).try_cast("int").alias("line_no"),
        F.when(code.cast("string") != "", code.cast("string")).alias("product_code"),
        qty.try_cast("decimal(12,3)").alias("qty"),
        price.try_cast("decimal(12,2)").alias("unit_price"),
        F.upper(F.trim(kind.cast("string"))).alias("line_type"),
        _time(names[6], dialect, stamped).alias("ts"),
        file_name.alias("source_file"),
        F.coalesce(part(3).try_cast("int"), F.lit(0)).alias("resend_no"),
    )


def _paths(folder: str, dialect: str, kind: str) -> str:
    return f"{folder.rstrip('/')}/SALES_{{{','.join(DIALECTS[dialect]['stores'])}}}_*.{kind}"


def read_sales_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every export in a folder. CSV columns are taken by their header's names: dialect C has another order and a byte-order mark."""
    found: DataFrame | None = None
    for name, dialect in DIALECTS.items():
        for kind in ("csv", "parquet"):
            reader = spark.read.option("pathGlobFilter", f"SALES_*.{kind}")
            try:
                rows = reader.csv(_paths(folder, name, kind), sep=dialect["sep"], header=True, inferSchema=False) if kind == "csv" else reader.parquet(_paths(folder, name, kind))
            except Exception as error:  # a dialect without files of this kind
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                continue
            lines = canonical(rows, name, F.col("_metadata.file_name"))
            found = lines if found is None else found.unionByName(lines)
    return found if found is not None else spark.createDataFrame([], LINE_SCHEMA)
