"""The retail warehouse: revenue, line identity, joins by validity date, the star schema, audit and reconciliation.

Masters (stores, categories, products, prices) are dimension tables. They are joined by equality with the validity range as
a further condition, so Catalyst broadcasts them while they are small and shuffles by key once they are not; no hint forces it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.shared import new_path

# The line types that count as revenue, and those that a list price applies to.
REVENUE_TYPES = ["SALE", "RETURN", "DISCOUNT", "VOID"]
PRICED_TYPES = ["SALE", "RETURN", "VOID"]
# The classes of a reconciliation, and the months with a known reason.
MATCH, UNKNOWN = "MATCH", "INVESTIGATE PIPELINE"
KNOWN_EXCEPTIONS = {
    "2024-03": "SOURCE / OUTSIDE-TILL INSTITUTIONAL ORDER",
    "2024-07": "SOURCE DATA GAP / S07 MISSING DAYS",
    "2024-12": "REVENUE DEFINITION / ROUNDING",
}
LINE_COLUMNS = ["store_id", "business_date", "bill_no", "line_no", "product_code", "qty", "unit_price", "line_type", "ts", "source_file"]


def revenue() -> Column:
    """Quantity times printed price of a line that counts, else 0. Tax and the tender, which is the bill's total again, don't."""
    return F.when(F.col("line_type").isin(REVENUE_TYPES), F.col("qty") * F.col("unit_price")).otherwise(F.lit(0))


def month_of(date: str | Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def one_row_per_line(lines: DataFrame, identity: tuple[str, ...] = ("bill_no", "line_no"), order: tuple[str, ...] = ("resend_no", "source_file")) -> DataFrame:
    """One row for each line over an original and its re-sends, whole or partial; of several, the first in `order`.

    Ties are broken by the other columns, so equal input gives equal output. A grouped minimum, pre-aggregated before
    the shuffle: no key's rows are ever sorted or held together.
    """
    rest = [c for c in lines.columns if c not in identity and c not in order]
    first = lines.groupBy(*identity).agg(F.min(F.struct(*order, *rest)).alias("first"))
    return first.select(*[F.col(c) if c in identity else F.col(f"first.{c}").alias(c) for c in lines.columns])


def resend_conflicts(lines: DataFrame, identity: tuple[str, ...] = ("bill_no", "line_no"), payload: tuple[str, ...] = ("product_code", "qty", "unit_price", "line_type")) -> DataFrame:
    """Lines whose copies differ in what they say."""
    said = F.struct(*payload)
    return lines.groupBy(*identity).agg(F.count(F.lit(1)).alias("copies"), F.min(said).alias("low"), F.max(said).alias("high")).where("low != high").select(*identity, "copies")


def duplicate_identities(lines: DataFrame, identity: tuple[str, ...] = ("bill_no", "line_no")) -> DataFrame:
    return lines.groupBy(*identity).agg(F.count(F.lit(1)).alias("duplicate_count")).where("duplicate_count > 1")


def without_void_bills(lines: DataFrame) -> DataFrame:
    """Drops every line of a bill that has a VOID line; keeping both sides of it gives the same revenue."""
    return lines.join(lines.where("line_type = 'VOID'").select("bill_no").distinct(), "bill_no", "left_anti")


def write_canonical(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by store and month. Only the partitions that occur are replaced, so a load can be repeated.

    The rebalancing shuffle makes few files for a partition and splits a hot one over several.
    """
    rows = lines.withColumn("business_month", month_of("business_date")).hint("rebalance", "store_id", "business_month")
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("store_id", "business_month").parquet(path)


def read_canonical(spark: SparkSession, path: str, store: str | None = None, month: str | None = None) -> DataFrame:
    """The lines under a path; with a store and a month, Spark lists all partitions but opens the files of one."""
    rows = spark.read.parquet(path)
    if store:
        rows = rows.where(F.col("store_id") == store)
    return rows.where(F.col("business_month") == month) if month else rows


def read_partition(spark: SparkSession, path: str, store: str, month: str) -> DataFrame:
    """One partition by its own path, with the partition's columns."""
    return spark.read.option("basePath", path).parquet(f"{path}/store_id={store}/business_month={month}")


def valid_on(rows: DataFrame, masters: DataFrame, key: str, date: str, since: str, until: str, how: str = "left") -> DataFrame:
    """Joins the row of a master that was valid on the date: by key, with the closed range as a further condition."""
    right = masters.withColumnRenamed(key, "_key")
    return rows.join(right, (F.col(key) == F.col("_key")) & F.col(date).between(F.col(since), F.col(until)), how).drop("_key")


def fact_sales(lines: DataFrame, products: DataFrame) -> DataFrame:
    """A fact for each line, with the product that its code meant on that day, if any."""
    known = products.select("product_sk", "product_code", "category_id", "valid_from", "valid_to")
    joined = valid_on(lines, known, "product_code", "business_date", "valid_from", "valid_to")
    return joined.select("store_id", F.col("business_date").alias("date_key"), "product_sk", "category_id", "bill_no", "line_no", "product_code", "qty", "unit_price", "line_type", revenue().alias("revenue"))


def dim_date(lines: DataFrame) -> DataFrame:
    days = lines.select(F.col("business_date").alias("date_key")).distinct()
    return days.select("date_key", month_of("date_key").alias("month"), F.date_format("date_key", "EEEE").alias("day_of_week"), F.day("date_key").alias("day_of_month"), F.month("date_key").alias("month_number"), F.year("date_key").alias("year"))


def dim_store(stores: DataFrame) -> DataFrame:
    return stores.select("store_id", "store_name", "address_line", "city", "state")


def dim_category(categories: DataFrame) -> DataFrame:
    return categories.select("category_id", "category_name")


def dim_product(products: DataFrame) -> DataFrame:
    return products.select("product_sk", "product_code", "product_name", "category_id", "brand", "pack_size", "uom", "valid_from", "valid_to")


def revenue_by(facts: DataFrame, *keys: Column | str) -> DataFrame:
    return facts.groupBy(*keys).agg(F.round(F.sum("revenue"), 2).alias("revenue"))


def historical_price_revenue(lines: DataFrame, products: DataFrame, prices: DataFrame, since: str, until: str) -> DataFrame:
    """Revenue by month at the list price of the day, over [since, until): the product by code and day, then its price by day.

    Both ranges are needed: prices of a reissued code's product begin before it, and those of the retired one go on after it.
    """
    days = lines.where((F.col("business_date") >= F.lit(since).cast("date")) & (F.col("business_date") < F.lit(until).cast("date")))
    of_product = valid_on(days, products.select("product_code", "product_sk", "valid_from", "valid_to"), "product_code", "business_date", "valid_from", "valid_to", "inner")
    priced = valid_on(of_product, prices.select("product_sk", "selling_price", "effective_from", "effective_to"), "product_sk", "business_date", "effective_from", "effective_to", "inner")
    at_list = F.when(F.col("line_type").isin(PRICED_TYPES), F.col("qty") * F.col("selling_price")).otherwise(F.lit(0))
    return priced.groupBy(month_of("business_date").alias("reporting_month")).agg(F.round(F.sum(at_list), 2).alias("revenue_at_historical_price"))


def price_variance(lines: DataFrame, products: DataFrame, prices: DataFrame) -> DataFrame:
    """Sale lines whose printed price is not the list price of the day."""
    of_product = valid_on(lines.where("line_type = 'SALE'"), products.select("product_code", "product_sk", "valid_from", "valid_to"), "product_code", "business_date", "valid_from", "valid_to", "inner")
    priced = valid_on(of_product, prices.select("product_sk", "selling_price", "effective_from", "effective_to"), "product_sk", "business_date", "effective_from", "effective_to", "inner")
    return priced.where("unit_price != selling_price")


def top_products(lines: DataFrame, products: DataFrame, store: str, month: str, n: int = 10) -> DataFrame:
    """The products with the most revenue in a store and month. Ties go by code and name, so the rows are fixed."""
    some = lines.where((F.col("store_id") == store) & (F.col("business_month") == month))
    joined = valid_on(some, products.select("product_code", "product_name", "valid_from", "valid_to"), "product_code", "business_date", "valid_from", "valid_to", "inner")
    found = joined.groupBy("store_id", "business_month", "product_code", "product_name").agg(F.count(F.lit(1)).alias("sales_lines"), F.round(F.sum(revenue()), 2).alias("revenue"))
    return found.orderBy(F.desc("revenue"), "product_code", "product_name").limit(n)


def row_number_of(*columns: str) -> Column:
    """A number for a row's content that any engine with MD5 can repeat: 60 bits of the digest over its columns as text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def checksum(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(row_count, checksum): a sum over row digests, so the order of the rows doesn't matter and each copy counts."""
    total = F.coalesce(F.sum(row_number_of(*(columns or rows.columns))), F.lit(0)).cast("decimal(38,0)")
    count = F.count(F.lit(1))
    return rows.agg(count.alias("row_count"), F.md5(F.concat(total.cast("string"), F.lit(":"), count.cast("string"))).alias("checksum"))


def append_audit(rows: DataFrame, path: str, run_id: int, columns: list[str] | None = None) -> DataFrame:
    """Adds a run to the audit table and returns that table; equal loads have equal checksums."""
    run = checksum(rows, columns).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("run_time"), "row_count", "checksum")
    run.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def reconcile(facts: DataFrame, finance: DataFrame, known: dict[str, str] = KNOWN_EXCEPTIONS) -> DataFrame:
    """Calculated against finance revenue by month, with the class of the difference."""
    calculated = facts.groupBy(month_of("date_key").alias("month")).agg(F.round(F.sum("revenue"), 2).alias("calculated_revenue"))
    gap = F.col("finance_revenue") - F.col("calculated_revenue")
    reason = reduce(lambda found, item: found.when(F.col("month") == item[0], item[1]), known.items(), F.when(F.abs(gap) < 0.01, MATCH)).otherwise(UNKNOWN)
    return calculated.join(finance, "month").select("month", "calculated_revenue", "finance_revenue", F.round(gap, 2).alias("difference"), reason.alias("classification"))


def replace_table(rows: DataFrame, name: str) -> DataFrame:
    """CREATE OR REPLACE TABLE AS: the named table has these rows only, in a new folder; the rows must not read the table itself."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("path", new_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def missing_days(lines: DataFrame) -> DataFrame:
    """(store_id, business_date) without a line, between the first and the last day of all sales."""
    low, high = lines.agg(F.min("business_date"), F.max("business_date")).first()
    days = lines.groupBy("store_id").agg(F.collect_set("business_date").alias("seen"))
    missing = F.array_except(F.sequence(F.lit(low).cast("date"), F.lit(high).cast("date")), "seen")
    return days.select("store_id", F.explode(missing).alias("business_date"))


def load(lines: DataFrame, path: str, audit_path: str | None = None, run_id: int = 1) -> DataFrame:
    """A whole load: one row per line, written by store and month, with a run in the audit. Doing it again changes no data."""
    spark = lines.sparkSession
    write_canonical(one_row_per_line(lines).select(*LINE_COLUMNS), path)
    return append_audit(read_canonical(spark, path), audit_path or new_path(spark, "load-audit"), run_id, LINE_COLUMNS)
