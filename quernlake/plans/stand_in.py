"""Sales lines and masters derived from the test tables, the same way in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.sources.sales_files import DIALECTS
from quernlake.sources.tables import table

SPLIT = "2001-06-01"

_LINES = {
    "store_id": "concat('S', lpad(CAST(l_suppkey % 12 + 1 AS {text}), 2, '0'))",
    "business_date": "CAST(l_shipdate AS DATE)",
    "bill_no": "concat('B', CAST(l_orderkey AS {text}))",
    "line_no": "CAST(l_linenumber AS INT)",
    "product_code": "concat('P', CAST(l_partkey AS {text}))",
    "qty": "CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 1 ELSE l_quantity END AS DECIMAL(12,3))",
    "unit_price": "CAST(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN -l_discount * 1000 ELSE l_extendedprice END AS DECIMAL(12,2))",
    "line_type": "CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'F' THEN 'SALE' ELSE 'DISCOUNT' END WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'RETURN' ELSE 'VOID' END WHEN l_linestatus = 'O' THEN 'SALE' WHEN l_tax >= 0.04 THEN 'TENDER' ELSE 'TAX' END",
    "resend_no": "CAST(l_suppkey % 3 AS INT)",
    "source_file": "concat('SALES_', CAST(l_suppkey AS {text}))",
}
_PRODUCTS = """
SELECT p_partkey AS product_sk, concat('P', CAST(p_partkey AS {text})) AS product_code, p_name AS product_name, p_brand AS category_id,
       DATE '1990-01-01' AS valid_from, CASE WHEN p_partkey % 50 = 0 THEN DATE '{split}' - INTERVAL 1 DAY ELSE DATE '9999-12-31' END AS valid_to
FROM part
UNION ALL
SELECT p_partkey + 1000000000, concat('P', CAST(p_partkey AS {text})), concat('new ', p_name), p_type, DATE '{split}', DATE '9999-12-31' FROM part WHERE p_partkey % 50 = 0
"""
_PRICES = """
SELECT product_sk * 10 + 1 AS revision_id, product_sk, CAST(1 + product_sk % 97 AS DECIMAL(12,2)) AS selling_price, DATE '1990-01-01' AS effective_from, DATE '2000-12-31' AS effective_to FROM products
UNION ALL
SELECT product_sk * 10 + 2, product_sk, CAST(2 + product_sk % 89 AS DECIMAL(12,2)), DATE '2001-01-01', DATE '9999-12-31' FROM products
"""


def _lines_select(text: str) -> str:
    return "SELECT " + ", ".join(f"{x.format(text=text)} AS {c}" for c, x in _LINES.items()) + " FROM lineitem"


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as they come, with repeated identities."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{x.format(text='STRING')} AS {c}" for c, x in _LINES.items()])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the month that the canonical layout adds."""
    return raw_lines(spark, sf_dir).withColumn("business_month", F.date_format("business_date", "yyyy-MM"))


def exported(lines: DataFrame, dialect: str) -> DataFrame:
    """Rows of one dialect's exports as its files hold them: text under its column names, with the name of the file. The till closes at ten."""
    columns = DIALECTS[dialect]["columns"]
    time = F.col("business_date").cast("timestamp") + F.expr("INTERVAL 10 HOURS")
    written = {"A": F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), "B": F.date_format(time, "dd-MM-yyyy HH:mm:ss"), "C": F.unix_timestamp(time).cast("string")}[dialect]
    code = F.when(F.col("line_type") == "DISCOUNT", F.lit("")).otherwise(F.col("product_code"))
    values = ["bill_no", F.col("line_no").cast("string"), code, F.col("qty").cast("string"), F.col("unit_price").cast("string"), F.concat(F.lit(" "), F.lower("line_type")), written]
    again = F.when(F.col("resend_no") > 0, F.concat(F.lit("__R"), F.col("resend_no").cast("string"))).otherwise(F.lit(""))
    name = F.concat(F.lit("SALES_"), "store_id", F.lit("_"), F.date_format("business_date", "yyyyMMdd"), again, F.lit(".csv"))
    rows = lines.where(F.col("store_id").isin(DIALECTS[dialect]["stores"]))
    return rows.select(*[(F.col(v) if isinstance(v, str) else v).alias(c) for v, c in zip(values, columns, strict=True)], name.alias("file_name"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    code = F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product_code")
    split, open_end = F.lit(SPLIT).cast("date"), F.lit("9999-12-31").cast("date")
    reissued = F.col("p_partkey") % 50 == 0
    first = parts.select(F.col("p_partkey").alias("product_sk"), code, F.col("p_name").alias("product_name"), F.col("p_brand").alias("category_id"), F.lit("1990-01-01").cast("date").alias("valid_from"), F.when(reissued, F.date_sub(split, 1)).otherwise(open_end).alias("valid_to"))
    again = parts.where(reissued).select((F.col("p_partkey") + 1_000_000_000).alias("product_sk"), code, F.concat(F.lit("new "), "p_name").alias("product_name"), F.col("p_type").alias("category_id"), split.alias("valid_from"), open_end.alias("valid_to"))
    return first.unionByName(again)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two revisions of each product; those of a reissued code's product begin before it does."""
    known = products(spark, sf_dir)
    sk, day = F.col("product_sk"), lambda d, name: F.lit(d).cast("date").alias(name)
    early = known.select((sk * 10 + 1).alias("revision_id"), sk, (1 + sk % 97).cast("decimal(12,2)").alias("selling_price"), day("1990-01-01", "effective_from"), day("2000-12-31", "effective_to"))
    late = known.select((sk * 10 + 2).alias("revision_id"), sk, (2 + sk % 89).cast("decimal(12,2)").alias("selling_price"), day("2001-01-01", "effective_from"), day("9999-12-31", "effective_to"))
    return early.unionByName(late)


#: CTEs for DuckDB: lines, products, prices.
LINES_SQL = f"raw_lines AS ({_lines_select('VARCHAR')}), lines AS (SELECT *, strftime(business_date, '%Y-%m') AS business_month FROM raw_lines)"
PRODUCTS_SQL = f"products AS (SELECT product_sk, product_code, product_name, category_id, CAST(valid_from AS DATE) AS valid_from, CAST(valid_to AS DATE) AS valid_to FROM ({_PRODUCTS.format(text='VARCHAR', split=SPLIT)}))"
PRICES_SQL = f"prices AS ({_PRICES})"
REVENUE_SQL = "CASE WHEN line_type IN ('SALE', 'RETURN', 'DISCOUNT', 'VOID') THEN qty * unit_price ELSE 0 END"
FACTS_SQL = f"""facts AS (SELECT l.store_id, l.business_date AS date_key, p.product_sk, p.category_id, l.bill_no, l.line_no, l.product_code, l.qty, l.unit_price, l.line_type, {REVENUE_SQL} AS revenue
FROM lines l LEFT JOIN products p ON l.product_code = p.product_code AND l.business_date BETWEEN p.valid_from AND p.valid_to)"""
