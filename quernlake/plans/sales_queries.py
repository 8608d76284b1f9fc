"""The warehouse's queries over the stand-in lines, each with SQL of the same result. Money is summed as decimals, then given as double."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.operators import checks, plan_facts, sales
from quernlake.operators.evaluate import union_all
from quernlake.plans import stand_in as S
from quernlake.shared import new_path
from quernlake.sources import sales_files, warehouse
from quernlake.sources.tables import table

WITH_LINES = f"WITH {S.LINES_SQL} "
WITH_FACTS = f"WITH {S.LINES_SQL}, {S.PRODUCTS_SQL}, {S.FACTS_SQL} "
STORE, MONTH = "S01", "2000-10"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return sales.fact_sales(S.lines(spark, d), S.products(spark, d))


def _doubles(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("double") for c in columns})


def sales_revenue_by_month(spark: SparkSession, d: str) -> DataFrame:
    facts = S.lines(spark, d).select(F.col("business_month").alias("month"), sales.revenue().alias("revenue"))
    return _doubles(sales.revenue_by(facts, "month"), "revenue").orderBy("month")


def sales_revenue_by_store(spark: SparkSession, d: str) -> DataFrame:
    facts = S.lines(spark, d).select("store_id", sales.revenue().alias("revenue"))
    return _doubles(sales.revenue_by(facts, "store_id"), "revenue").orderBy(F.desc("revenue"), "store_id")


def sales_revenue_by_category(spark: SparkSession, d: str) -> DataFrame:
    categories = S.products(spark, d).select("category_id", F.concat(F.lit("Category "), "category_id").alias("category_name")).distinct()
    joined = _facts(spark, d).join(sales.dim_category(categories), "category_id")
    return _doubles(sales.revenue_by(joined, "category_name"), "revenue").orderBy(F.desc("revenue"), "category_name")


def sales_unassigned_revenue(spark: SparkSession, d: str) -> DataFrame:
    missing = F.col("category_id").isNull()
    return _facts(spark, d).agg(F.count(F.when(missing, 1)).alias("n_lines"), F.round(F.coalesce(F.sum(F.when(missing, F.col("revenue"))), F.lit(0)), 2).cast("double").alias("revenue"))


def sales_revenue_by_day_of_week(spark: SparkSession, d: str) -> DataFrame:
    days = sales.dim_date(S.lines(spark, d))
    joined = _facts(spark, d).join(days, "date_key")
    return _doubles(sales.revenue_by(joined, "day_of_week"), "revenue").orderBy(F.desc("revenue"), "day_of_week")


def sales_store_month_pruned(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "canonical-sales")
    sales.write_canonical(S.lines(spark, d).drop("business_month"), path)
    some = sales.read_canonical(spark, path, STORE, MONTH)
    return some.agg(F.count(F.lit(1)).alias("month_rows"), F.coalesce(F.sum(sales.revenue()), F.lit(0)).cast("double").alias("month_revenue"))


def sales_dedup_lines(spark: SparkSession, d: str) -> DataFrame:
    return sales.one_row_per_line(S.raw_lines(spark, d)).withColumns({"qty": F.col("qty").cast("double"), "unit_price": F.col("unit_price").cast("double")})


def sales_duplicate_identities(spark: SparkSession, d: str) -> DataFrame:
    return sales.duplicate_identities(S.raw_lines(spark, d))


def sales_resend_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return sales.resend_conflicts(S.raw_lines(spark, d))


def sales_void_keep_both(spark: SparkSession, d: str) -> DataFrame:
    return S.lines(spark, d).groupBy("bill_no").agg(F.sum(sales.revenue()).cast("double").alias("revenue"))


def sales_void_drop_bill(spark: SparkSession, d: str) -> DataFrame:
    return sales.without_void_bills(S.lines(spark, d)).groupBy("bill_no").agg(F.sum(sales.revenue()).cast("double").alias("revenue"))


def dim_date(spark: SparkSession, d: str) -> DataFrame:
    days = sales.dim_date(S.lines(spark, d))
    return days.select(F.col("date_key").cast("string").alias("date_key"), "month", "day_of_week", *[F.col(c).cast("bigint").alias(c) for c in ("day_of_month", "month_number", "year")])


def dim_product(spark: SparkSession, d: str) -> DataFrame:
    known = S.products(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("brand", "pack_size", "uom")})
    return sales.dim_product(known).withColumns({c: F.col(c).cast("string") for c in ("valid_from", "valid_to")}).drop("brand", "pack_size", "uom")


def dim_store(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and their nations stand in for stores."""
    where = table(spark, d, "nation")
    stores = table(spark, d, "supplier").join(where, F.col("s_nationkey") == F.col("n_nationkey"))
    named = stores.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("store_id"), F.col("s_name").alias("store_name"), F.col("n_name").alias("address_line"), F.col("n_name").alias("city"), F.col("n_regionkey").cast("string").alias("state"))
    return sales.dim_store(named)


def fact_sales_scd(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).select("store_id", F.col("date_key").cast("string").alias("date_key"), "product_sk", "category_id", "bill_no", "line_no", "product_code", F.col("qty").cast("double").alias("qty"), F.col("unit_price").cast("double").alias("unit_price"), "line_type", F.col("revenue").cast("double").alias("revenue"))


def fact_sales_scd_rowcount(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).agg(F.count(F.lit(1)).alias("facts"), F.count("product_sk").alias("with_product"), F.count_distinct("product_sk").alias("products"))


def product_reissues(spark: SparkSession, d: str) -> DataFrame:
    """Codes that were issued twice, with what each meant when."""
    known = S.products(spark, d)
    twice = known.groupBy("product_code").count().where("count > 1").select("product_code")
    found = known.join(twice, "product_code", "left_semi")
    return found.select("product_code", "product_name", "category_id", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to")).orderBy("product_code", "valid_from")


def historical_price_month(spark: SparkSession, d: str) -> DataFrame:
    found = sales.historical_price_revenue(S.lines(spark, d), S.products(spark, d), S.prices(spark, d), "2000-12-01", "2001-02-01")
    return _doubles(found, "revenue_at_historical_price")


def price_variance(spark: SparkSession, d: str) -> DataFrame:
    found = sales.price_variance(S.lines(spark, d), S.products(spark, d), S.prices(spark, d))
    return found.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("unit_price") - F.col("selling_price")).cast("double").alias("total_gap"))


def naive_code_join_fanout(spark: SparkSession, d: str) -> DataFrame:
    """What a join on the code alone does: lines of reissued codes count twice."""
    joined = S.lines(spark, d).join(S.products(spark, d).select("product_code", "product_sk"), "product_code", "left")
    return joined.agg(F.count(F.lit(1)).alias("joined_rows"), F.sum(sales.revenue()).cast("double").alias("joined_revenue"))


def cross_system_top_products(spark: SparkSession, d: str) -> DataFrame:
    return _doubles(sales.top_products(S.lines(spark, d), S.products(spark, d), STORE, MONTH), "revenue")


def load_audit_checksum(spark: SparkSession, d: str) -> DataFrame:
    return sales.checksum(S.lines(spark, d), ["bill_no", "line_no", "product_code", "qty", "unit_price", "line_type"])


def load_audit_runs(spark: SparkSession, d: str) -> DataFrame:
    """The same load twice: both runs have the same count and checksum."""
    path, audit = new_path(spark, "canonical-sales"), new_path(spark, "load-audit")
    lines = S.raw_lines(spark, d).withColumn("ts", F.col("business_date").cast("timestamp"))
    for run_id in (1, 2):
        runs = sales.load(lines, path, audit, run_id)
    return runs.select("run_id", "row_count", "checksum")


def finance_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Finance is the calculated revenue, changed in some months by known amounts."""
    facts = _facts(spark, d)
    month = F.month(F.to_date(F.concat("month", F.lit("-01"))))
    off = F.when(month == 3, F.lit(100)).when(month == 7, F.lit(0.009).cast("decimal(4,3)")).when(month == 12, F.lit(-0.01).cast("decimal(4,3)")).otherwise(F.lit(0))
    finance = sales.revenue_by(facts, sales.month_of("date_key").alias("month")).select("month", (F.col("revenue") + off).alias("finance_revenue"))
    found = sales.reconcile(facts, finance, {"2000-03": "KNOWN ORDER"})
    return _doubles(found, "calculated_revenue", "finance_revenue", "difference").orderBy("month")


def sales_missing_days(spark: SparkSession, d: str) -> DataFrame:
    return sales.missing_days(S.lines(spark, d)).select("store_id", F.col("business_date").cast("string").alias("business_date"))


def dialect_union(spark: SparkSession, d: str) -> DataFrame:
    """The lines as the three dialects' text, read as canonical lines, by store, month and re-send."""
    lines = S.lines(spark, d)
    found = union_all([sales_files.canonical(S.exported(lines, name), name, F.col("file_name")) for name in sales_files.DIALECTS])
    by = found.groupBy("store_id", sales.month_of("business_date").alias("month"), "resend_no")
    counted = by.agg(F.count(F.lit(1)).alias("n_lines"), F.count("product_code").alias("n_with_product"), F.sum("qty").alias("qty"), F.sum(sales.revenue()).alias("revenue"), F.max("ts").cast("string").alias("last_ts"))
    return _doubles(counted, "qty", "revenue")


def facts_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A table made of all facts, then replaced by those that have a product."""
    facts = _facts(spark, d)
    sales.replace_table(facts, "quernlake_facts")
    left = sales.replace_table(facts.where("product_sk IS NOT NULL"), "quernlake_facts")
    return left.agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("product_sk").alias("n_products"), F.coalesce(F.sum("revenue"), F.lit(0)).cast("double").alias("revenue"))


def table_statistics(spark: SparkSession, d: str) -> DataFrame:
    """What the catalogue knows of the table of lines after counting it."""
    sales.replace_table(S.lines(spark, d).select("bill_no", "line_no", "store_id"), "quernlake_lines")
    warehouse.analyse(spark, "quernlake_lines", ("line_no", "store_id"))
    return warehouse.statistics(spark, "quernlake_lines", ("line_no", "store_id")).drop("n_bytes")


def master_checks(spark: SparkSession, d: str) -> DataFrame:
    """Keys, references and ranges that a database would enforce, with the rows that break them."""
    orders, lineitem, customer, nation, documents, labels = (table(spark, d, x) for x in ("orders", "lineitem", "customer", "nation", "documents", "labels"))
    return union_all([
        checks.unique(orders, "orders", "o_orderkey"),
        checks.unique(lineitem, "lineitem", "l_orderkey", "l_linenumber"),
        checks.unique(lineitem, "lineitem", "l_orderkey"),
        checks.references(lineitem, "lineitem", "l_orderkey", orders, "o_orderkey"),
        checks.references(orders, "orders", "o_custkey", customer, "c_custkey"),
        checks.references(customer, "customer", "c_nationkey", nation, "n_nationkey"),
        checks.references(documents, "documents", "doc_id", labels, "doc_id"),
        checks.not_null(documents, "documents", "text"),
        checks.not_null(documents, "documents", "source"),
        checks.holds(lineitem, "lineitem", "l_quantity <= 40"),
    ])


def plan_pruning(spark: SparkSession, d: str) -> DataFrame:
    """What Spark plans for one store and month, for a total by store, and for a filter on a column in the files."""
    path = new_path(spark, "canonical")
    sales.write_canonical(S.lines(spark, d), path)
    kept = sales.read_canonical(spark, path)
    asked = {
        "store_month": sales.read_canonical(spark, path, STORE, MONTH).select("bill_no", "qty"),
        "by_store": kept.groupBy("store_id").agg(F.count(F.lit(1)).alias("n")),
        "in_files": kept.where("line_type = 'SALE'").select("bill_no", "line_type"),
    }
    rows = [(name, *plan_facts.summary(frame)) for name, frame in asked.items()]
    return spark.createDataFrame(rows, "query string, scans int, exchanges int, pruned_by string, pushed string, columns string")


def orders_by_segment(spark: SparkSession, d: str) -> DataFrame:
    """A star join of three tables."""
    orders = table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(15,2)").alias("price"))
    found = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return found.groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("price").cast("double").alias("total"))


def events_by_business_day(spark: SparkSession, d: str) -> DataFrame:
    """The trading day ends at half past one: events before that belong to the day before."""
    day = F.to_date(F.expr("ts - INTERVAL 90 MINUTES")).cast("string")
    return table(spark, d, "events").groupBy(day.alias("business_date"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


QUERIES = {f.__name__: f for f in (
    sales_revenue_by_month, sales_revenue_by_store, sales_revenue_by_category, sales_unassigned_revenue, sales_revenue_by_day_of_week, sales_store_month_pruned, sales_dedup_lines,
    sales_duplicate_identities, sales_resend_conflicts, sales_void_keep_both, sales_void_drop_bill, dim_date, dim_product, dim_store, fact_sales_scd, fact_sales_scd_rowcount, product_reissues,
    historical_price_month, price_variance, naive_code_join_fanout, cross_system_top_products, load_audit_checksum, load_audit_runs, finance_reconciliation, sales_missing_days, orders_by_segment, events_by_business_day,
    dialect_union, facts_replaced, table_statistics, master_checks, plan_pruning,
)}

_LINE_ORDER = "resend_no, source_file, store_id, business_date, product_code, qty, unit_price, line_type"
_CHECKSUM = "md5(concat(CAST(CAST(coalesce(sum(CAST(('0x' || substr(md5(concat_ws('|', {columns})), 1, 15))::BIGINT AS HUGEINT)), 0) AS DECIMAL(38,0)) AS VARCHAR), ':', CAST(count(*) AS VARCHAR)))"


def _checksum(*columns: str) -> str:
    return _CHECKSUM.format(columns=", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in columns))


_CANONICAL = _checksum("store_id", "business_date", "bill_no", "line_no", "product_code", "qty", "unit_price", "line_type", "concat(CAST(business_date AS VARCHAR), ' 00:00:00')", "source_file")
ORACLE = {
    "sales_revenue_by_month": WITH_LINES + f"SELECT business_month AS month, CAST(round(sum({S.REVENUE_SQL}), 2) AS DOUBLE) AS revenue FROM lines GROUP BY 1",
    "sales_revenue_by_store": WITH_LINES + f"SELECT store_id, CAST(round(sum({S.REVENUE_SQL}), 2) AS DOUBLE) AS revenue FROM lines GROUP BY 1",
    "sales_revenue_by_category": WITH_FACTS + "SELECT 'Category ' || category_id AS category_name, CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue FROM facts WHERE category_id IS NOT NULL GROUP BY 1",
    "sales_unassigned_revenue": WITH_FACTS + "SELECT count(*) FILTER (category_id IS NULL) AS n_lines, CAST(round(coalesce(sum(revenue) FILTER (category_id IS NULL), 0), 2) AS DOUBLE) AS revenue FROM facts",
    "sales_revenue_by_day_of_week": WITH_FACTS + "SELECT strftime(date_key, '%A') AS day_of_week, CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue FROM facts GROUP BY 1",
    "sales_store_month_pruned": WITH_LINES + f"SELECT count(*) AS month_rows, CAST(coalesce(sum({S.REVENUE_SQL}), 0) AS DOUBLE) AS month_revenue FROM lines WHERE store_id = '{STORE}' AND business_month = '{MONTH}'",
    "sales_dedup_lines": WITH_LINES + f"SELECT * EXCLUDE (qty, unit_price, k, business_month), CAST(qty AS DOUBLE) AS qty, CAST(unit_price AS DOUBLE) AS unit_price FROM (SELECT *, row_number() OVER (PARTITION BY bill_no, line_no ORDER BY {_LINE_ORDER}) AS k FROM lines) WHERE k = 1",
    "sales_duplicate_identities": WITH_LINES + "SELECT bill_no, line_no, count(*) AS duplicate_count FROM lines GROUP BY ALL HAVING count(*) > 1",
    "sales_resend_conflicts": WITH_LINES + "SELECT bill_no, line_no, count(*) AS copies FROM lines GROUP BY ALL HAVING count(DISTINCT (product_code, qty, unit_price, line_type)) > 1",
    "sales_void_keep_both": WITH_LINES + f"SELECT bill_no, CAST(sum({S.REVENUE_SQL}) AS DOUBLE) AS revenue FROM lines GROUP BY 1",
    "sales_void_drop_bill": WITH_LINES + f"SELECT bill_no, CAST(sum({S.REVENUE_SQL}) AS DOUBLE) AS revenue FROM lines WHERE bill_no NOT IN (SELECT bill_no FROM lines WHERE line_type = 'VOID') GROUP BY 1",
    "dim_date": WITH_LINES + "SELECT DISTINCT CAST(business_date AS VARCHAR) AS date_key, business_month AS month, strftime(business_date, '%A') AS day_of_week, extract(day FROM business_date) AS day_of_month, extract(month FROM business_date) AS month_number, extract(year FROM business_date) AS year FROM lines",
    "dim_product": f"WITH {S.PRODUCTS_SQL} SELECT product_sk, product_code, product_name, category_id, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to FROM products",
    "dim_store": "SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS store_id, s_name AS store_name, n_name AS address_line, n_name AS city, CAST(n_regionkey AS VARCHAR) AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "fact_sales_scd": WITH_FACTS + "SELECT store_id, CAST(date_key AS VARCHAR) AS date_key, product_sk, category_id, bill_no, line_no, product_code, CAST(qty AS DOUBLE) AS qty, CAST(unit_price AS DOUBLE) AS unit_price, line_type, CAST(revenue AS DOUBLE) AS revenue FROM facts",
    "fact_sales_scd_rowcount": WITH_FACTS + "SELECT count(*) AS facts, count(product_sk) AS with_product, count(DISTINCT product_sk) AS products FROM facts",
    "product_reissues": f"WITH {S.PRODUCTS_SQL} SELECT product_code, product_name, category_id, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to FROM products WHERE product_code IN (SELECT product_code FROM products GROUP BY 1 HAVING count(*) > 1)",
    "historical_price_month": f"WITH {S.LINES_SQL}, {S.PRODUCTS_SQL}, {S.PRICES_SQL} SELECT l.business_month AS reporting_month, CAST(round(sum(CASE WHEN l.line_type IN ('SALE', 'RETURN', 'VOID') THEN l.qty * r.selling_price ELSE 0 END), 2) AS DOUBLE) AS revenue_at_historical_price FROM lines l JOIN products p ON l.product_code = p.product_code AND l.business_date BETWEEN p.valid_from AND p.valid_to JOIN prices r ON p.product_sk = r.product_sk AND l.business_date BETWEEN r.effective_from AND r.effective_to WHERE l.business_date >= DATE '2000-12-01' AND l.business_date < DATE '2001-02-01' GROUP BY 1",
    "price_variance": f"WITH {S.LINES_SQL}, {S.PRODUCTS_SQL}, {S.PRICES_SQL} SELECT l.store_id, count(*) AS n_lines, CAST(sum(l.unit_price - r.selling_price) AS DOUBLE) AS total_gap FROM lines l JOIN products p ON l.product_code = p.product_code AND l.business_date BETWEEN p.valid_from AND p.valid_to JOIN prices r ON p.product_sk = r.product_sk AND l.business_date BETWEEN r.effective_from AND r.effective_to WHERE l.line_type = 'SALE' AND l.unit_price <> r.selling_price GROUP BY 1",
    "naive_code_join_fanout": f"WITH {S.LINES_SQL}, {S.PRODUCTS_SQL} SELECT count(*) AS joined_rows, CAST(sum({S.REVENUE_SQL}) AS DOUBLE) AS joined_revenue FROM lines LEFT JOIN products USING (product_code)",
    "cross_system_top_products": f"WITH {S.LINES_SQL}, {S.PRODUCTS_SQL} SELECT l.store_id, l.business_month, l.product_code, p.product_name, count(*) AS sales_lines, CAST(round(sum({S.REVENUE_SQL}), 2) AS DOUBLE) AS revenue FROM lines l JOIN products p ON l.product_code = p.product_code AND l.business_date BETWEEN p.valid_from AND p.valid_to WHERE store_id = '{STORE}' AND business_month = '{MONTH}' GROUP BY ALL ORDER BY revenue DESC, 3, 4 LIMIT 10",
    "load_audit_checksum": WITH_LINES + f"SELECT count(*) AS row_count, {_checksum('bill_no', 'line_no', 'product_code', 'qty', 'unit_price', 'line_type')} AS checksum FROM lines",
    "load_audit_runs": WITH_LINES + f"SELECT CAST(run AS INT) AS run_id, row_count, checksum FROM (SELECT count(*) AS row_count, {_CANONICAL} AS checksum FROM (SELECT *, row_number() OVER (PARTITION BY bill_no, line_no ORDER BY {_LINE_ORDER}) AS k FROM lines) WHERE k = 1), (VALUES (1), (2)) runs(run)",
    "finance_reconciliation": WITH_FACTS + "SELECT month, CAST(c AS DOUBLE) AS calculated_revenue, CAST(f AS DOUBLE) AS finance_revenue, CAST(round(f - c, 2) AS DOUBLE) AS difference, CASE WHEN abs(f - c) < 0.01 THEN 'MATCH' WHEN month = '2000-03' THEN 'KNOWN ORDER' ELSE 'INVESTIGATE PIPELINE' END AS classification FROM (SELECT month, c, c + CASE month[6:7] WHEN '03' THEN 100 WHEN '07' THEN CAST(0.009 AS DECIMAL(4,3)) WHEN '12' THEN CAST(-0.01 AS DECIMAL(4,3)) ELSE 0 END AS f FROM (SELECT strftime(date_key, '%Y-%m') AS month, round(sum(revenue), 2) AS c FROM facts GROUP BY 1))",
    "sales_missing_days": WITH_LINES + "SELECT s.store_id, CAST(CAST(d.day AS DATE) AS VARCHAR) AS business_date FROM (SELECT DISTINCT store_id FROM lines) s, (SELECT unnest(generate_series((SELECT min(business_date) FROM lines), (SELECT max(business_date) FROM lines), INTERVAL 1 DAY)) AS day) d WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.store_id = s.store_id AND l.business_date = CAST(d.day AS DATE))",
    "dialect_union": WITH_LINES + f"SELECT store_id, business_month AS month, resend_no, count(*) AS n_lines, count(*) FILTER (line_type <> 'DISCOUNT') AS n_with_product, CAST(sum(qty) AS DOUBLE) AS qty, CAST(sum({S.REVENUE_SQL}) AS DOUBLE) AS revenue, strftime(max(business_date), '%Y-%m-%d') || ' 10:00:00' AS last_ts FROM lines GROUP BY ALL",
    "facts_replaced": WITH_FACTS + "SELECT count(*) AS n_lines, count(DISTINCT product_sk) AS n_products, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS revenue FROM facts WHERE product_sk IS NOT NULL",
    "table_statistics": WITH_LINES + "SELECT 'quernlake_lines' AS table_name, n_rows, v.* FROM (SELECT count(*) AS n_rows, min(line_no) AS low, max(line_no) AS high, count(*) FILTER (line_no IS NULL) AS nulls, count(*) FILTER (store_id IS NULL) AS nulls_of_stores FROM lines) t, LATERAL (VALUES ('line_no', CAST(low AS VARCHAR), CAST(high AS VARCHAR), nulls), ('store_id', NULL, NULL, nulls_of_stores)) v(\"column\", low, high, nulls)",
    "master_checks": " UNION ALL ".join([
        "SELECT 'orders.o_orderkey unique' AS \"check\", count(o_orderkey) - count(DISTINCT o_orderkey) AS violations FROM orders",
        "SELECT 'lineitem.l_orderkey+l_linenumber unique', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL",
        "SELECT 'lineitem.l_orderkey unique', count(l_orderkey) - count(DISTINCT l_orderkey) FROM lineitem",
        "SELECT 'lineitem.l_orderkey references o_orderkey', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)",
        "SELECT 'orders.o_custkey references c_custkey', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey)",
        "SELECT 'customer.c_nationkey references n_nationkey', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE c_nationkey = n_nationkey)",
        "SELECT 'documents.doc_id references doc_id', count(*) FROM documents d WHERE d.doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "SELECT 'documents.text not null', count(*) FILTER (text IS NULL) FROM documents",
        "SELECT 'documents.source not null', count(*) FILTER (source IS NULL) FROM documents",
        "SELECT 'lineitem l_quantity <= 40', count(*) FILTER (l_quantity > 40) FROM lineitem",
    ]),
    "plan_pruning": "SELECT query, CAST(scans AS INT) AS scans, CAST(exchanges AS INT) AS exchanges, pruned_by, pushed, columns FROM (VALUES ('store_month', 1, 0, 'business_month,store_id', '', 'bill_no,qty'), ('by_store', 1, 1, '', '', ''), ('in_files', 1, 0, '', 'line_type', 'bill_no,line_type')) v(query, scans, exchanges, pruned_by, pushed, columns)",
    "orders_by_segment": "SELECT c_mktsegment, n_name, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "events_by_business_day": "SELECT CAST(CAST(ts - INTERVAL 90 MINUTE AS DATE) AS VARCHAR) AS business_date, event_type, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL",
}
