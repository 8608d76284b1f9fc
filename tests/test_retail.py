"""Dialects, re-sends, validity dates, partitioned writes, audit and reconciliation on small literal rows."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quernlake.operators import sales
from quernlake.sources import masters, sales_files

A = "bill_no,line_no,product_code,qty,unit_price,line_type,ts\n"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sales")
    (at / "SALES_S01_20240531.csv").write_text(A + "B1,1,P1,2,10.00,SALE,2024-05-31T13:45:02\nB1,2,,1,-1.50,DISCOUNT,2024-05-31T13:45:02\nB1,3,,1,18.50,TENDER,2024-06-01T00:40:00\nB2,1,P1,1,5.00,SALE,2024-05-31T14:00:00\nB2,2,P1,-1,5.00,VOID,2024-05-31T14:00:00\n")
    (at / "SALES_S01_20240531__R1.csv").write_text(A + "B1,1,P1,2,11.00,SALE,2024-05-31T13:45:02\n")
    (at / "SALES_S06_20240601.csv").write_text("bill_no;line_no;item_code;quantity;rate;type;txn_time\nB3;1;P1;1.5;10;SALE;01-06-2024 09:00:00\n")
    (at / "SALES_S10_20240601.csv").write_bytes("﻿ts,line_type,unit_price,qty,product_code,line_no,bill_no\n1717232400,RETURN,10.00,-1,P2,1,B4\nbad,SALE,x,1,P2,2,B4\n".encode())
    rows = [("B5", 1, "P1", Decimal("1.000"), Decimal("3.00"), "SALE", datetime(2024, 6, 1, 8))]
    spark.createDataFrame(rows, "bill_no string, line_no int, product_code string, qty decimal(12,3), unit_price decimal(12,2), line_type string, ts timestamp").coalesce(1).write.parquet(str(at / "p"))
    next((at / "p").glob("part-*.parquet")).rename(at / "SALES_S02_20240601.parquet")
    return str(at)


@pytest.fixture(scope="module")
def lines(spark, folder):
    return sales_files.read_sales_files(spark, folder)


def test_dialects(lines):
    got = {(r.bill_no, r.line_no, r.resend_no): r for r in lines.collect()}
    assert len(got) == 10
    assert got["B1", 3, 0].business_date == date(2024, 5, 31)  # the file's name wins over the next day's time
    b3 = got["B3", 1, 0]
    assert (b3.store_id, b3.product_code, b3.qty, b3.unit_price, b3.ts) == ("S06", "P1", Decimal("1.500"), Decimal("10.00"), datetime(2024, 6, 1, 9))
    b4 = got["B4", 1, 0]
    assert (b4.store_id, b4.qty, b4.line_type, b4.ts) == ("S10", Decimal("-1.000"), "RETURN", datetime(2024, 6, 1, 9))
    assert got["B4", 2, 0].unit_price is None and got["B4", 2, 0].ts is None
    assert got["B1", 2, 0].product_code is None and got["B5", 1, 0].source_file == "SALES_S02_20240601.parquet"
    assert lines.schema.fieldNames() == sales_files.LINE_SCHEMA.fieldNames()


def test_no_files(spark, tmp_path):
    assert sales_files.read_sales_files(spark, str(tmp_path)).count() == 0


def test_resends_neither_duplicate_nor_delete(lines):
    once = sales.one_row_per_line(lines)
    got = {(r.bill_no, r.line_no): r.unit_price for r in once.collect()}
    assert len(got) == once.count() == 9 and got["B1", 1] == Decimal("10.00")
    assert [tuple(r) for r in sales.resend_conflicts(lines).collect()] == [("B1", 1, 2)]
    assert sales.duplicate_identities(once).count() == 0


def test_both_void_rules_agree(lines):
    once = sales.one_row_per_line(lines).where("store_id = 'S01'")
    total = lambda x: x.agg(F.sum(sales.revenue())).first()[0]
    assert total(once) == total(sales.without_void_bills(once)) == Decimal("18.50")


def test_partitions_are_pruned_and_reloads_change_nothing(spark, lines, tmp_path):
    path, audit = str(tmp_path / "c"), str(tmp_path / "a")
    runs = [sales.load(lines, path, audit, k) for k in (1, 2)][-1].collect()
    assert len(runs) == 2 and len({(r.row_count, r.checksum) for r in runs}) == 1 and runs[0].row_count == 9
    some = sales.read_canonical(spark, path, "S01", "2024-05")
    assert some.count() == 5 and "PartitionFilters: [isnotnull" in some._jdf.queryExecution().toString()
    assert sales.read_partition(spark, path, "S01", "2024-05").select("store_id", "business_month").distinct().collect() == [("S01", "2024-05")]


def test_validity_dates(spark, lines):
    day = date.fromisoformat
    products = spark.createDataFrame([(1, "P1", "C06", day("2019-04-01"), day("2024-05-31")), (2, "P1", "C13", day("2024-06-01"), day("9999-12-31"))], "product_sk long, product_code string, category_id string, valid_from date, valid_to date")
    once = sales.one_row_per_line(lines)
    facts = sales.fact_sales(once, products)
    assert facts.count() == once.count()
    got = {(r.bill_no, r.line_no): r.category_id for r in facts.collect()}
    assert (got["B1", 1], got["B3", 1], got["B4", 1]) == ("C06", "C13", None)
    prices = spark.createDataFrame([(2, Decimal("7.00"), day("2023-12-01"), day("2024-06-13")), (1, Decimal("9.00"), day("2019-01-01"), day("9999-12-31"))], "product_sk long, selling_price decimal(12,2), effective_from date, effective_to date")
    found = sales.historical_price_revenue(once, products, prices, "2024-06-01", "2024-07-01").collect()
    assert [(r[0], r[1]) for r in found] == [("2024-06", Decimal("17.50"))]
    assert sales.price_variance(once, products, prices).count() == 4


@pytest.mark.parametrize(("gap", "month", "label"), [("0.00", "2024-01", "MATCH"), ("0.009", "2024-01", "MATCH"), ("0.01", "2024-01", "INVESTIGATE PIPELINE"), ("-50.48", "2024-12", sales.KNOWN_EXCEPTIONS["2024-12"]), ("5", "2024-07", sales.KNOWN_EXCEPTIONS["2024-07"])])
def test_reconciliation_classes(spark, gap, month, label):
    facts = spark.createDataFrame([(date.fromisoformat(f"{month}-05"), Decimal("100.00"))], "date_key date, revenue decimal(14,2)")
    finance = spark.createDataFrame([(month, Decimal("100") + Decimal(gap))], "month string, finance_revenue decimal(14,3)")
    assert sales.reconcile(facts, finance).first().classification == label


def test_finance_file_and_gaps(spark, lines, tmp_path):
    (tmp_path / "f.csv").write_text("month,closed_on,revenue_inr,signed_off_by\n2024-01,2024-02-09,38446071.33,X (Y)\n")
    assert tuple(masters.read_finance(spark, str(tmp_path / "f.csv")).first()) == ("2024-01", Decimal("38446071.33"))
    assert {(r.store_id, str(r.business_date)) for r in sales.missing_days(sales.one_row_per_line(lines)).collect()} == {("S01", "2024-06-01"), ("S06", "2024-05-31"), ("S10", "2024-05-31"), ("S02", "2024-05-31")}


def test_script_of_inserts(spark, tmp_path):
    (tmp_path / "m.sql").write_text("CREATE TABLE stores (x int);\nINSERT INTO stores VALUES\n('S01','O''Brien; (Sons)','1 A, B','C','D','E',100,'2020-01-01'),\n('S02',NULL,'x','y','z','w',5,'2021-01-01');\nINSERT INTO public.product_categories (a,b,c,d) VALUES ('C1','n','d',0.050);")
    got = masters.load_script(spark, str(tmp_path / "m.sql"))
    rows = got["stores"].orderBy("store_id").collect()
    assert (rows[0].store_name, rows[0].floor_area_sqft, rows[0].opened_on, rows[1].store_name) == ("O'Brien; (Sons)", 100, date(2020, 1, 1), None)
    assert got["product_categories"].first().gst_rate == Decimal("0.050") and got["products"].count() == 0


def test_checksum_ignores_order_and_sees_copies(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    same = sales.checksum(rows).first()
    assert same == sales.checksum(rows.orderBy(F.desc("x"))).first()
    assert same.checksum != sales.checksum(rows.distinct()).first().checksum
    assert sales.checksum(rows.where("false")).first().row_count == 0


def test_object_store_settings():
    assert masters.object_store_settings("http://h:9000", "k", "s")["spark.hadoop.fs.s3a.path.style.access"] == "true"
