"""WARC archives and exact duplicates."""

import hashlib
from collections import Counter

import pytest
from compare import assert_same
from pyspark.sql import functions as F

from quernlake.llm import block_names, queries, warc_archive

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    magic = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(k, f"http://h/{k}%20ü?a=b c", "<p>" + magic * (k % 5) + "x" * k + "</p>") for k in range(60)]
    rows += [(100, "u", "y" * 200), (99, "u", "y" * 200), (101, None, "y" * 200), (102, "u", "small"), (103, "u", "small"), (104, "u", None), (105, "u", ""), (None, "u", "y" * 200), (99, "u", "y" * 200), (106, "u", magic * 4000)]
    return spark.createDataFrame([(*r, "f", 1, 2) for r in rows], "page_id long, url string, html string, file string, at int, chunk int")


@pytest.mark.parametrize("chunk", [300, 4096, 1 << 20])
def test_only_real_records_are_read(pages, chunk):
    files = warc_archive.write_archives(pages, file_bytes=20_000)
    got = warc_archive.read_archives(files, chunk_bytes=chunk).collect()
    want = Counter((r.page_id, r.url, hashlib.sha256((r.html or "").encode()).hexdigest(), len((r.html or "").encode())) for r in pages.collect())
    assert Counter((r.page_id, r.url, r.payload_digest, r.payload_bytes) for r in got) == want
    revisits = {r.page_id: r.refers_to for r in got if r.record_type == "revisit"}
    assert revisits == {100: 99, 101: 99, **{k: 0 for k in ()}} | {k: v for k, v in revisits.items() if k not in (99, 100, 101, 102, 103, None)}
    assert all(r.record_type == "response" and r.refers_to is None for r in got if r.page_id in (99, 102, 103, 104, 105, None))
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")


def test_candidates_hold_false_records_which_the_chain_rejects(pages):
    files = warc_archive._numbered(warc_archive.write_archives(pages, file_bytes=1 << 30))
    candidates, records = warc_archive.record_links(files).count(), pages.count()
    assert candidates > records


def test_a_broken_chain_is_an_error(spark, tmp_path):
    good = warc_archive.record_bytes(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    path = tmp_path / "x.warc"
    path.write_bytes(good + b"garbage")
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "file string, bytes long")
    with pytest.raises(ValueError):
        warc_archive.read_archives(files).count()


@pytest.mark.parametrize("digits", ["99999999999999999999", "9" * 5000, "99999999999"])
def test_payloads_that_claim_a_long_record(spark, digits):
    hostile = f"<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {digits}\r\n\r\nabc\r\n\r\n</p>" * 3
    pages = spark.createDataFrame([(k, "u", hostile + str(k)) for k in range(5)], "page_id long, url string, html string")
    got = warc_archive.read_archives(warc_archive.write_archives(pages), chunk_bytes=500).collect()
    assert {r.page_id: r.payload.decode() for r in got} == {k: hostile + str(k) for k in range(5)}


def test_pages_without_an_id_are_responses_in_the_sql_too(spark, tmp_path):
    rows = [(None, "u", "y" * 200), (None, "u", "y" * 200), (3, "u", "y" * 200), (4, "u", "y" * 200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert assert_same(queries.op1_warc_archive(spark, str(tmp_path)), queries.OP1_SQL, str(tmp_path)) == 4


def test_no_pages(spark, pages):
    assert warc_archive.read_archives(warc_archive.write_archives(pages.where("false"))).count() == 0


def test_archive_query(spark):
    assert assert_same(queries.op1_warc_archive(spark, SF), queries.OP1_SQL, SF) == 50


def copies_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.octet_length(c).cast("long") % 2])
@pytest.mark.parametrize("block", [3, 8, 4096])
def test_exact_copies(documents, odd, block, hashed):
    """Also with a hash that nearly all blocks share: names stay free of collisions."""
    rows = [(k, "abc" * (k % 4) + "d" * (k % 3)) for k in range(40)] + [(50, "x" * 17), (51, "x" * 16 + "y"), (52, "x" * 17), (53, None), (54, ""), (54, ""), (None, "q"), (None, "q")]
    got = block_names.exact_duplicates(documents(rows), block_bytes=block, hashed=hashed).collect()
    assert Counter(map(tuple, got)) == copies_by_hand(rows)


def test_exact_copies_of_odd_rows(odd, nothing):
    got = block_names.exact_duplicates(odd).collect()
    assert Counter(map(tuple, got)) == copies_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    assert block_names.exact_duplicates(nothing).count() == 0


def test_exact_copies_query(spark):
    assert assert_same(queries.op6_exact_dedup(spark, SF), queries.OP6_SQL, SF) == 200
