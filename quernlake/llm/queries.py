"""The queries of these operators over their whole tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.llm import bag_minhash, block_names, class_lm, framed_ids, license_spans, line_templates, merge_automaton, site_quality, template_leaks, warc_archive
from quernlake.sources.tables import table

WORD_BPE = "word_bpe_49k.json"


def tokenizer_path() -> str:
    return public_tokenizers.path(WORD_BPE)


def _digests(batch: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray, decoded: pa.Array) -> pa.RecordBatch:
    runs = [hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    texts = [hashlib.sha256(memoryview(x.as_buffer())).hexdigest() for x in decoded]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(runs), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc_archive.write_archives(table(spark, sf_dir, "pages"))
    return warc_archive.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op2_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_automaton.transcode(table(spark, sf_dir, "documents"), tokenizer_path(), _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.coalesce("row.text", F.lit("")).alias("text"))


def op8_license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans.license_spans(table(spark, sf_dir, "documents"))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(table(spark, sf_dir, "documents"))


def op10_framed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = framed_ids.write_records(table(spark, sf_dir, "documents"), tokenizer_path())
    return framed_ids.read_records(files, framed_ids.crc32_of, "doc_id long, start long, n_tokens long, ids_crc32 long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_archive": op1_warc_archive,
        "op2_bag_minhash": op2_bag_minhash,
        "op3_bpe_automaton": op3_bpe_automaton,
        "op4_site_quality": op4_site_quality,
        "op5_template_leaks": op5_template_leaks,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_line_templates": op7_line_templates,
        "op8_license_spans": op8_license_spans,
        "op9_class_lm": op9_class_lm,
        "op10_framed_ids": op10_framed_ids,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_archive": OP1_SQL, "op6_exact_dedup": OP6_SQL}
