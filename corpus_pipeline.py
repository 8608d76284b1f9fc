"""A corpus from raw documents: each stage reads what the one before it kept and returns the columns of documents.

1. quality: documents that the hierarchical classifier rejects go.
2. lines: recurring line templates are dropped; a document of which nothing is left goes.
3. near_duplicates: of each class one document stays, that of the smallest id.
4. decontamination: documents that leak a benchmark item go.
5. tokens: encodes and decodes what is left.

A decision is about a row's id and text (quality: its source and language too), so of rows with one id and different texts each
has its own; of rows with one id and text near_duplicates leaves one. Null ids are ids like others, null texts count as empty:
quality and tokens treat them as texts without words, near_duplicates as copies of each other. An empty table stays empty, and
empty labels or benchmark tables reject nothing. Further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.llm import bag_minhash, line_templates, merge_automaton, site_quality, template_leaks
from quernlake.llm.queries import tokenizer_path
from quernlake.shared import write_shared
from quernlake.sources.tables import table


def _having(docs: DataFrame, found: DataFrame, **columns: Column) -> DataFrame:
    """The rows of docs that found has by id and MD5 of the text, and by the further columns given; null is an id like others."""
    own = {"doc_id": docs["doc_id"].cast("long"), "key": F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")))), **columns}
    found = found.select([F.col(c).alias(f"_found_{c}") for c in own]).distinct()
    return docs.join(found, reduce(Column.__and__, (x.eqNullSafe(found[f"_found_{c}"]) for c, x in own.items())), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = {k: F.coalesce(docs[c].cast("string"), F.lit("")) for k, c in (("host", "source"), ("path", "lang"))}
    return _having(docs, site_quality.verdicts(docs, table(spark, sf_dir, "labels")).where("kept"), **named)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring(docs)
    emptied = (F.col("n_dropped") > 0) & (F.trim(F.col("row.text")) == "")
    columns = [F.length("row.text").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return found.where(~emptied).select(columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = _having(docs, bag_minhash.classes(docs).where("kept"))
    again = kept.groupBy("doc_id", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_key"))  # rows of one id and text
    row = F.struct(*docs.columns)
    return again.agg(F.min_by(row, F.xxhash64(row)).alias("_row")).select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = template_leaks.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("items") == 0).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of each document that is left."""
    return merge_automaton.transcode_rows(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The classifier is fitted and signatures are drawn, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"stage-{name}").frame
    return STAGES[-1][1](spark, docs, sf_dir)
