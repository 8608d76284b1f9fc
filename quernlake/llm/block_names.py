"""Exact duplicates by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes. All distinct blocks are sorted and named by integers; then
adjacent names are paired and the distinct pairs named in turn, until one name is left of each text. Two texts of
the same number of rounds have the same name only if they are the same bytes: every name stands for one content,
never for a hash of it.

The rows of a block carry its 64-bit hash instead of its bytes, for the join with the names. This is exact because
the distinct blocks are found from their bytes: a hash that two different blocks share is seen in the table of names
and its blocks are joined by their bytes.

Cases: null counts as the empty text, which is one empty block. Rows with the same id and text share one decision.
A text of any length is cut in one pass; rounds grow with the logarithm of the longest. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.llm.rows import id_and_text
from quernlake.shared import Written, write_shared

#: Bytes of a block: most texts are one or two, so the rounds are over small tables of integers.
BLOCK_BYTES = 4096
_ABSENT = -(2**63)


def _named(keys: DataFrame, label: str, sort: list[str], keep: list[str]) -> Written:
    """Integers for distinct rows, ascending with `sort` inside each partition; fixed once the table is written."""
    return write_shared(keys.select(*keep).sortWithinPartitions(*sort).withColumn("name", F.monotonically_increasing_id()), label)


def name_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, digest, level, name) of each distinct (id, text); (level, name) is the identity of the text.

    `digest` (SHA-256) only serves as the key of a row beside doc_id, so that an id with two texts has two identities.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("bytes", F.col("text").cast("binary"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / F.lit(block_bytes))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = rows.select("doc_id", F.unhex(F.sha2("bytes", 256)).alias("digest"), n.alias("n"), F.posexplode(cut).alias("pos", "block")).withColumn("hash", hashed(F.col("block")))

    names = _named(blocks.select("hash", "block").distinct(), "block-names", ["hash"], ["hash"])
    shared = names.frame.groupBy("hash").count().where("count > 1").select("hash")
    if shared.isEmpty():
        level0 = blocks.select("doc_id", "digest", "n", "pos", "hash").join(names.frame, "hash")
        extra = None
    else:
        odd = blocks.join(shared, "hash", "left_semi")
        extra = write_shared(odd.select("hash", "block").distinct().withColumn("name", -2 - F.monotonically_increasing_id()), "block-names-shared")
        level0 = blocks.select("doc_id", "digest", "n", "pos", "hash").join(names.frame.join(shared, "hash", "left_anti"), "hash")
        level0 = level0.select("doc_id", "digest", "n", "pos", "name").unionByName(odd.join(extra.frame, ["hash", "block"]).select("doc_id", "digest", "n", "pos", "name"))
    current = write_shared(level0.select("doc_id", "digest", "n", "pos", "name"), "block-level-0")
    names.drop()
    if extra:
        extra.drop()

    identities = current.frame.where("n = 1").select("doc_id", "digest", F.lit(0).alias("level"), "name").distinct()
    longest = current.frame.agg(F.max("n")).first()[0] or 1
    level, left = 0, current.frame.where("n > 1")
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = left.groupBy("doc_id", "digest", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(_ABSENT)).alias("b"))
        pairs = pairs.withColumn("n", F.ceil(F.col("n") / 2).cast("int"))
        names = _named(pairs.select("a", "b").distinct(), f"pair-names-{level}", ["a", "b"], ["a", "b"])
        following = write_shared(pairs.join(names.frame, ["a", "b"]).select("doc_id", "digest", "n", "pos", "name"), f"block-level-{level}")
        names.drop()
        identities = identities.unionByName(following.frame.where("n = 1").select("doc_id", "digest", F.lit(level).alias("level"), "name"))
        left = following.frame.where("n > 1")
    return identities


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id (the largest id with the same text), group_size, kept, text_sha256."""
    named = name_texts(docs, id_col, text_col, block_bytes, hashed).withColumnRenamed("doc_id", "of_id")
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    rows = rows.withColumn("row_digest", F.unhex("text_sha256"))
    found = rows.join(named, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row_digest") == F.col("digest"))).select("doc_id", "text_sha256", "level", "name")
    found = write_shared(found, "text-names").frame
    groups = found.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return found.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
