"""MinHash signatures, bands, candidate buckets, and the cascade from candidate to sketch to exact similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlake.operators.notices import scored_pairs

# The adopted sketch and index, the thresholds, the cap and the seed.
K_ROWS, BANDS, ROWS_PER_BAND = 384, 76, 5
TAU, TAU_SKETCH = 0.54, 0.46
BUCKET_CAP = 100
SEED = 20240917
#: The prime of the portable family: values stay under 2^31, so no product overflows a 64-bit integer.
PRIME = 2_147_483_647


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def signatures(sets: DataFrame, k: int = K_ROWS, seed: int = SEED, with_sets: bool = False) -> DataFrame:
    """(id, size, sig), with_sets also shingles: for each of k seeded mixings the smallest value, as unsigned, over the set; all ones for an empty set.

    Arrow batches, in blocks of bounded size: each row of the signature is one vectorised minimum over all sets of a block.
    """
    constants = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, size=k, dtype=np.int64).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column("shingles")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                offsets = offsets - offsets[0]
                full = np.flatnonzero(np.diff(offsets))
                made = np.full((part.num_rows, k), np.iinfo(np.uint64).max, np.uint64)
                if len(full):
                    for i, c in enumerate(constants):
                        made[full, i] = np.minimum.reduceat(_mixed(flat + c), offsets[:-1][full])
                sig = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * k), pa.array(made.view(np.int64).ravel()))
                made = {"id": part.column("id"), "size": pa.array(np.diff(offsets).astype(np.int32)), "sig": sig, "shingles": lists}
                yield pa.RecordBatch.from_arrays([made[c] for c in columns], columns)

    kind = dict(sets.dtypes)["id"]
    columns = ["id", "size", "sig", *["shingles"] * with_sets]
    return sets.select("id", "shingles").mapInArrow(run, f"id {kind}, size int, sig array<bigint>" + ", shingles array<bigint>" * with_sets)


def portable_constants(k: int) -> list[tuple[int, int]]:
    """Multiplier and offset of each row, by a rule that SQL can state as literals."""
    return [((1_103_515_245 * (i + 1) + 12_345) % PRIME, (69_069 * (i + 1) + 1) % PRIME) for i in range(k)]


def portable_signatures(sets: DataFrame, k: int = 16) -> DataFrame:
    """(id, size, sig) with linear permutations modulo a prime: the family that other engines can repeat. Needs sets that aren't empty."""
    constants = portable_constants(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column("shingles")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                flat = np.fmod(lists.flatten().to_numpy(zero_copy_only=False), PRIME)
                made = np.stack([np.minimum.reduceat(np.fmod(flat * a + c, PRIME), offsets[:-1] - offsets[0]) for a, c in constants], axis=1)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * k), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(offsets).astype(np.int32)), sig], ["id", "size", "sig"])

    kind = dict(sets.dtypes)["id"]
    return sets.where(F.size("shingles") > 0).select("id", "shingles").mapInArrow(run, f"id {kind}, size int, sig array<bigint>")


def sketch_similarity(a: Column, b: Column) -> Column:
    """The share of equal rows of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def packed(sig: Column) -> Column:
    """The low 32 bits of each row, little-endian, as bytes for storage."""
    word = F.transform(sig, lambda x: F.lpad(F.hex(x.bitwiseAND(0xFFFFFFFF)), 8, "0"))
    turned = F.transform(word, lambda h: F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))
    return F.unhex(F.array_join(turned, ""))


def band_keys(sig: Column, bands: int = BANDS, rows: int = ROWS_PER_BAND) -> Column:
    """A key for each band, salted with its number and never negative; bands * rows <= the signature's rows."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.shiftrightunsigned(F.xxhash64(j, F.slice(sig, j * rows + 1, rows)), 1))


def portable_band_keys(sig: Column, bands: int, rows: int) -> Column:
    """The same with an MD5, for comparison with other engines."""
    text = lambda j: F.concat(j.cast("string"), F.lit(":"), F.array_join(F.slice(sig, j * rows + 1, rows), ","))
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.conv(F.substring(F.md5(text(j)), 1, 15), 16, 10).cast("bigint"))


def bucket_table(sketches: DataFrame, keys: Column) -> DataFrame:
    """(band_no, bucket_key, id): the index in its relational form."""
    return sketches.select("id", F.posexplode(keys).alias("band_no", "bucket_key")).select("band_no", "bucket_key", "id")


def write_buckets(buckets: DataFrame, name: str, files: int) -> None:
    """The index as a bucketed, sorted table: joins on (band_no, bucket_key) read it without a shuffle and lookups open one file."""
    buckets.repartition(files, "band_no", "bucket_key").write.mode("overwrite").bucketBy(files, "band_no", "bucket_key").sortBy("band_no", "bucket_key").saveAsTable(name)


def bucket_sizes(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("band_no", "bucket_key").agg(F.count(F.lit(1)).alias("members"))


def suppressed(buckets: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """Buckets with more than `cap` members: the cap is a feature of the index, and what it refuses is reported, not lost silently."""
    return bucket_sizes(buckets).where(F.col("members") > cap)


def candidate_pairs(buckets: DataFrame, cap: int | None = None) -> DataFrame:
    """(a, b) with a < b of ids that share a bucket, each pair once. With a cap, larger buckets are not expanded."""
    members = F.count(F.lit(1)).over(Window.partitionBy("band_no", "bucket_key"))
    within = F.col("members") > 1 if cap is None else (F.col("members") > 1) & (F.col("members") <= cap)
    kept = buckets.select("band_no", "bucket_key", "id", members.alias("members")).where(within)
    a, b = (kept.select("band_no", "bucket_key", F.col("id").alias(x)) for x in "ab")
    return a.join(b, ["band_no", "bucket_key"]).where("a < b").select("a", "b").distinct()


def suppressed_links(buckets: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """The exact way for what the cap refuses: each member of a suppressed bucket with the smallest one, linear in the bucket."""
    first = buckets.groupBy("band_no", "bucket_key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("a")).where(F.col("members") > cap).select("band_no", "bucket_key", "a")
    return buckets.join(first, ["band_no", "bucket_key"]).where("id != a").select("a", F.col("id").alias("b")).distinct()


def probe(asked: DataFrame, buckets: DataFrame, how: str = "") -> DataFrame:
    """(probe_id, id) of other ids that share a bucket with the asked ones. `how` is a join hint; the rows are the same with any."""
    index = buckets.hint(how) if how else buckets
    found = asked.select("band_no", "bucket_key", F.col("id").alias("probe_id")).join(index, ["band_no", "bucket_key"]).where("id != probe_id")
    return found.select("probe_id", "id").distinct()


def probe_single_key(asked: DataFrame, buckets: DataFrame) -> DataFrame:
    """The probe's rows from a join by bucket_key alone, the band left as a condition on what met."""
    p, b = asked.alias("p"), buckets.alias("b")
    met = p.join(b, F.col("p.bucket_key") == F.col("b.bucket_key")).where("p.band_no = b.band_no AND p.id != b.id")
    return met.select(F.col("p.id").alias("probe_id"), F.col("b.id").alias("id")).distinct()


def probe_arrays(asked: DataFrame, arrays: DataFrame) -> DataFrame:
    """The same from (id, keys) with an array for each id: exploded, so it stays an equi-join and never a nested loop."""
    return probe(bucket_table(asked, F.col("keys")), bucket_table(arrays, F.col("keys")))


def members_of(buckets: DataFrame, band_no: int, bucket_key: int) -> DataFrame:
    return buckets.where((F.col("band_no") == band_no) & (F.col("bucket_key") == bucket_key)).select("id")


def per_row_work(buckets: DataFrame, cap: int | None = None) -> DataFrame:
    """(id, emissions): how many partners the buckets of an id offer it. The sizes come back by a join, split where a bucket is hot."""
    offered = F.col("members") - 1 if cap is None else F.when(F.col("members") <= cap, F.col("members") - 1).otherwise(0)
    return buckets.join(bucket_sizes(buckets), ["band_no", "bucket_key"]).groupBy("id").agg(F.sum(offered).alias("emissions"))


def cascade(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, tau_sketch: float = TAU_SKETCH, tau: float = TAU, review_from: float | None = None) -> DataFrame:
    """(a, b, j_sketch, j_exact, decision) of the pairs a < b that the sketch lets pass, compared in blocks; sketches may be the same frame as sets.

    decision is merge from tau up, review from review_from up if given, else reject.
    """
    rows = sets if sketches is sets else sets.join(sketches.select("id", "sig"), "id")
    scored = scored_pairs(pairs, rows).where(F.col("j_sketch") >= tau_sketch)
    decision = F.when(F.col("j_exact") >= tau, "merge")
    if review_from is not None:
        decision = decision.when(F.col("j_exact") >= review_from, "review")
    return scored.withColumn("decision", decision.otherwise("reject"))


def p_candidate(j: Column, bands: int = BANDS, rows: int = ROWS_PER_BAND) -> Column:
    """The chance that two sets of similarity j share a band."""
    return 1 - F.pow(1 - F.pow(j, F.lit(rows)), F.lit(bands))


def lsh_threshold(bands: int = BANDS, rows: int = ROWS_PER_BAND) -> float:
    return (1 / bands) ** (1 / rows)
