"""Line dedup by a log-template tree of fixed depth.

A line's variable fields (tokens with a digit, an @ or a scheme) are masked. Its leaf in the tree is its number of
tokens and its first LEADING masked tokens. In a leaf with different masked lines, the template has at each place the
token that most of them have there; a line that agrees with it at SIMILAR of the places or more belongs to it,
another line is a template of its own. A template recurs if at least MIN_CONTEXTS different documents have it, whatever
stands around it, so all lines of a repeated block go. A passage of over LONG_TOKENS tokens is no coincidence: of a run of
lines that other texts have too, with that many tokens in all, two documents are enough; blank and short lines do not
break a run. Of a recurring template the line of the smallest (doc_id, place) stays and the others are dropped.

Copies and near copies count as one document and are left to document dedup. Near copies here are texts whose sketches
(the smallest hash of the five-word shingles in each of BINS bins) agree in ALIKE of the bins and share a band, with the
smallest text of the band or through it; they are linked into components.

The choice at each place depends on counts only, so neither the order of the lines nor of the tasks matters, and no
leaf of more than LARGE_LEAF lines is ever in one task: every other step is a pre-aggregated grouping or an equi-join, whose hot
keys are split at run time. Leaves, lines and texts are told apart by 128-bit hashes. Texts are read three times and shuffled once, at the end.

Cases: null counts as empty. Blank lines and lines under MIN_TOKENS tokens stay. Rows with the same id and text share
one decision. An empty table gives no rows. Lines end with "\\n"; other white space only separates tokens. A text of any length
is read whole; a task holds one text and its lines.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernlake.llm.rows import id_and_text, text_of
from quernlake.llm.words import chunks, mix, rolled, steps
from quernlake.operators.components import connected_components
from quernlake.shared import write_shared

LEADING = 3
MIN_TOKENS = 3
SIMILAR = 0.7
#: Documents that must have a template, near copies counted once.
MIN_CONTEXTS = 3
LONG_TOKENS, LONG_CONTEXTS = 50, 2
#: Bits by which lines are sieved before they are carried on: a bitmap of this fixed size is all that goes to the driver.
SIEVE_BITS = 25
#: Different lines of a leaf up to which one task finds its template; larger leaves are counted place by place over all tasks.
LARGE_LEAF = 1_000
WORDS = 5
BINS, BANDS, ROWS_PER_BAND = 128, 16, 4
ALIKE = 0.7
#: What is not plain: a field to mask, or white space to reduce.
_ODD = r"[0-9@\t\r\x0b\x0c]|://|  |^ | $"
_FIELD = re.compile(r"[0-9@]|://")
_SPACE = re.compile(r"[ \t\r\x0b\x0c]+")


def masked(line: str) -> str:
    """The line with its variable fields replaced and its white space reduced."""
    return " ".join(["<*>" if _FIELD.search(w) else w for w in _SPACE.split(line) if w])


def _leaf(line: str, n: int, leading: int) -> bytes:
    return xxhash.xxh3_128_digest(" ".join([str(n), *line.split(" ", leading)[:leading]]))


def _cut(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The masked lines of all texts, the number of tokens of each (0: blank), and each text's first line."""
    lists = pc.split_pattern(texts, "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    odd = np.flatnonzero(pc.match_substring_regex(flat, _ODD).to_numpy(zero_copy_only=False))
    lines = flat.to_pylist()
    for k in odd.tolist():
        lines[k] = masked(lines[k])
    n = pc.count_substring(flat, " ").to_numpy(zero_copy_only=False).astype(np.int64) + 1
    n[pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)] = 0
    n[odd] = [lines[k].count(" ") + (lines[k] != "") for k in odd.tolist()]
    return lines, n, offsets - offsets[0]


def _key(texts: pa.Array) -> list[bytes]:
    return [hashlib.md5(memoryview(x.as_buffer()), usedforsecurity=False).digest() for x in texts]


def _shared_leaves(docs: DataFrame, leading: int, min_tokens: int) -> DataFrame:
    """(leaf) of which more than one text has a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            lines, n, offsets = _cut(batch.column("text"))
            text = np.fromiter((xxhash.xxh3_64_intdigest(memoryview(x.as_buffer())) >> 1 for x in batch.column("text")), np.int64, batch.num_rows)
            counted = np.flatnonzero(n >= min_tokens)
            leaves = [_leaf(lines[k], m, leading) for k, m in zip(counted.tolist(), n[counted].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.binary()), pa.array(np.repeat(text, np.diff(offsets))[counted])], ["leaf", "text"])

    found = docs.select("text").mapInArrow(run, "leaf binary, text long")
    return found.groupBy("leaf").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a != b").select("leaf")


def _sieve_of(leaves: DataFrame) -> bytes:
    """A bitmap of 2^SIEVE_BITS bits in which each leaf's bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << SIEVE_BITS, bool)
        for batch in batches:
            bits[_places(batch.column("leaf").to_pylist())] = True
        packed = np.packbits(bits).reshape(-1, 4096)
        full = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([packed[k].tobytes() for k in full], pa.binary())], ["part", "bits"])

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in parts:
            for k, bits in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                total[k] = total.get(k, np.uint8(0)) | np.frombuffer(bits, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "bits"])

    found = leaves.mapInArrow(run, "part int, bits binary").repartition(16, "part").mapInArrow(merge, "part int, bits binary")
    packed = np.zeros((1 << SIEVE_BITS - 15, 4096), np.uint8)
    for row in found.toLocalIterator():
        packed[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return packed.tobytes()


def _places(leaves: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(leaves), np.uint64)[::2].astype(np.int64) & ((1 << SIEVE_BITS) - 1)


def sketches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each bin and a key for each band of every text, by one permutation; an empty bin takes the value of the next full one."""
    distinct, which, offsets = chunks(pc.ascii_lower(texts))
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))[which]
    owner, total = rolled(words, offsets, WORDS)
    total = mix(total)
    least = np.full(len(texts) * BINS, np.uint64(2**64 - 1))
    np.minimum.at(least, owner * BINS + (total >> np.uint64(57)).astype(np.int64), total << np.uint64(7))
    least = least.reshape(-1, BINS)
    for k in range(7):  # 2^7 bins: after these steps each has met all others
        least = np.where(least == np.uint64(2**64 - 1), np.roll(least, -(1 << k), axis=1), least)
    keys = mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :] + np.zeros((len(least), 1), np.uint64)
    for k in range(ROWS_PER_BAND):
        keys = mix(keys ^ least[:, k : BANDS * ROWS_PER_BAND : ROWS_PER_BAND])
    return (mix(least) & np.uint64(255)).astype(np.uint8), keys.view(np.int64)


_LINES = "doc_id long, key binary, sketch binary, bands array<long>, lines array<struct<pos:int,seq:int,n:int,leaf:binary,line:binary,masked:string>>"


def _candidate_lines(docs: DataFrame, sieve, leading: int, min_tokens: int) -> DataFrame:
    """For each row with lines that may be shared: doc_id, key and sketch of the text, and these lines. seq counts the lines of enough tokens."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("seq", pa.int32()), ("n", pa.int32()), ("leaf", pa.binary()), ("line", pa.binary()), ("masked", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sieve.value, np.uint8)
        for batch in steps(batches):
            lines, n, offsets = _cut(batch.column("text"))
            counted = np.flatnonzero(n >= min_tokens)
            leaves = [_leaf(lines[k], m, leading) for k, m in zip(counted.tolist(), n[counted].tolist(), strict=True)]
            place = _places(leaves)
            may = np.flatnonzero(bits[place >> 3] & (128 >> (place & 7)).astype(np.uint8))
            if not len(may):
                continue
            at = counted[may]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            seq = np.concatenate([[0], np.cumsum(n >= min_tokens)])
            some = [lines[k] for k in at.tolist()]
            items = pa.StructArray.from_arrays(
                [pa.array((at - offsets[:-1][owner[at]]).astype(np.int32)), pa.array((seq[at] - seq[offsets[:-1][owner[at]]]).astype(np.int32)), pa.array(n[at].astype(np.int32)), pa.array([leaves[k] for k in may.tolist()], pa.binary()), pa.array(list(map(xxhash.xxh3_128_digest, some)), pa.binary()), pa.array(some, pa.string())],
                fields=list(kind.value_type),
            )
            rows, first = np.unique(owner[at], return_index=True)
            part = batch.take(pa.array(rows))
            sketch, bands = sketches(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(_key(part.column("text")), pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(bands.ravel())), pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), items, type=kind)],
                ["doc_id", "key", "sketch", "bands", "lines"],
            )

    return docs.mapInArrow(run, _LINES)


def _agreeing(masked: pa.Array, n: np.ndarray, group: np.ndarray, similar: float) -> np.ndarray:
    """Which of the lines agree with the template of their group, the most common token at each place (the largest of equally common ones); all lines of a group have as many tokens."""
    coded = pc.split_pattern(masked, " ").flatten().dictionary_encode()
    tokens = coded.dictionary.to_pylist()
    rank = np.empty(len(tokens), np.int64)
    rank[sorted(range(len(tokens)), key=tokens.__getitem__)] = np.arange(len(tokens))
    token = rank[coded.indices.to_numpy(zero_copy_only=False)]
    ends = np.cumsum(n)
    width = np.zeros(int(group[-1]) + 1, np.int64)
    width[group] = n
    place = np.repeat((np.cumsum(width) - width)[group] - (ends - n), n) + np.arange(len(token))
    kinds, at, count = np.unique(place * len(tokens) + token, return_inverse=True, return_counts=True)
    place_of = kinds // len(tokens)
    order = np.lexsort((kinds, count, place_of))
    usual = kinds[order[np.append(np.flatnonzero(np.diff(place_of[order])), len(order) - 1)]]
    agree = np.concatenate([[0], np.cumsum(usual[place] == kinds[at])])
    return agree[ends] - agree[ends - n] >= n * similar


def _agreeing_in_small_leaves(distinct: DataFrame, similar: float) -> DataFrame:
    """(leaf, line) as _templates, of leaves whose lines one task can hold."""

    def of(lines: pa.Table) -> pa.RecordBatch:
        leaf = lines.column("leaf").combine_chunks().dictionary_encode()
        group = leaf.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        some = np.bincount(group)[group] > 1
        lines = lines.filter(pa.array(some)).combine_chunks()
        if not lines.num_rows:
            return pa.RecordBatch.from_pydict({"leaf": pa.array([], pa.binary()), "line": pa.array([], pa.binary())})
        _, group = np.unique(group[some], return_inverse=True)
        general = _agreeing(lines.column("masked").combine_chunks(), lines.column("n").to_numpy().astype(np.int64), group, similar)
        return lines.select(["leaf", "line"]).filter(pa.array(general)).combine_chunks().to_batches(max_chunksize=1 << 30)[0] if general.any() else pa.RecordBatch.from_pydict({"leaf": pa.array([], pa.binary()), "line": pa.array([], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        for batch in steps(batches, "masked"):
            last = batch.column("leaf")[batch.num_rows - 1]
            begins = pc.index(batch.column("leaf"), last).as_py()  # sorted by leaf: what is before the last leaf is whole
            if begins == 0 and (not left or left[-1].column("leaf")[left[-1].num_rows - 1] == last):
                left.append(batch)
                continue
            yield of(pa.Table.from_batches([*left, batch.slice(0, begins)]))
            left = [batch.slice(begins)]
        if left:
            yield of(pa.Table.from_batches(left))

    return distinct.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, "leaf binary, line binary")


def _templates(lines: DataFrame, similar: float) -> DataFrame:
    """(leaf, line) of the masked lines that agree with their leaf's template, in leaves with different masked lines."""
    distinct = write_shared(lines.groupBy("leaf", "line").agg(F.first("n").alias("n"), F.first("masked").alias("masked")), "distinct-lines").frame
    large = write_shared(distinct.groupBy("leaf").count().where(F.col("count") > LARGE_LEAF).select("leaf"), "large-leaves").frame
    small = _agreeing_in_small_leaves(distinct.join(large, "leaf", "left_anti"), similar)
    if large.isEmpty():
        return small
    places = distinct.join(large, "leaf", "left_semi").select("leaf", "line", "n", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    places = write_shared(places, "line-places").frame
    usual = places.groupBy("leaf", "place", "token").count().groupBy("leaf", "place").agg(F.max(F.struct("count", "token"))["token"].alias("usual"))
    agree = F.sum((F.col("token") == F.col("usual")).cast("int"))
    found = places.join(usual, ["leaf", "place"]).groupBy("leaf", "line").agg(agree.alias("agree"), F.first("n").alias("n")).where(F.col("agree") >= F.col("n") * similar)
    return small.unionByName(found.select("leaf", "line"))


def _near_copies(texts: DataFrame) -> DataFrame:
    """(key, class) of texts (key, id, sketch, bands): near copies have one class."""
    bands = texts.select("id", F.explode("bands").alias("bucket"))
    buckets = bands.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader != last").select("bucket", "leader")
    pairs = bands.join(buckets, "bucket").where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    of = texts.dropDuplicates(["id"])
    met = pairs.join(of.select(F.col("id").alias("b"), F.col("sketch").alias("other")), "b").join(of.select(F.col("id").alias("a"), "sketch"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sketch", "other"))
            alike = pa.array((a == b).mean(axis=1) >= ALIKE)
            yield batch.select(["a", "b"]).filter(alike)

    component = connected_components(met.select("a", "b", "sketch", "other").mapInArrow(run, "a long, b long"))
    return texts.select("key", "id").join(component.withColumnRenamed("node", "id"), "id", "left").select("key", F.coalesce("component", "id").alias("class"))


def dropped_lines(docs: DataFrame, min_contexts: int = MIN_CONTEXTS, leading: int = LEADING, min_tokens: int = MIN_TOKENS, similar: float = SIMILAR) -> DataFrame:
    """doc_id, key (of the text), and the places of the lines that are dropped, for each text with such lines; docs has doc_id and text without null."""
    spark = docs.sparkSession
    sieve = spark.sparkContext.broadcast(_sieve_of(_shared_leaves(docs, leading, min_tokens)))
    rows = write_shared(_candidate_lines(docs, sieve, leading, min_tokens), "candidate-lines").frame
    lines = rows.select("doc_id", "key", F.inline("lines"))
    general = write_shared(_templates(lines, similar), "general-lines").frame.withColumn("general", F.lit(True))
    named = lines.drop("masked").join(general, ["leaf", "line"], "left")
    named = named.select("doc_id", "key", "pos", "seq", "n", F.when(F.col("general"), F.col("leaf")).otherwise(F.col("line")).alias("template"))
    named = write_shared(named, "line-templates").frame

    part = F.xxhash64("key")
    shared = named.groupBy("template").agg(F.min(part).alias("a"), F.max(part).alias("b")).where("a != b").select("template")
    lines = named.join(shared, "template", "left_semi")
    text = Window.partitionBy("doc_id", "key")
    lines = lines.dropDuplicates(["doc_id", "key", "pos"]).withColumn("run", F.col("seq") - F.row_number().over(text.orderBy("seq")))
    lines = lines.withColumn("long", F.sum("n").over(text.partitionBy("doc_id", "key", "run")) > LONG_TOKENS).drop("run", "seq", "n")
    lines = write_shared(lines, "shared-lines").frame

    texts = rows.select("key", "sketch", "bands").dropDuplicates(["key"]).join(lines.select("key").distinct(), "key", "left_semi")
    texts = write_shared(texts.withColumn("id", F.xxhash64("key")), "template-texts").frame
    classes = write_shared(_near_copies(texts), "text-classes").frame
    here = F.struct("doc_id", "key", "pos")
    apart = lines.groupBy("template", "key").agg(F.min(here).alias("first"), F.max("long").alias("long")).join(classes, "key")
    apart = apart.groupBy("template", "class").agg(F.min("first").alias("first"), F.max(F.col("long").cast("int")).alias("long"))
    most = apart.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.sum("long").alias("n_long"), F.min("first").alias("first"))
    recurring = most.where((F.col("n") >= min_contexts) | (F.col("n_long") >= min(LONG_CONTEXTS, min_contexts))).select("template", "n", "first")
    again = lines.join(recurring, "template").where((here != F.col("first")) & ((F.col("n") >= min_contexts) | F.col("long")))
    return again.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("places"))


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """row (all columns of docs, the text without its recurring lines), n_lines and n_dropped, for each row of docs.

    The row is one struct, so no name of a column of docs can clash with one of this operator.
    """
    found = dropped_lines(id_and_text(docs, id_col, text_col), **limits).select(F.col("doc_id").alias("of"), F.col("key").alias("key_of"), "places")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text_of(text_col))).alias("key"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("key_of")), "left")
    lines = F.split(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")), "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("places", i))
    text = F.when(F.col("places").isNull(), F.col("row")[text_col]).otherwise(F.array_join(kept, "\n"))
    row = F.struct(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
    return joined.select(row.alias("row"), F.size(lines).alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).alias("n_dropped"))
