"""Near-duplicates by weighted Jaccard similarity of the multisets of word 5-grams, with BagMinHash signatures.

A shingle of weight w (how often the document has it) covers the discretised levels 0..w. These are split into ranges
[0,1), [1,2), [2,4), [4,8), ...; each range is a Poisson process of points in time, whose rate is its length times
the number of components, and each point draws a component and a level. Points above w are thinned out, so all
documents see the same points of a range as far as they cover it, and the first point of a component is that of the
same shingle in two documents with the probability of their weighted Jaccard similarity. Processes run in order of time
and end once they are later than every component's first point, so a document costs about as many points as it has
shingles plus COMPONENTS * ln(COMPONENTS).

Signatures are banded. Texts with the same words are one document before that. In a bucket every member is compared
with the smallest one, not with all others, and linked documents are one component. What is left open are the
other members of each bucket with more than one component, however far they are from its smallest: two that are both far
from it can be equal but for a word. Among these, pairs of different components are found by prefix filtering over their
shingles, which misses none. So no link between two texts that share a bucket is lost, and no bucket is expanded into
all its pairs. All links are exact: multisets are compared, not signatures.

Cases: null counts as empty. Texts without a word are copies of each other. A text under five words has one shingle of
all its words. Rows of one id with different texts are different documents; rows of one id and text share one decision, so all of
them are kept or none. A null id is an id like others. A text of any length is read whole; a task holds one step of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.llm.rows import id_and_text
from quernlake.llm.words import ODD, chunks, mix, rolled, spread, steps
from quernlake.operators.components import connected_components
from quernlake.shared import write_shared

WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS_PER_BAND = 4
COMPONENTS = BANDS * ROWS_PER_BAND
NULL_ID = -(2**63)
#: Slots of the table of fixed size that tells rare tokens from frequent ones.
SLOT_BITS = 20
#: Tokens before a prefix token that its row carries.
BEFORE = 4

def normal(texts: pa.Array) -> pa.Array:
    """Lower case, letters and digits only, one space between words."""
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}\p{M}]+", " "))


def shingles(normalised: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, weight) of the multisets, ascending; each pair of owner and shingle once."""
    distinct, which, offsets = chunks(normalised)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[which] if len(distinct) else np.empty(0, np.uint64)
    owner, total = rolled(hashed, offsets, words)
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])
    at = np.flatnonzero(new)
    return owner[at], total[at], np.diff(np.append(at, len(owner)))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, documents: int, components: int = COMPONENTS) -> np.ndarray:
    """The time of each component's first point, for each document; infinite for a document without shingles."""
    first = np.full(documents * components, np.inf)
    most = int(weight.max(initial=1))
    parts = []
    k = 0
    while k == 0 or 1 << (k - 1) < most:  # range k is [2^(k-1), 2^k), range 0 is [0, 1)
        low, size = (0, 1) if k == 0 else (1 << (k - 1), 1 << (k - 1))
        use = weight > low
        parts.append((owner[use], mix(shingle[use] ^ mix(np.uint64(k + 1) * np.ones(int(use.sum()), np.uint64))), np.full(int(use.sum()), float(size)), (np.minimum(weight[use] - low, size)) / size))
        k += 1
    of, state, size, share = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = np.zeros(len(of))
    while len(of):
        state = mix(state + ODD[0])
        uniform = ((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / (size * components)
        draw = mix(state ^ ODD[1])
        component = (draw >> np.uint64(32)) % np.uint64(components)
        taken = (draw & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 < share
        np.minimum.at(first, of[taken] * components + component[taken].astype(np.int64), time[taken])
        on = time < first.reshape(documents, components).max(1)[of]
        of, state, size, share, time = of[on], state[on], size[on], share[on], time[on]
    return first.reshape(documents, components)


def band_keys(first: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature, different between bands."""
    bits = first.view(np.uint64).reshape(len(first), bands, -1)
    keys = mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :] * np.ones((len(first), 1), np.uint64)
    for k in range(bits.shape[2]):
        keys = mix(keys ^ bits[:, :, k]) + ODD[2]
    return keys.view(np.int64)


def sketch(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, key (MD5 of the text), words (128-bit hash of the words), and the keys of its bands, none for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = normal(batch.column("text"))
            owner, shingle, weight = shingles(texts, words)
            first = signatures(owner, shingle, weight, batch.num_rows)
            full = np.isfinite(first[:, 0]) if len(first) else np.empty(0, bool)
            keys = band_keys(first)[full].ravel()
            lists = pa.ListArray.from_arrays(pa.array((np.concatenate([[0], np.cumsum(full)]) * BANDS).astype(np.int32)), pa.array(keys))
            digest = pa.array([hashlib.blake2b(memoryview(x.as_buffer()), digest_size=16).digest() for x in texts], pa.binary())
            key = pa.array([hashlib.md5(memoryview(x.as_buffer()), usedforsecurity=False).digest() for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), key, digest, lists], ["doc_id", "key", "words", "bands"])

    return docs.mapInArrow(run, "doc_id long, key binary, words binary, bands array<long>")


def multiset_jaccard(a: pa.Array, b: pa.Array, words: int = WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    coded = pa.chunked_array([a, b]).dictionary_encode().combine_chunks() if len(a) else pa.array([], pa.string()).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = normal(coded.dictionary)
    owner, shingle, weight = shingles(distinct, words)
    bounds = np.searchsorted(owner, np.arange(len(distinct) + 1))
    runs, total = np.diff(bounds), np.bincount(owner, weights=weight, minlength=len(distinct))
    n = len(a)
    sides = []
    for part in (which[:n], which[n:]):
        index, ends = spread(np.arange(len(owner)), bounds[:-1], runs, part, np.arange(n + 1))
        sides.append((np.repeat(np.arange(n), np.diff(ends)), shingle[index], weight[index]))
    pair = np.concatenate([sides[0][0], sides[1][0]])
    what = np.concatenate([sides[0][1], sides[1][1]])
    w = np.concatenate([sides[0][2], sides[1][2]])
    order = np.lexsort((what, pair))
    pair, what, w = pair[order], what[order], w[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (what[1:] == what[:-1])) if len(pair) > 1 else np.empty(0, np.int64)
    both = np.bincount(pair[same], weights=np.minimum(w[same], w[same + 1]), minlength=n)
    union = total[which[:n]] + total[which[n:]] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(a, b, similarity) of pairs of ids, from the whole texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(iter([batch]), "text_b"):
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(multiset_jaccard(part.column("text_a"), part.column("text_b"), words))], ["a", "b", "similarity"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def _tokens(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, token): a token for each occurrence of each shingle, so the Jaccard similarity of the token sets is the weighted one of the multisets."""
    owner, shingle, weight = shingles(normal(texts), words)
    at = np.repeat(np.arange(len(owner)), weight)
    occurrence = (np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)).astype(np.uint64)
    return owner[at], mix(shingle[at] + occurrence * ODD[3])


def _slot_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many tokens fall into each of 2^SLOT_BITS slots: a table of fixed size from which the rarity of a token is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in steps(batches):
            total += np.bincount((_tokens(batch.column("text"), words)[1] >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000].astype(np.int32)), pa.array(total[at[k : k + 100_000]])], ["slot", "n"])

    found = texts.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.int32)
    counts[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**31 - 1)
    return counts


def prefix_tokens(texts: DataFrame, similarity: float, words: int = WORDS) -> DataFrame:
    """(token, id, n, behind, q1...) of (id, text): the n - ceil(similarity * n) + 1 rarest tokens of each, with how many tokens from there on and the few just before."""
    names = ["token", "id", "n", "behind", *(f"q{k}" for k in range(1, BEFORE + 1))]
    counts = _slot_counts(texts, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            owner, token = _tokens(batch.column("text"), words)
            order = np.lexsort((token, counts[(token >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], owner))
            owner, token = owner[order], token[order]
            n = np.bincount(owner, minlength=batch.num_rows)
            place = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
            head = place < (n - np.ceil(n * similarity - 1e-9).astype(np.int64) + 1)[owner]
            owner, token, place = owner[head], token[head], place[head]
            rows = pa.array(owner)
            before = [pa.array(np.roll(token, k).view(np.int64), mask=place < k) for k in range(1, BEFORE + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), batch.column("id").take(rows), pa.array(n[owner]), pa.array(n[owner] - place), *before], names)

    return write_shared(texts.select("id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names)), "prefixes").frame


def prefix_pairs(heads: DataFrame, component: DataFrame, similarity: float, everyone: bool = True) -> DataFrame:
    """(a, b) with a < b: every pair of ids of different components (node, component) that may be similar enough.

    Two sets of tokens this similar share one of the prefix tokens of each, whatever order "rarest" is; so members of a
    large group meet by what few of them have. The first token that they share also leaves enough tokens behind it in both
    for the overlap they need; a text with too many tokens of its own before it meets nobody. A
    pair that shares one of the tokens just before has met there or still earlier. Without `everyone` only
    the smallest id of a token's meets the others.
    """
    rows = heads.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("token")
    kept = write_shared(rows.join(mixed, "token", "left_semi"), "shared-prefixes").frame
    first = kept if everyone else kept.groupBy("token").agg(F.min(F.struct(*[c for c in kept.columns if c != "token"])).alias("l")).select("token", "l.*")
    a, b = first.alias("a"), kept.alias("b")
    both = F.col("a.n") + F.col("b.n")
    enough = F.least("a.behind", "b.behind") >= both * (similarity / (1 + similarity)) - 1e-6
    again = reduce(Column.__or__, (F.coalesce(F.col(f"a.q{i}") == F.col(f"b.q{j}"), F.lit(False)) for i in range(1, BEFORE + 1) for j in range(1, BEFORE + 1)))
    enough = enough & (~again if everyone else F.lit(True))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component")) & enough)
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest id of its class), kept (it is the first of its class), copy_of (the smallest id with the same words)."""
    return classes(docs, id_col, text_col, similarity, words).drop("key")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """The same with key, the MD5 of the text. The first of a class has its smallest id and, of this id's texts, the smallest key."""
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    sketches = write_shared(sketch(rows, words), "sketches").frame
    # texts with the same words are one node; numbers ascend with ids and are fixed once the table is written
    groups = sketches.groupBy("words").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    groups = groups.repartitionByRange("first").sortWithinPartitions("first")
    groups = write_shared(groups.withColumn("node", F.monotonically_increasing_id()), "same-words").frame
    bands = sketches.join(groups, (sketches["words"] == groups["words"]) & (sketches["doc_id"] == groups["first.doc_id"]) & (sketches["key"] == groups["first.key"])).select("node", "bands").dropDuplicates(["node"])
    bands = write_shared(bands.select(F.col("node").alias("id"), F.explode("bands").alias("bucket")), "bands").frame
    buckets = write_shared(bands.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader != last").select("bucket", "leader"), "buckets").frame
    members = write_shared(bands.join(buckets, "bucket").select("bucket", "leader", "id"), "members").frame
    wanted = write_shared(members.select("id").distinct().join(groups.select(F.col("node").alias("id"), "first"), "id").select("id", "first.doc_id", "first.key"), "wanted").frame
    texts = rows.withColumn("key", F.unhex(F.md5("text"))).join(wanted.hint("merge"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("id", "text")
    texts = write_shared(texts, "texts").frame

    links = write_shared(verified(members.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), texts, words), "links").frame
    component = write_shared(connected_components(links.where(F.col("similarity") >= similarity)), "components").frame
    state = members.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = state.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    # the leader itself has been compared with all others; how far the others are from it says nothing about two that are equally far
    unsettled = write_shared(state.where("id != leader").join(split, "bucket", "left_semi").select("id").distinct(), "open").frame
    if not unsettled.isEmpty():
        heads = prefix_tokens(texts.join(unsettled, "id"), similarity, words)
        for everyone in (False, True):  # first in linear time, which leaves fewer components apart
            pairs = prefix_pairs(heads, component, similarity, everyone).join(links.select("a", "b"), ["a", "b"], "left_anti")
            links = links.unionByName(write_shared(verified(pairs, texts, words), "links").frame)
            component = write_shared(connected_components(links.where(F.col("similarity") >= similarity)), "components").frame
    named = groups.join(component, "node", "left").select("words", F.col("first.doc_id").alias("copy_of"), "first", F.coalesce("component", "node").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("first"))
    named = write_shared(named.drop("first").join(firsts, "component").select("words", "copy_of", "first"), "named").frame
    found = sketches.select("doc_id", "key", "words").join(named, "words")
    real = lambda c, name: F.when(F.col(c) != NULL_ID, F.col(c)).alias(name)
    kept = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    return found.select(real("doc_id", "doc_id"), real("first.doc_id", "class_id"), kept.alias("kept"), real("copy_of", "copy_of"), "key")
