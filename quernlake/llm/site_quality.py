"""Quality and toxicity by hierarchical empirical Bayes.

A linear classifier over the presence of words, word beginnings, punctuation and shape gives each document its
evidence: the logarithm of how much more likely its features are under one label than under the other. The prior it
is added to is the rate of its site among the site's other documents, so no document counts twice. The rate of a path shrinks
towards that of its host and this towards the global one:
    rate = (sum of the others' probabilities by their evidence + strength * rate above) / (number of others + strength).
The strengths come from the data, by the method of moments: how far hosts differ from the global rate, and paths from
their hosts' rates, beyond what chance makes; a document alone on its site has the rate above as its prior.

Fitting uses a bounded sample of labelled rows (FIT_ROWS, those with the smallest hashes of their ids). The most telling
features are chosen by grouped counts, so the driver gets only their counts and a bit for each of them and each row of
the sample. Rates are grouped sums over all documents, pre-aggregated before the shuffle; the table of sites is joined
back by broadcast only if it has at most BROADCAST_SITES rows.

Cases: null text counts as empty, null host or path as the empty string. Without both values of a label among the
sample, its evidence is 0 and only the prior is left. Rows are neither merged nor dropped; of labelled rows with one id, one
is in the sample. Texts of any length are read whole, also pieces of any length without white space.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.llm.rows import text_of
from quernlake.llm.words import chunks, spread, steps
from quernlake.shared import write_shared

FIT_ROWS = 12_000
FEATURES = 600
RIDGE = 0.1
#: A toxic document that stays does more harm than a clean one that goes. It only goes if its own text speaks for it: a site's rate alone rejects nobody.
TOXIC_FROM = 0.25
#: A feature counts from so many sample rows and so large a chi-square on.
LEAST_SEEN, LEAST_TELLING = 4, 12
BROADCAST_SITES = 20_000
#: A piece of more characters has no words; each run of so many characters of it is a feature.
LONG_PIECE, RUN = 64, 8
_BITS = 20
_SHAPES = 8
_PIECE = r"(?s)^(?P<before>[^\p{L}\p{N}]*)(?P<word>.*?)(?P<after>[^\p{L}\p{N}]*)$"
WIDTH = (1 << _BITS) + 16 * _SHAPES


def _hashed(kind: str, strings: pa.Array) -> np.ndarray:
    """The bucket of each string's feature of a kind."""
    coded = strings.dictionary_encode()
    own = np.fromiter((zlib.crc32(f"{kind}:{x}".encode("utf-8", "surrogatepass")) & ((1 << _BITS) - 1) for x in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.empty(0, np.int64)


def _piece_features(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all pieces in a row, and how many each has."""
    long = pc.greater(pc.utf8_length(pieces), LONG_PIECE).to_numpy(zero_copy_only=False)
    parts = pc.extract_regex(pc.if_else(pa.array(long), pa.scalar("-"), pieces), _PIECE)
    before, word, after = (parts.field(k) for k in range(3))
    low, empty = pc.utf8_lower(word), pc.equal(pc.binary_length(word), 0).to_numpy(zero_copy_only=False)
    cut = lambda x, n: pc.utf8_slice_codeunits(x, 0, n)
    more = pc.greater(pc.utf8_length(after), 1).to_numpy(zero_copy_only=False) & ~empty
    ahead = pc.greater(pc.binary_length(before), 0).to_numpy(zero_copy_only=False) & ~empty
    columns = [(empty & ~long, "o", cut(pieces, 6)), (~empty, "w", low), (~empty, "b4", cut(low, 4)), (~empty, "b5", cut(low, 5)), (more, "a", cut(after, 4)), (ahead, "f", cut(before, 2))]
    owner, values = [], []
    for use, kind, strings in columns:
        at = np.flatnonzero(use)
        owner.append(at)
        values.append(_hashed(kind, strings.take(pa.array(at))))
    at = np.flatnonzero(long)
    runs = [[x[k : k + RUN].lower() for k in range(0, len(x), RUN)] for x in pieces.take(pa.array(at)).to_pylist()]
    owner.append(np.repeat(at, [len(x) for x in runs]))
    values.append(_hashed("r", pa.array([y for x in runs for y in x], pa.string())))
    owner, values = np.concatenate(owner).astype(np.int64), np.concatenate(values)
    return values[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(pieces))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Ascending, each once."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _shape(texts: pa.Array, which: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Buckets of the shape of each text, as features above the hashed ones."""
    chars = np.maximum(1, pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    count = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) / chars
    n = np.diff(offsets)
    mean = np.where(n > 0, (np.concatenate([[0], np.cumsum(lengths[which])])[offsets[1:]] - np.concatenate([[0], np.cumsum(lengths[which])])[offsets[:-1]]) / np.maximum(n, 1), 0)
    owner = np.repeat(np.arange(len(n)), n)
    distinct = np.bincount(_distinct(owner * (which.max(initial=0) + 1) + which) // (which.max(initial=0) + 1), minlength=len(n)) / np.maximum(n, 1)
    same = np.zeros(len(n))
    if len(which) > 1:
        same = np.bincount(owner[1:], weights=(which[1:] == which[:-1]) & (owner[1:] == owner[:-1]), minlength=len(n)) / np.maximum(n, 1)
    columns = [same * 30, count(r"\p{Lu}") * 20, count(r"[^\p{L}\p{N}\s.,]") * 20, count(r"\p{N}") * 20, mean, distinct * 10, np.log2(n + 1), count(r"\n") * 100]
    buckets = [np.minimum(15, c).astype(np.int64) + 16 * k for k, c in enumerate(columns)]
    return (1 << _BITS) + np.stack(buckets)


def _features(batch: pa.RecordBatch, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of a slice, each pair once; only the wanted features (a flag for each), if given."""
    texts = batch.column("text")
    distinct, which, offsets = chunks(texts)
    flat, sizes = _piece_features(distinct)
    if wanted is not None:
        of, use = np.repeat(np.arange(len(sizes)), sizes), wanted[flat]
        flat, sizes = flat[use], np.bincount(of[use], minlength=len(sizes))
    features, ends = spread(flat, np.cumsum(sizes) - sizes, sizes, which, offsets)
    shape = _shape(texts, which, offsets, pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64))
    rows = np.repeat(np.arange(batch.num_rows), np.diff(ends))
    keys = _distinct(np.concatenate([rows * WIDTH + features, (np.arange(batch.num_rows) * WIDTH + shape).ravel()]))
    return keys // WIDTH, keys % WIDTH


def fit_linear(present: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the features (columns of 0 and 1), and the constant, of a logistic classifier; the prior is taken out of the constant."""
    n, good = len(label), int(label.sum())
    x = np.hstack([present, np.ones((n, 1))]).astype(np.float32)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-3
    for _ in range(25):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30).astype(float)))
        step = np.linalg.solve((x * (p * (1 - p)).astype(np.float32)[:, None]).T @ x + np.diag(penalty), x.T @ (label - p).astype(np.float32) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1] - np.log(good / (n - good)))


def telling(counts: DataFrame, target: str, n: int, good: int, features: int = FEATURES) -> list[int]:
    """The features (feature, n, and how often with each target) whose presence tells most of the target by chi-square; at most `features`."""
    seen, share = F.col("n"), good / n
    expected = seen * share
    chi = (F.col(target) - expected) ** 2 / F.greatest(expected * (1 - share) * (1 - seen / (n + 1)), F.lit(1e-9))
    found = counts.where(seen >= LEAST_SEEN).select("feature", chi.alias("chi")).where(F.col("chi") > LEAST_TELLING)
    return sorted(r["feature"] for r in found.orderBy(F.desc("chi"), "feature").limit(features).collect())


def sample_features(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...], fit_rows: int = FIT_ROWS) -> DataFrame:
    """The targets and the features of at most fit_rows labelled documents."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(t).cast("int").alias(t) for t in targets]).dropna()
    some = some.groupBy("doc_id").agg(*[F.max(t).alias(t) for t in targets]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # a bounded table, whatever the input
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", *targets).agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            at, features = _features(batch)
            offsets = np.searchsorted(at, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(t) for t in targets), pa.ListArray.from_arrays(pa.array(offsets), pa.array(features.astype(np.int32)))], [*targets, "features"])

    return write_shared(rows.select("text", *targets).mapInArrow(run, ", ".join(f"{t} int" for t in targets) + ", features array<int>"), "quality-sample").frame


def fit(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...], fit_rows: int = FIT_ROWS) -> dict[str, tuple[dict[int, float], float]]:
    """A classifier for each label, from at most fit_rows labelled documents."""
    rows = sample_features(docs, labels, targets, fit_rows)
    n, *good = (int(x or 0) for x in rows.agg(F.count(F.lit(1)), *[F.sum(t) for t in targets]).first())
    counts = rows.select(F.explode("features").alias("feature"), *targets).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in targets])
    counts = write_shared(counts.where(F.col("n") >= LEAST_SEEN), "quality-features").frame
    chosen = {t: telling(counts, t, n, g) if 0 < g < n else [] for t, g in zip(targets, good, strict=True)}
    kinds = np.array(sorted({f for x in chosen.values() for f in x}), np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            at, flat = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy().astype(np.int64)
            place = np.minimum(np.searchsorted(kinds, flat), max(0, len(kinds) - 1))
            used = kinds[place] == flat if len(kinds) else np.zeros(len(flat), bool)
            bits = np.zeros((batch.num_rows, len(kinds)), bool)
            bits[at[used], place[used]] = True
            yield pa.RecordBatch.from_arrays([*(batch.column(t) for t in targets), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], [*targets, "bits"])

    got = rows.mapInArrow(pack, ", ".join(f"{t} int" for t in targets) + ", bits binary").toArrow()
    width = (len(kinds) + 7) // 8
    packed = np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint8).reshape(got.num_rows, width) if width else np.zeros((got.num_rows, 0), np.uint8)
    models = {}
    for t, g in zip(targets, good, strict=True):
        if 0 < g < n:
            own = np.searchsorted(kinds, chosen[t])
            weights, constant = fit_linear(np.unpackbits(packed, axis=1)[:, own], got.column(t).to_numpy().astype(float))
            models[t] = dict(zip(chosen[t], weights.tolist(), strict=True)), constant
        else:
            models[t] = {}, 0.0
    return models


def _strength(groups: DataFrame, p: str, n: str, above: str) -> float:
    """How many documents the rate above counts for, from how far the groups' rates are from it beyond chance."""
    rate = F.col(p) / F.col(n)
    sums = groups.agg(F.sum(n), F.sum(F.col(n) * (rate - F.col(above)) ** 2), F.sum(F.col(above) * (1 - F.col(above))), F.sum(F.col(n) * F.col(above) * (1 - F.col(above)))).first()
    docs, apart, chance, within = (float(x or 0) for x in sums)
    if not docs:
        return 1.0
    between = max((apart - chance) / docs, 1e-6)
    return min(max(within / docs / between - 1, 1.0), 1e6)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | Column = "source", path_col: str | Column = "lang", **limits) -> DataFrame:
    """doc_id, host, path, quality and toxic probabilities, host and path rates of the others, and kept; one row for each row of docs."""
    return verdicts(docs, labels, id_col, text_col, host_col, path_col, **limits).drop("key")


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | Column = "source", path_col: str | Column = "lang", fit_rows: int = FIT_ROWS, good_from: float = 0.5, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The same with key, the MD5 of the text: rows with the same doc_id, key, host and path share one decision."""
    named = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), named(host_col).alias("host"), named(path_col).alias("path"))
    targets = ("quality", "toxic")
    models = fit(rows, labels, targets, fit_rows)
    kinds = np.array(sorted({k for t in targets for k in models[t][0]}), np.int64)
    weights = np.array([[models[t][0].get(int(k), 0.0) for k in kinds] for t in targets]).reshape(2, len(kinds))
    constants = [models[t][1] for t in targets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(WIDTH, bool)
        wanted[kinds] = True
        for batch in steps(batches):
            owner, features = _features(batch, wanted)
            at = np.searchsorted(kinds, features)
            used = at < len(kinds)
            used[used] = kinds[at[used]] == features[used]
            sums = [np.bincount(owner[used], weights=w[at[used]], minlength=batch.num_rows) + c for w, c in zip(weights, constants, strict=True)]
            key = pa.array([hashlib.md5(memoryview(x.as_buffer()), usedforsecurity=False).digest() for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), key, *map(pa.array, sums)], ["doc_id", "host", "path", "key", *targets])

    evidence = write_shared(rows.mapInArrow(run, "doc_id long, host string, path string, key binary, quality double, toxic double"), "evidence").frame
    made = evidence.select("*", *[(1 / (1 + F.exp(-F.col(t)))).alias(f"p_{t}") for t in targets])
    paths = write_shared(made.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"p_{t}").alias(f"s_{t}") for t in targets]), "sites").frame
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(f"s_{t}").alias(f"h_{t}") for t in targets])
    total = hosts.agg(F.sum("host_n"), *[F.sum(f"h_{t}") for t in targets]).first()
    sites, rates, strengths = paths.join(hosts, "host"), {}, {}
    for k, t in enumerate(targets, 1):
        rates[t] = min(max(total[k] / total[0], 1e-4), 1 - 1e-4) if total[0] else 0.5
        strengths[t] = (_strength(hosts.withColumn("above", F.lit(rates[t])), f"h_{t}", "host_n", "above"), _strength(sites.withColumn("above", F.col(f"h_{t}") / F.col("host_n")), f"s_{t}", "n", "above"))
    sites = write_shared(sites, "site-sums").frame
    sites = F.broadcast(sites) if sites.count() <= BROADCAST_SITES else sites
    scored = made.join(sites, ["host", "path"])
    others = lambda total, t, n, above, strength: (F.greatest(F.col(total) - F.col(f"p_{t}"), F.lit(0.0)) + strength * above) / (F.col(n) - 1 + strength)
    for t in targets:
        scored = scored.withColumn(f"host_{t}", others(f"h_{t}", t, "host_n", F.lit(rates[t]), strengths[t][0]))
        scored = scored.withColumn(f"path_{t}", others(f"s_{t}", t, "n", F.col(f"host_{t}"), strengths[t][1]))
    odds = lambda t: F.col(t) + _logit(F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col(f"path_{t}"))))
    scored = scored.select("doc_id", "key", "host", "path", *[(1 / (1 + F.exp(-odds(t)))).alias(f"{t}_probability") for t in targets], *[f"{level}_{t}" for t in targets for level in ("host", "path")], (F.col("toxic") > 0).alias("speaks"))
    rejected = (F.col("quality_probability") < good_from) | (F.col("speaks") & (F.col("toxic_probability") >= toxic_from))
    return scored.withColumn("kept", ~rejected).drop("speaks")
