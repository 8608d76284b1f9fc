"""Pairs that meet in blocks against loops over all pairs."""

import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernlake.operators import components, evaluate, linkage, lsh, notices, overlaps
from quernlake.streaming import nightly


@pytest.fixture(scope="module")
def lists():
    """A cluster of near copies, small families, sets that share one common element only, and an empty one."""
    rng = random.Random(11)
    base = rng.sample(range(10**6), 60)
    near = [sorted({*rng.sample(base, 50), *rng.sample(range(10**6), 8)}) for _ in range(40)]
    families = [sorted({7, *range(k, k + 20), *rng.sample(range(10**6), d)}) for k in (2 * 10**6, 3 * 10**6) for d in (0, 6, 14)]
    return [*near, *families, *[sorted({7, *rng.sample(range(10**7, 10**8), 30)}) for _ in range(10)], []]


def jaccard(a, b):
    return len({*a} & {*b}) / len({*a} | {*b}) if a and b else 0.0


def test_shared_counts(lists):
    left, right = lists[:30], lists[20:]
    arrow = lambda x: pa.chunked_array([pa.array(x, pa.list_(pa.int64()))])
    want = np.array([[len({*a} & {*b}) for b in right] for a in left])
    for dense, step in ((300, 4_000_000), (10**9, 1), (1, 5)):
        before = overlaps.DENSE, overlaps.STEP
        overlaps.DENSE, overlaps.STEP = dense, step
        assert (overlaps.shared(arrow(left), arrow(right)) == want).all()
        overlaps.DENSE, overlaps.STEP = before
    assert not overlaps.shared(arrow([[1]]), arrow([[2], []])).any()


@pytest.mark.parametrize("small", [False, True])
def test_pairs_of_blocks(spark, lists, monkeypatch, small):
    """The same with sets of one cluster dealt over many blocks; equal rows of sketches and other sets come along."""
    if small:
        monkeypatch.setattr(notices, "BLOCK_SETS", 4)
    sets = spark.createDataFrame(list(enumerate(lists)), "id long, shingles array<bigint>")
    half = sets.select("id", F.filter("shingles", lambda x: x % 2 == 0).alias("shingles"))
    found = notices.similar_pairs(sets, 0.3, lsh.portable_signatures(sets, 16), lambda ids: half.join(ids, "id", "left_semi")).collect()
    sig = {r.id: r.sig for r in lsh.portable_signatures(sets, 16).collect()}
    n = range(len(lists))
    assert sorted((r.a, r.b) for r in found) == [(i, j) for i in n for j in n if i < j and jaccard(lists[i], lists[j]) >= 0.3]
    for r in found:
        even = [[x for x in lists[k] if x % 2 == 0] for k in (r.a, r.b)]
        assert r.jaccard == jaccard(lists[r.a], lists[r.b]) and abs(r.other - jaccard(*even)) < 1e-12
        assert r.same == sum((x == y) << k for k, (x, y) in enumerate(zip(sig[r.a], sig[r.b], strict=True)))
    queries = sets.where("id % 3 = 0")
    asked = {(r.query_id, r.id): r.shared for r in notices.search(queries, sets, 0.1).collect()}
    assert asked == {(i, j): len({*lists[i]} & {*lists[j]}) for i in n if i % 3 == 0 for j in n if jaccard(lists[i], lists[j]) >= 0.1}


def test_a_cluster_meets_once_a_block_and_not_once_a_shingle(spark, lists):
    """40 sets of some 60 shingles made 780 pairs and over 20,000 rows of a join."""
    sets = spark.createDataFrame(list(enumerate(lists[:40])), "id long, shingles array<bigint>")
    heads = notices._heads(notices._related(sets.select(F.lit(True).alias("asked"), "id", "shingles"), 0.3, F.col("queries") > 1))
    met = notices._met(heads, heads)
    assert met.count() <= 40 * met.select("block").distinct().count() < 40 * 40


def test_sets_of_own_shingles_end_early(spark, lists):
    sets = spark.createDataFrame(list(enumerate(lists)), "id long, shingles array<bigint>")
    assert {r.id for r in notices._related(sets.select(F.lit(True).alias("asked"), "id", "shingles"), 0.3, F.col("queries") > 1).collect()} == set(range(46))


def test_frequent_shingles_whose_remainders_collide(spark):
    n = notices.REMAINDERS
    sets = spark.createDataFrame([(k, [5, 5 + n * (k + 1), -9]) for k in range(10)] + [(10, []), (11, [5, -9])], "id long, shingles array<bigint>")
    got = {r.id: r.shingles for r in notices.without_frequent(sets, 0.5).collect()}
    assert got == {**{k: [5 + n * (k + 1)] for k in range(10)}, 10: [], 11: []}


def test_row_dependence_from_bits(spark):
    row = evaluate.row_dependence(spark.createDataFrame([(0b1111_0000, 0.5), (0b0011_0011, 0.5)], "same long, j_exact double"), 8, 4).first()
    assert row.pairs == 2 and abs(row.half_spread - 0.5) < 1e-12


def test_stars_have_the_components_of_their_edges():
    path = np.random.default_rng(4).permutation(3000)
    edges = np.stack([path[:-1], path[1:]])[:, np.arange(2999) % 7 != 0]
    made = components._stars(edges).to_pydict()
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges.T.tolist():
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    assert dict(zip(made["b"], made["a"], strict=True)) == {x: top(x) for x in list(parent) if top(x) != x}


@pytest.mark.parametrize("policy", ["leader", "complete"])
def test_replay_is_linear_in_a_large_component(spark, policy):
    """A cluster of 700 all alike, then chains: over 240,000 pairs. The former replay looked up every pair of members of each two clusters."""
    n = 700
    pairs = [(a, b, 0.9) for b in range(n) for a in range(b)]
    began = time.time()
    run = linkage.Replay(policy)
    for b in range(n):
        run.attach(b, list(range(b)), [0.9] * b)
    assert len(run.members) == 1 and time.time() - began < 10
    frame = spark.createDataFrame(pd.DataFrame(pairs[::7] + [(n + k, n + k + 1, 0.6) for k in range(50)], columns=["a", "b", "similarity"]))
    known = {(r.a, r.b): r.similarity for r in frame.collect()}
    whole = linkage.Replay(policy, known)
    for x in range(n + 51):
        whole.attach(x, [y for y in whole.known[x] if y < x])
    got = linkage.linked(spark.range(n + 51), frame, policy).collect()
    assert {r.id: r.opportunity_id for r in got if r.id is not None} == whole.cluster_of
    assert sorted((r.opportunity_id, r.alias_of) for r in got if r.id is None) == sorted(whole.aliases)


def test_a_night_writes_its_own_rows_only(spark, tmp_path):
    """Each version of the index used to repeat all notices and buckets of the nights before."""
    batch = lambda ids: spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(9))) for k in ids], "doc_id long, text string")
    index = nightly.Index(spark, str(tmp_path / "i"), nightly.Settings(k_rows=8, bands=4, rows_per_band=2))
    for ids in (range(6), range(6, 8), [8, 8]):
        index.night(batch(ids))
    rows = [spark.read.parquet(str(tmp_path / "i" / str(v) / "notices")).count() for v in range(4)]
    assert rows == [0, 6, 2, 1] and index.table("notices").count() == 9 and index.table("buckets").count() == 36


def test_stated_pairs_are_scored_in_blocks(spark, lists, monkeypatch):
    monkeypatch.setattr(notices, "BLOCK_SETS", 5)
    sets = spark.createDataFrame(list(enumerate(lists)), "id long, shingles array<bigint>")
    stated = [(a, b) for a in range(0, 57, 3) for b in range(a + 1, 57, 5)]
    got = {(r.a, r.b): (r.j_sketch, r.j_exact) for r in notices.scored_pairs(spark.createDataFrame(stated, "a long, b long"), lsh.signatures(sets, 70, with_sets=True)).collect()}
    sig = {r.id: r.sig for r in lsh.signatures(sets, 70).collect()}
    assert got == {(a, b): (sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) / 70, jaccard(lists[a], lists[b])) for a, b in stated}
