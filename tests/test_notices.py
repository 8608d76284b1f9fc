"""Normal forms, sketches, clusters and nights against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernlake.functions import text as X
from quernlake.operators import evaluate, linkage, lsh, notices
from quernlake.operators.components import connected_components
from quernlake.streaming import nightly


def column(spark, values, make):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(make(F.col("v"))).collect()]


def test_normal_forms(spark):
    texts = ["Tender No. AB/12 due 12-03-2024, Rs. 4,50,00,000/- only", "Bid on 3 March 2024 for 1,234 items ref nit-2024-55", None, "A  B\n\n\nC", "É é"]
    assert column(spark, texts, lambda v: X.normalised(v, "canon")) == ["<ref> due <date> <money_450e5> only", "bid on <date> for <num> items ref <ref>", "", "a b\nc", "é é"]
    assert column(spark, texts[:2], lambda v: X.normalised(v, "mask"))[1] == "bid on <date> for <num> items ref <ref>"
    with pytest.raises(ValueError):
        X.normalised(F.col("v"), "other")


def test_grams(spark):
    assert column(spark, ["", "a b c", "a b c d e f", "a a a a a a a"], lambda v: F.size(X.word_grams(v, 5))) == [1, 1, 2, 1]
    assert column(spark, ["", "abcd", "é12345", "aaaaaaa"], lambda v: F.size(X.byte_grams(v, 5))) == [0, 0, 3, 1]


def test_boilerplate_is_strictly_over_the_share(spark):
    line = "this line is the template of the portal"
    rows = [(k, "p", line + ("\n" + line if k == 0 else "") if k < 12 else "own") for k in range(20)] + [(100 + k, "q", line) for k in range(19)] + [(200, "p2", None)]
    docs = spark.createDataFrame(rows, "id int, portal_id string, body string")
    assert notices.learn_boilerplate(docs).count() == 0
    found = notices.learn_boilerplate(docs.where("id != 19"), least_notices=19)
    assert {(r.portal, r.notices) for r in found.collect()} == {("p", 12), ("q", 19)}
    cleaned = notices.with_boilerplate(docs, found).select("id", X.normalised(F.col("body"), "mask", F.col("boilerplate")).alias("t"))
    got = {r.id: r.t for r in cleaned.collect()}
    assert got[0] == "" and got[15] == "own" and got[200] == ""


def sets_of(spark, lists):
    return spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "id long, shingles array<bigint>")


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.fixture(scope="module")
def family():
    rng = random.Random(3)
    base = [rng.sample(range(2000), 30) for _ in range(12)]
    made = [sorted({*rng.sample(b, 30 - d), *rng.sample(range(2000, 9000), d)}) for b in base for d in (0, 2, 5, 9)]
    return [*made, [], [], [1], [1]]


@pytest.mark.parametrize("tau", [0.3, 0.54, 0.8])
def test_similar_pairs_miss_none(spark, family, tau):
    got = {(r.a, r.b) for r in notices.similar_pairs(sets_of(spark, family), tau).collect()}
    n = range(len(family))
    assert got == {(i, j) for i in n for j in n if i < j and jaccard({*family[i]}, {*family[j]}) >= tau}


def test_search_and_classes(spark, family):
    sets = sets_of(spark, family)
    got = {(r.query_id, r.id): r.jaccard for r in notices.search(sets.where("id < 3"), sets).collect()}
    for (q, i), j in got.items():
        assert abs(j - jaccard({*family[q]}, {*family[i]})) < 1e-12
    assert len(got) == sum(jaccard({*family[q]}, {*f}) > 0 for q in range(3) for f in family)
    classes = {r.id: r.class_id for r in notices.representatives(sets).collect()}
    assert classes[51] == classes[50] == 50 and classes[48] == 48 and classes[49] == 49


def test_production_signatures(spark, family):
    """Unsigned minima, all ones for an empty set, estimates near the truth."""
    got = {r.id: np.array(r.sig, np.int64).view(np.uint64) for r in lsh.signatures(sets_of(spark, family), 384).collect()}
    assert (got[48] == np.iinfo(np.uint64).max).all()
    for i, j in ((0, 1), (0, 2), (0, 3), (4, 9)):
        assert abs((got[i] == got[j]).mean() - jaccard({*family[i]}, {*family[j]})) < 0.11
    constants = np.random.Generator(np.random.PCG64(lsh.SEED)).integers(0, 2**63, size=384, dtype=np.int64).astype(np.uint64)
    flat = np.array(family[5], np.uint64)
    assert got[5].tolist() == [int(lsh._mixed(flat + c).min()) for c in constants]


def test_packed_signature(spark):
    row = spark.createDataFrame([([1, -1, 258],)], "sig array<bigint>").select(lsh.packed(F.col("sig"))).first()[0]
    assert bytes(row) == np.array([1, 2**32 - 1, 258], "<u4").tobytes()


def test_candidates_caps_and_links(spark):
    buckets = spark.createDataFrame([(0, 7, k) for k in range(5)] + [(1, 7, 0), (1, 7, 1), (1, 8, 2)], "band_no int, bucket_key long, id long")
    assert lsh.candidate_pairs(buckets).count() == 10
    assert {tuple(r) for r in lsh.candidate_pairs(buckets, 4).collect()} == {(0, 1)}
    assert [(r.band_no, r.members) for r in lsh.suppressed(buckets, 4).collect()] == [(0, 5)] and lsh.suppressed(buckets, 5).count() == 0
    assert {tuple(r) for r in lsh.suppressed_links(buckets, 4).collect()} == {(0, k) for k in range(1, 5)}
    assert {r.id: r.emissions for r in lsh.per_row_work(buckets, 4).collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}
    assert abs(lsh.lsh_threshold() - 0.4206) < 1e-4


def test_bucketed_index_is_joined_without_a_shuffle(spark):
    buckets = spark.range(200).selectExpr("CAST(id % 4 AS INT) AS band_no", "id % 9 AS bucket_key", "id")
    spark.sql("DROP TABLE IF EXISTS lsh_index")
    lsh.write_buckets(buckets, "lsh_index", 4)
    index = spark.table("lsh_index").hint("merge")
    plan = index.alias("a").join(index.alias("b"), ["band_no", "bucket_key"])._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE lsh_index")
    assert "Exchange hashpartitioning" not in plan


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(5, 5)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


CHAIN = [(1, 2, 0.9), (2, 3, 0.6)]


@pytest.mark.parametrize(("policy", "pairs", "want"), [
    ("single", CHAIN, [{1, 2, 3}, {9}]),
    ("complete", CHAIN, [{1, 2}, {3}, {9}]),
    ("leader", CHAIN, [{1, 2}, {3}, {9}]),
    ("leader", [(1, 2, 0.6), (1, 3, 0.6)], [{1, 2, 3}, {9}]),
    ("complete", [(1, 2, 0.6), (1, 3, 0.6)], [{1, 2}, {3}, {9}]),
    ("complete", [(1, 3, 0.8), (2, 3, 0.7), (1, 9, 0.6), (3, 9, 0.6)], [{1, 3, 9}, {2}]),
])
def test_linkage(spark, policy, pairs, want):
    ids = spark.createDataFrame([(1,), (2,), (3,), (9,)], "id long")
    found = linkage.linked(ids, spark.createDataFrame(pairs, "a long, b long, similarity double"), policy).where("id IS NOT NULL").collect()
    groups = {}
    for r in found:
        groups.setdefault(r.opportunity_id, set()).add(r.id)
    assert sorted(groups.values(), key=min) == sorted(want, key=min)


def test_a_bridge_absorbs_and_leaves_an_alias(spark):
    """1 and 2 aren't linked when they come; 3 is near both, and the founders agree by then only if the pair is known."""
    pairs = [(1, 4, 0.9), (2, 3, 0.9), (1, 2, 0.6), (1, 3, 0.6), (2, 4, 0.6), (3, 4, 0.6)]
    run = linkage.Replay("complete", {(a, b): s for a, b, s in pairs})
    run.attach(1, [])
    run.attach(2, [])
    run.attach(3, [2])
    run.attach(4, [1, 2, 3])
    assert len(run.members) == 1 and run.aliases == [("OPP-2", "OPP-1")]
    before = spark.createDataFrame([(1, "OPP-1"), (2, "OPP-2"), (7, "OPP-7")], "id long, opportunity_id string")
    after = spark.createDataFrame([(1, "OPP-1"), (2, "OPP-1")], "id long, opportunity_id string")
    aliases = spark.createDataFrame([("OPP-2", "OPP-1")], "alias_id string, opportunity_id string")
    assert {tuple(r) for r in linkage.bookmark_check(before, after, aliases).collect()} == {("intact", 1), ("redirected", 1), ("broken", 1)}


def test_alias_chains_and_cycles(spark):
    rows = [("x", "y"), ("y", "z"), *[(f"c{k}", f"c{k + 1}") for k in range(20)], ("p", "q"), ("q", "p")]
    got = {r.alias_id: r.opportunity_id for r in linkage.resolve(spark.createDataFrame(rows, "alias_id string, opportunity_id string")).collect()}
    assert got["x"] == got["y"] == "z" and {got[f"c{k}"] for k in range(20)} == {"c20"} and {got["p"], got["q"]} <= {"p", "q"}


def test_measures(spark):
    scores = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False)], "score double, positive boolean")
    assert evaluate.auc(scores).first().auc == 3.5 / 4
    assert tuple(evaluate.recall_at_zero_false(scores).first()) == (0.5, 0.5)
    assert evaluate.best_threshold(scores, 50.0).first().threshold == 0.9 and evaluate.best_threshold(scores, 0.1, ends=True).first().threshold == 0.5
    assert abs(spark.range(1).select(evaluate.zero_event_bound(F.lit(621.0))).first()[0] - 0.00481) < 1e-5
    assert abs(spark.range(1).select(lsh.p_candidate(F.lit(0.5419))).first()[0] - 0.97367) < 1e-4


WORDS = "a quick brown fox jumps over the lazy dog while nine bright stars burn far away beyond the silent hills of home".split()


def test_nights(spark, tmp_path):
    """A repeated notice is found a night later; a night can be repeated; the settings hold after opening again."""
    text = " ".join(WORDS)
    near = " ".join([*WORDS[:-1], "peace"])
    batch = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    settings = nightly.Settings(k_rows=40, bands=20, rows_per_band=2, bucket_cap=3)
    index = nightly.Index(spark, str(tmp_path / "i"), settings)
    assert index.night(batch((1, text), (2, "other words entirely here now and then"), (3, None))).count() == 0
    assert [(r.a, r.b, r.decision) for r in index.night(batch((4, near), (5, near))).collect() if r.decision == "merge"] == [(1, 4, "merge"), (1, 5, "merge")]
    assert index.night(batch((4, near))).count() == 0
    again = nightly.Index(spark, str(tmp_path / "i"))
    assert again.settings == settings and again.table("notices").count() == 5
    with pytest.raises(ValueError):
        nightly.Index(spark, str(tmp_path / "i"), nightly.Settings())
    assert again.night(batch((6, near), (7, near))).where("decision = 'merge'").count() >= 4
    assert again.table("suppressed").count() > 0 and lsh.suppressed(again.table("buckets"), 3).count() == 0


def test_nights_from_a_stream(spark, tmp_path):
    spark.createDataFrame([(k, " ".join(WORDS[k:])) for k in range(4)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    index = nightly.Index(spark, str(tmp_path / "i"), nightly.Settings(k_rows=8, bands=4, rows_per_band=2))
    nightly.follow(stream, index, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert nightly.Index(spark, str(tmp_path / "i")).table("notices").count() == 4


def test_stream_of_lines_once(spark, tmp_path):
    rows = [("B1", 1, "2024-01-01 10:00:00"), ("B1", 1, "2024-01-02 10:00:00"), ("B1", 2, "2024-01-01 10:00:00")]
    spark.createDataFrame(rows, "bill_no string, line_no int, ts string").selectExpr("bill_no", "line_no", "CAST(ts AS TIMESTAMP) AS ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("bill_no string, line_no int, ts timestamp").parquet(str(tmp_path / "in"))
    query = nightly.deduplicated(stream).writeStream.format("memory").queryName("lines_once").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("lines_once").count() == 2
