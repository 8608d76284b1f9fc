"""Leader and complete linkage, clustering scores and nights over the documents against plain Python over all of them at once."""

from collections import defaultdict

import pytest
from compare import SF, views
from pyspark.sql import functions as F

from quernlake.functions import text as X
from quernlake.operators import lsh, notices
from quernlake.plans import catalogue
from quernlake.sources.tables import table
from quernlake.streaming.nightly import Settings

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def merged():
    """The class of each document and the similarities from tau up, both from DuckDB."""
    db = views()
    sim = {(a, b): j for a, b, j in db.sql(SQL["exact_jaccard_pairs"].replace("round(jaccard, 9)", "jaccard")).project("a, b, jaccard").fetchall()}
    return dict(db.sql(SQL["set_classes"]).project("doc_id, class_id").fetchall()), sim


def attached(ids, sim, policy):
    """Every notice meets every cluster there is, in the order of ids."""
    like = lambda x, y: sim.get((min(x, y), max(x, y)), 0)
    clusters = {}
    for new in sorted(ids):
        fits = {}
        for name, members in clusters.items():
            if any(like(new, m) for m in members):
                fits[name] = like(new, members[0]) if policy == "leader" else min(like(new, m) for m in members)
        best = sorted((c for c in fits if fits[c] > 0), key=lambda c: (-fits[c], c))
        if not best:
            clusters[f"OPP-{new}"] = [new]
            continue
        home = clusters[best[0]]
        for other in best[1:]:
            guests = clusters[other]
            if like(home[0], guests[0]) if policy == "leader" else all(like(x, y) for x in home for y in guests):
                home += clusters.pop(other)
        home.append(new)
    return {m: name for name, members in clusters.items() for m in members}


@pytest.mark.parametrize("policy", ["leader", "complete"])
def test_linkage_of_all_documents(spark, merged, policy):
    classes, sim = merged
    of = attached(set(classes.values()), sim, policy)
    got = {r.doc_id: r.opportunity_id for r in QUERIES[f"cluster_{policy}"](spark, SF).collect()}
    assert got == {doc: of[first] for doc, first in classes.items()} and len(set(of.values())) < len(of)


def test_scores_of_all_policies(spark, merged):
    classes, sim = merged
    pairs = views().sql(SQL["sketch_vs_exact"]).project("a, b, j_exact").fetchall()
    want = set()
    for policy in ("leader", "complete"):
        of = attached(set(classes.values()), sim, policy)
        for label in ("same", "different"):
            told = [of[a] == of[b] for a, b, j in pairs if (j >= 0.7) == (label == "same")]
            want.add((policy, label, len(told), sum(told)))
    got = {(r.policy, r.label, r.pairs, r.together) for r in QUERIES["score_clustering"](spark, SF).collect() if r.policy != "single"}
    assert got == want


def test_nights_of_all_documents(spark):
    """All seven steps of each night by loops over dictionaries; only signatures and keys, tested elsewhere, come from the engine."""
    s = Settings()
    docs = table(spark, SF, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sets = notices.shingle_sets(docs, "doc_id", X.normalised(F.col("text"), s.variant), s.scheme)
    shingles = {r.id: set(r.shingles) for r in sets.collect()}
    sketched = lsh.signatures(sets, s.k_rows).select("id", "sig", lsh.band_keys(F.col("sig"), s.bands, s.rows_per_band).alias("keys")).collect()
    sig, keys = {r.id: r.sig for r in sketched}, {r.id: list(enumerate(r["keys"])) for r in sketched if shingles[r.id]}
    last = max(shingles)
    step = max(1, last // 20)
    edges = [-1, last - 3 * step, last - 2 * step, last - step, last]
    index, blocked, want = defaultdict(set), set(), set()
    for night, (low, high) in enumerate(zip(edges, edges[1:], strict=False), 1):
        tonight = defaultdict(set)
        for x in keys:
            if low < x <= high:
                for bucket in keys[x]:
                    if bucket not in blocked:
                        tonight[bucket].add(x)
        pairs = {(min(x, y), max(x, y)) for b, members in tonight.items() for x in members for y in index.get(b, ())}
        if low < 0:
            pairs |= {(x, y) for members in tonight.values() if len(members) <= s.bucket_cap for x in members for y in members if x < y}
        for a, b in pairs:
            estimate = sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) / s.k_rows
            if estimate >= s.tau_sketch:
                exact = len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
                want.add((a, b, round(estimate, 9), round(exact, 9), "merge" if exact >= s.tau else "reject", night))
        for b, members in tonight.items():
            index[b] |= members
            if len(index[b]) > s.bucket_cap:
                blocked.add(b)
                del index[b]
    got = [(r.a, r.b, round(r.j_sketch, 9), round(r.j_exact, 9), r.decision, r.night) for r in QUERIES["nightly_incremental"](spark, SF).collect()]
    assert set(got) == want and len(got) == len(want) and len({x[-1] for x in want}) > 1
