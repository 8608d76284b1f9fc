"""Every query with SQL against DuckDB over the smallest tables; the others run and hold their invariants."""

import pytest
from compare import SF, assert_same, views

from quernlake.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and catalogue.FLAGSHIP in SQL


@pytest.mark.parametrize("name", ["cluster_leader", "cluster_complete"])
def test_linkage_refines_single_linkage(spark, name):
    coarse = {r.doc_id: r.opportunity_id for r in QUERIES["cluster_single"](spark, SF).collect()}
    fine = QUERIES[name](spark, SF).collect()
    groups = {}
    for r in fine:
        groups.setdefault(r.opportunity_id, set()).add(coarse[r.doc_id])
    assert len(fine) == len(coarse) and all(len(x) == 1 for x in groups.values())


def test_nightly_decisions_are_exact(spark):
    found = QUERIES["nightly_incremental"](spark, SF).collect()
    assert all((r.decision == "merge") == (r.j_exact >= 0.54) and r.a < r.b for r in found)
    assert len({(r.a, r.b) for r in found}) == len(found)


def test_production_sketch_has_a_row_for_each_document(spark):
    found = QUERIES["minhash_production_k384"](spark, SF).collect()
    assert len(found) == views().sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert all(len(r["keys"]) == 76 and min(r["keys"]) >= 0 and r.n_shingles >= 1 for r in found)


def test_random_and_candidate_pairs_over_few_documents(spark, tmp_path):
    """Fewer documents than are drawn, an odd number of them: all are paired but one, and every candidate is there once."""
    texts = [" ".join(f"w{k * 100 + i}" for i in range(12)) for k in range(8)] + ["a b c d e f g h i j k", "a b c d e f g h i j l", "a b c d e f g h i j m"]
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    frame = QUERIES["random_and_lsh_pairs"](spark, str(tmp_path)).cache()
    assert_same(frame, SQL["random_and_lsh_pairs"], str(tmp_path))
    found = [(r.a, r.b) for r in frame.collect()]
    candidates = {(r.a, r.b) for r in QUERIES["lsh_candidates_b4r4"](spark, str(tmp_path)).collect()}
    assert len(set(found)) == len(found) and candidates and candidates <= set(found) and all(a < b for a, b in found)
    assert len({x for pair in found for x in pair}) >= len(texts) - 1
