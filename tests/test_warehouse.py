"""Checks, statistics, plans, metrics and the stage runner; measures by random draws against the law."""

import json
import math

import pytest
from compare import SF

from quernlake import __main__ as runner
from quernlake.operators import checks, evaluate, plan_facts
from quernlake.sources import warehouse


def only(frame):
    return frame.first()["violations"]


def test_checks(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", None), (None, "a", 7), (None, None, 9), (3, "c", 1)], "k int, s string, n int")
    parent = spark.createDataFrame([(1,), (None,)], "k int")
    assert only(checks.not_null(rows, "t", "s")) == 1 and only(checks.unique(rows, "t", "k")) == 1 and only(checks.unique(rows, "t", "k", "s")) == 0
    assert only(checks.references(rows, "t", "k", parent, "k")) == 1  # nulls refer to nothing, and no null answers them
    assert only(checks.holds(rows, "t", "n < 7")) == 2  # unknown passes
    empty = rows.limit(0)
    assert [only(x) for x in (checks.not_null(empty, "t", "s"), checks.unique(empty, "t", "k"), checks.references(empty, "t", "k", parent, "k"), checks.holds(empty, "t", "n < 7"))] == [0] * 4


def test_statistics_need_an_analysis(spark, tmp_path):
    warehouse.ensure_database(spark, "quernlake_stats")
    warehouse.ensure_database(spark, "quernlake_stats")  # there already
    spark.range(5).write.mode("overwrite").option("path", f"file://{tmp_path}/t").saveAsTable("quernlake_stats.t")
    assert warehouse.statistics(spark, "quernlake_stats.t").first().n_rows is None
    warehouse.analyse(spark, "quernlake_stats.t", ("id",))
    found = warehouse.statistics(spark, "quernlake_stats.t", ("id",)).first()
    assert (found.n_rows, found.column, found.low, found.high, found.nulls) == (5, "id", "0", "4", 0) and found.n_bytes > 0
    spark.sql("DROP DATABASE quernlake_stats CASCADE")


def test_plan_facts(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 2 AS p", "id * 2 AS v").write.partitionBy("p").parquet(f"file://{tmp_path}/t")
    rows = spark.read.parquet(f"file://{tmp_path}/t")
    assert plan_facts.summary(rows.where("p = 1 AND v > 4").select("v")) == (1, 0, "p", "v", "v")
    assert plan_facts.summary(rows.groupBy("p").count())[:2] == (1, 1)
    names = [r.name for r in plan_facts.node_rows(rows.where("v > 4")).collect()]
    assert any(n.startswith("Scan parquet") for n in names) and "Filter" in names


def test_metrics_are_replaced(spark, tmp_path):
    for value in (1, 2):
        warehouse.write_metrics(spark, f"file://{tmp_path}/m.json", {"é": value})
    assert json.loads((tmp_path / "m.json").read_text()) == {"é": 2}


def test_stages_hold_every_query_once_and_report_failures(spark, tmp_path, monkeypatch):
    from quernlake.plans import catalogue

    named = [q for queries in runner.stages().values() for q in queries]
    assert len(named) == len(set(named))
    assert set(named) == set(catalogue.queries())
    monkeypatch.setattr(runner, "stages", lambda: {"sales": ["dim_store", "nosuch"]})
    assert runner.main(["sales", "--data", SF, "--out", f"file://{tmp_path}"]) == 1
    figures = json.loads((tmp_path / "sales.json").read_text())
    assert figures["dim_store"]["rows"] > 0 and "error" in figures["nosuch"]
    with pytest.raises(SystemExit):
        runner.main(["other", "--data", SF, "--out", str(tmp_path)])


def test_independent_permutations_follow_the_law(spark):
    rows = [(k, k + 1, list(range(k, 100)), list(range(3 * k, 100 + k))) for k in (10, 20, 25)] + [(90, 91, [], [])]
    found = evaluate.monte_carlo(spark.createDataFrame(rows, "a long, b long, set_a array<bigint>, set_b array<bigint>"), rows=64, replications=600).collect()
    for r, (_, _, x, y) in zip(found, rows, strict=True):
        assert r.jaccard == pytest.approx(len(set(x) & set(y)) / len(set(x) | set(y)) if x else 0)
        assert r.law_spread == pytest.approx(math.sqrt(r.jaccard * (1 - r.jaccard) / 64)) and abs(r.drawn_spread - r.law_spread) <= 0.12 * r.law_spread


def test_bootstrap_with_one_sided_rows(spark):
    scores = "key string, score double, positive boolean"
    above = spark.createDataFrame([(str(k), 0.9, True) for k in range(40)] + [(str(-k), 0.1, False) for k in range(1, 40)], scores)
    assert tuple(evaluate.bootstrap_recall(above, 50, 1).first()) == (50, 1.0, 1.0)
    assert tuple(evaluate.bootstrap_recall(above.where("positive"), 50, 1).first()) == (50, 1.0, 1.0)
    assert tuple(evaluate.bootstrap_recall(above.where("NOT positive"), 50, 1).first()) == (0, None, None)
    assert tuple(evaluate.bootstrap_recall(above.limit(0), 50, 1).first()) == (0, None, None)
    assert evaluate._poisson_steps()[0] == int(math.exp(-1) * 2**32)
