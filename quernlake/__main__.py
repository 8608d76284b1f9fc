"""Runs stages of the two workloads over a folder of tables: python -m quernlake --data DIR --out DIR [stage ...].

Each query of a stage is written as Parquet under DIR/<query>; the stage's rows and seconds go to DIR/<stage>.json. A query
that fails is named there and the run ends with status 1 after the stage; the stages before it stay.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from quernlake.plans import catalogue, dedup_queries, sales_queries
from quernlake.session import local_session
from quernlake.sources.warehouse import write_metrics

_PREFIXES = {
    "texts": ("doc_", "money_", "line_", "shingle_", "df_", "set_"),
    "similarity": ("jaccard_", "exact_", "paired_", "representation", "recall_", "auc", "threshold_", "score_quantiles"),
    "sketches": ("minhash_", "sketch_", "s_curve", "random_"),
    "index": ("pair_endpoints", "sources_by_size", "lsh_", "bucket_", "per_notice", "emission_", "skew_", "source_", "worst_", "growth_"),
    "clusters": ("cascade_", "decision_", "cluster_", "opportunity_", "alias_", "score_clustering"),
    "nights": ("nightly_",),
}


def stages() -> dict[str, list[str]]:
    """The queries of each stage, in the catalogue's order."""
    of = {"sales": list(sales_queries.QUERIES)}
    of |= {stage: [q for q in dedup_queries.QUERIES if q.startswith(prefixes)] for stage, prefixes in _PREFIXES.items()}
    return of


def run_stage(spark: SparkSession, stage: str, data: str, out: str) -> dict[str, dict]:
    """Runs a stage's queries and gives back what its JSON file holds."""
    figures: dict[str, dict] = {}
    for name in stages()[stage]:
        start = time.perf_counter()
        try:
            catalogue.queries()[name](spark, data).write.mode("overwrite").parquet(f"{out}/{name}")
            figures[name] = {"rows": spark.read.parquet(f"{out}/{name}").count(), "seconds": round(time.perf_counter() - start, 3)}
        except Exception as failure:  # noqa: BLE001  named in the stage's file, and the run's status tells
            figures[name] = {"error": str(failure)[:2000]}
    write_metrics(spark, f"{out}/{stage}.json", figures)
    return figures


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="quernlake")
    parser.add_argument("stages", nargs="*", metavar="stage", help=f"of {', '.join(stages())}; all if none is named")
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    asked = parser.parse_args(arguments)
    unknown = set(asked.stages) - set(stages())
    if unknown:
        parser.error(f"unknown stages: {', '.join(sorted(unknown))}")
    spark = SparkSession.getActiveSession() or local_session("quernlake")
    for stage in asked.stages or stages():
        if any("error" in x for x in run_stage(spark, stage, asked.data, asked.out).values()):
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
