"""What Spark plans for a DataFrame, as rows: its nodes, and what each scan prunes, pushes down and reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NODES = "node int, name string, pruned_by array<string>, pushed array<string>, columns array<string>"


def formatted(frame: DataFrame) -> str:
    """The text of explain("formatted"), with lists of any length written out."""
    spark = frame.sparkSession
    limit = "spark.sql.maxMetadataStringLength"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "1000000")
    try:
        return spark.sparkContext._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set(limit, before)


def _names(pattern: str, line: str) -> list[str]:
    return sorted(set(re.findall(pattern, line)))


def nodes(frame: DataFrame) -> list[tuple[int, str, list[str], list[str], list[str]]]:
    """(node, name, pruned_by, pushed, columns) of each physical node. Nothing is executed; under AQE it is the plan before it adapts."""
    found = []
    for block in re.split(r"\n\n+", formatted(frame)):
        head = re.match(r"\((\d+)\) (\S.*?)(?: \[codegen id : \d+\])?\s*(?:\n|$)", block.lstrip("\n"))
        if not head:
            continue
        stated = dict(re.findall(r"^(\w+): (.*)$", block, re.M))
        read = T.DataType.fromDDL(stated["ReadSchema"]).fieldNames() if "ReadSchema" in stated else []
        found.append((int(head[1]), head[2].strip(), _names(r"(\w+)#\d+", stated.get("PartitionFilters", "")), _names(r"\((\w+)[,)]", stated.get("PushedFilters", "")), read))
    return found


def node_rows(frame: DataFrame) -> DataFrame:
    return frame.sparkSession.createDataFrame(nodes(frame), NODES)


def summary(frame: DataFrame) -> tuple[int, int, str, str, str]:
    """(scans, exchanges, pruned_by, pushed, columns) over the whole plan; names are sorted and joined by commas."""
    all_nodes = nodes(frame)
    joined = lambda k: ",".join(sorted({x for n in all_nodes for x in n[k]}))
    scans = sum(n[1].startswith("Scan") for n in all_nodes)
    return scans, sum("Exchange" in n[1] for n in all_nodes), joined(2), joined(3), joined(4)
