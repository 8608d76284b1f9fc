"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum, pre-aggregated before its shuffle, and an equi-join with the edges, whose hot nodes
are split at run time; the edges of each round are a table in the shared folder. The number of rounds grows with the
logarithm of the number of nodes, whatever the diameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.shared import write_shared

#: Edges that a task reduces to stars at a time.
FOREST_EDGES = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the smallest of them; edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).where("x != y")
    return moved.union(least.select("m", "b")).toDF("a", "b").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each so many edges only a star for each component, which links the same nodes."""
    held, n = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy() for k in (0, 1)]))
        n += batch.num_rows
        if n >= FOREST_EDGES:
            yield _stars(np.concatenate(held, axis=1))
            held, n = [], 0
    if n:
        yield _stars(np.concatenate(held, axis=1))


def _stars(edges: np.ndarray) -> pa.RecordBatch:
    """Roots hook to the smallest root next to them and paths are halved until nothing moves."""
    nodes, at = np.unique(edges, return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        least = np.minimum(root[x], root[y])
        for side in (root[x], root[y]):
            np.minimum.at(root, side, least)
        root = root[root]
        if (root == before).all():
            break
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[root[child]]), pa.array(nodes[child])], ["a", "b"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node of its component, for every node that an edge between two nodes has. Raises if that takes more than `rounds` rounds."""
    ends = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x != y")
    current = write_shared(ends.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(current.frame)
    for left in reversed(range(rounds)):
        following = write_shared(_small_star(_large_star(current.frame)), "edges")
        after = mark(following.frame)
        current.drop()
        current = following
        if after == before:
            break
        if not left:
            raise ValueError(f"the components still change after {rounds} rounds")
        before = after
    found = current.frame
    return found.select(F.col("b").alias("node"), F.col("a").alias("component")).union(found.select("a", "a").distinct())
