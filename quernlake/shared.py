"""The folder that the driver and all executors share, and tables written there to cut lineage.

A table in the shared folder outlives any executor, so an iterative job that writes each round there never
recomputes earlier rounds and never depends on one machine's disk.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this machine only where that is unset and all tasks run on it (tests, local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quernlake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    if not _left:
        atexit.register(_remove_left)
    path = f"{shared_dir(spark)}/quernlake/{label}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _left[:] = [x for x in _left if x[1] != path]


def _remove_left() -> None:
    for spark, path in list(_left):
        try:
            remove(spark, [path])
        except Exception:  # noqa: BLE001  the session may have ended already; the folder is scratch space
            return


class Written:
    """A table in the shared folder: `frame` reads it, `drop` deletes it."""

    def __init__(self, frame: DataFrame, path: str):
        self.frame, self.path = frame, path

    def drop(self) -> None:
        remove(self.frame.sparkSession, [self.path])


def write_shared(frame: DataFrame, label: str) -> Written:
    """Runs `frame` once and gives back a table of its rows in the shared folder."""
    spark = frame.sparkSession
    path = new_path(spark, label)
    frame.write.option("compression", "zstd").parquet(path)
    return Written(spark.read.schema(frame.schema).parquet(path), path)
