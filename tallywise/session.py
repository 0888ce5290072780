"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange above the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators count on; cluster sizing is left alone."""
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; with a local master alone a temporary one if unset."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallywise-"))
        current = context.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in _recording:
        paths.append(path)
    return path


_recording: list[list[str]] = []


@contextmanager
def recorded_scratch() -> Iterator[list[str]]:
    """The scratch paths made inside, for ``remove_scratch`` once what was made from them is written."""
    paths: list[str] = []
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording.pop()


def remove_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables; nothing may read them any more."""
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside removes its shuffle files as it ends, instead of when the JVM next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What led to it is computed once however often it is read, and lost executors do not replay it.
    """
    return cut_parts([df])


def cut_parts(parts: Sequence[DataFrame], **options: str) -> DataFrame:
    """``cut_lineage`` of the union of ``parts``, which are written one after the other."""
    path = scratch_path(parts[0].sparkSession, "table")
    for df in parts:
        df.write.options(**options).mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
