"""Timelines cut into successive segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.functions.scalars import hms_is_valid, hms_seconds
from tallywise.operators.ordered import split_lag


def rejected_cuts(cuts: DataFrame, cut: str = "cut") -> DataFrame:
    """Cut points that are not ``hh:mm:ss``."""
    return cuts.where(~hms_is_valid(F.trim(cut)))


def segments(cuts: DataFrame, keys: Sequence[str] = ("video_id",), seq: str = "seq", cut: str = "cut",
             duration: str = "duration", bucket_size: int = 10_000) -> DataFrame:
    """Segments from each cut to the next, in the order of ``seq``; the rest is the last segment.

    Malformed cuts are left out (see ``rejected_cuts``). A timeline with very many cuts is split
    by ranges of ``seq``.
    """
    keys = list(keys)
    timed = (
        cuts.withColumn("_end", hms_seconds(F.trim(cut)).cast("double")).where(F.col("_end").isNotNull())
        .select(*keys, seq, duration, "_end")
    )
    parts = split_lag(timed, keys, [seq], F.floor(F.col(seq) / bucket_size), "_end", "_start", "part").select(
        *keys, F.col("part").cast("bigint").alias("part"),
        F.coalesce("_start", F.lit(0.0)).alias("start_s"), F.col("_end").alias("end_s"))
    last = timed.groupBy(*keys).agg(
        F.max(F.struct(seq, "_end"))["_end"].alias("start_s"), F.max(duration).alias("end_s"),
        (F.count(F.lit(1)) + 1).alias("part"))
    tail = last.where(F.col("start_s") < F.col("end_s")).select(*keys, "part", "start_s", "end_s")
    return parts.unionByName(tail)
