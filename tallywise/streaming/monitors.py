"""Structured Streaming forms of the monitoring features.

Counts are exact for windows the watermark has closed; later rows are dropped by Spark, or counted
by the per-key state of ``stream_gaps``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallywise.functions.scalars import safe_flag, whole_days
from tallywise.operators.ordered import split_lag
from tallywise.session import scratch_path

# Windows count from Thursday 1970-01-01; weeks here start on Monday.
WEEK_OFFSET = "4 days"
MICROS_PER_DAY = 86_400_000_000


def read_event_stream(spark: SparkSession, folder: str, schema: str, pattern: str, ts: str = "ts",
                      delay: str = "1 day", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream with a watermark on ``ts``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    stream = reader.parquet(folder)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def without_repeats(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows delivered again within the watermark delay."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def _window(ts: str, period: str) -> Column:
    if period == "week":
        return F.window(ts, "1 week", startTime=WEEK_OFFSET)
    return F.window(ts, f"1 {period}")


def stream_velocity(stream: DataFrame, entity: str, ts: str = "ts", period: str = "day") -> DataFrame:
    """Rows per entity and tumbling window."""
    return stream.groupBy(_window(ts, period).alias("w"), entity).agg(F.count(F.lit(1)).alias("txns")).select(
        entity, F.col("w.start").alias("window_start"), "txns")


def flag_velocity(counts: DataFrame, baseline: DataFrame, entity: str, sigmas: float = 4.0) -> DataFrame:
    """Windows above the entity's stored mean + ``sigmas`` deviations; unknown entities never are."""
    limit = F.col("mean") + sigmas * F.col("std")
    return counts.join(baseline.select(entity, "mean", "std"), entity, "left").select(
        entity, "window_start", "txns", safe_flag(F.col("txns") > limit).alias("anomaly"))


def stream_refunds(stream: DataFrame, entity: str, is_refund: Column, amount: Column, ts: str = "ts",
                   period: str = "day") -> DataFrame:
    """Share of refunds in the number and in the amount of transactions, per entity and window."""
    refunded = F.coalesce(F.sum(F.when(is_refund, amount)).cast("double"), F.lit(0.0))
    moved = F.coalesce(F.sum(amount).cast("double"), F.lit(0.0))
    agg = stream.groupBy(_window(ts, period).alias("w"), entity).agg(
        F.count(F.lit(1)).alias("txns"), F.count_if(is_refund).alias("refunds"),
        refunded.alias("amt_refunded"), moved.alias("amt_total"))
    return agg.select(
        entity, F.col("w.start").alias("window_start"), "txns", "refunds",
        F.try_divide(F.col("refunds").cast("double"), F.col("txns").cast("double")).alias("refund_txn_ratio"),
        F.try_divide(F.col("amt_refunded"), F.col("amt_total")).alias("refund_amt_ratio"),
    )


def gaps_by_batch(stream: DataFrame, entity: str, event_id: str, ts: str = "ts", name: str = "gaps",
                  path: str | None = None) -> DataFrame:
    """Whole days since the entity's last event, over all data there is now.

    With ``path``, a folder of this job alone, a later call goes on where the last one ended.

    Each micro-batch is ordered like a table, so an entity with most of its rows is split over
    tasks. The last event per entity is a table in the shared folder, one version per batch; a
    batch that is run again overwrites its own version and its own output. A row older than the
    table is late: it is passed on with ``late`` set and no gap.
    """
    spark = stream.sparkSession
    root = path or scratch_path(spark, name)
    last_schema = stream.select(entity, F.col(ts).alias("_last")).schema
    out_schema = stream.select(
        entity, event_id, F.lit(0).cast("bigint").alias("days_since_last"), F.lit(False).alias("late")).schema

    def step(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        if epoch == 0:
            known = session.createDataFrame([], last_schema)
        else:
            known = session.read.schema(last_schema).parquet(f"{root}/last/{epoch - 1}")
        rows = batch.select(entity, event_id, ts).join(known, entity, "left")
        is_late = safe_flag(F.col(ts) < F.col("_last"))
        lagged = split_lag(rows.where(~is_late), [entity], [ts, event_id], F.to_date(ts), ts, "_before")
        gap = whole_days(F.col(ts), F.coalesce("_before", "_last"))
        fresh = lagged.select(entity, event_id, gap.alias("days_since_last"), F.lit(False).alias("late"))
        late = rows.where(is_late).select(
            entity, event_id, F.lit(None).cast("bigint").alias("days_since_last"), F.lit(True).alias("late"))
        fresh.unionByName(late).write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")
        newest = batch.groupBy(entity).agg(F.max(ts).alias("_last"))
        known.unionByName(newest).groupBy(entity).agg(F.max("_last").alias("_last")).write.mode(
            "overwrite").parquet(f"{root}/last/{epoch}")

    run_each_batch(stream, step, name, "append", root)
    return spark.read.schema(out_schema).parquet(f"{root}/out").select(*out_schema.names)


def stream_gaps(stream: DataFrame, entity: str, event_id: str, ts: str = "ts", idle: str = "400 days") -> DataFrame:
    """Whole days since the entity's last event, by one small state per entity.

    A row older than the state is late: it is passed on with ``late`` set and no gap. State of an
    entity that stays silent for ``idle`` beyond the watermark is dropped. The rows one entity has
    in one micro-batch are ordered in one task: bound them by ``files_per_trigger``, or use
    ``gaps_by_batch``.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, late = state.get if state.exists else (None, 0)
        # Arrow may hand over one entity's rows in several batches that overlap in time.
        rows = pd.concat(list(batches)).sort_values(["_us", event_id])
        behind = rows["_us"] < last if last is not None else pd.Series(False, rows.index)
        fresh, old = rows[~behind], rows[behind]
        before = fresh["_us"].shift().astype("Int64")
        if len(fresh):
            before.iloc[0] = pd.NA if last is None else last
            last = int(fresh["_us"].iloc[-1])
        late += len(old)
        out = pd.concat([
            pd.DataFrame({event_id: fresh[event_id], "late": False,
                          "days_since_last": (fresh["_us"].astype("Int64") - before) // MICROS_PER_DAY}),
            pd.DataFrame({event_id: old[event_id], "late": True,
                          "days_since_last": pd.Series(pd.NA, old.index, dtype="Int64")})])
        out.insert(0, entity, key[0])
        yield out[[entity, event_id, "days_since_last", "late"]]
        state.update((last, late))
        if state.getCurrentWatermarkMs() is not None and last is not None:
            state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + idle_ms)

    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"{entity} {types[entity]}, {event_id} {types[event_id]}, days_since_last bigint, late boolean"
    timed = stream.select(entity, event_id, ts, F.unix_micros(ts).alias("_us"))
    return timed.groupBy(entity).applyInPandasWithState(
        update, schema, "last_us bigint, late bigint", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run over all data there is now, into parquet, and read that back.

    ``path`` is a folder of this job alone, with its output and its checkpoint: a later call with the same one
    goes on where the last one ended. Without it a folder of its own in the shared folder is taken.
    """
    spark = stream.sparkSession
    root = path or scratch_path(spark, name)
    query = (
        stream.writeStream.outputMode(mode).format("parquet")
        .option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def run_each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], name: str, mode: str = "update",
                   path: str | None = None) -> None:
    """Run over all data there is now and hand every micro-batch to ``write``; ``path`` as in ``run_to_table``."""
    root = path or scratch_path(stream.sparkSession, name)
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state")
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    query.awaitTermination()
