"""Anomaly features over transactions.

Group statistics are aggregated with map-side combine and joined back; windows run only over
tables that hold one row per entity and calendar period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywise.functions.scalars import (
    calendar_day,
    half_even,
    probability_label,
    safe_flag,
    safe_ratio,
    week_start,
    whole_days,
)
from tallywise.operators.ordered import quantiles_of_counts, split_lag, value_counts
from tallywise.operators.summary import conditional_totals, flagged_share, mean_by, median_by, row_counts
from tallywise.session import cut_lineage

# Probability edges of the ratio bins and of the gap bins.
RATIO_PROBABILITIES = (0, 0.0001, 0.0005, 0.01, 0.05, 0.2, 0.5, 0.8, 0.95, 0.99, 0.9999, 0.99995, 1.0)
GAP_PROBABILITIES = (0, 0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 0.999, 0.9999, 1.0)


# ---------------------------------------------------------------- ratio to the peer group

def group_ratio(df: DataFrame, keys: Sequence[str], amount: str = "amount", stat: str = "mean",
                round_to: int | None = None) -> DataFrame:
    """Each row with the mean or median of its group and its ratio to it (0 where that is 0).

    Rows without a key stay, with NULL statistics. The statistics are stored first: their measured
    size then decides between a map-side join and a shuffle of the rows.
    """
    stats = cut_lineage((mean_by if stat == "mean" else median_by)(df, keys, amount, "group_stat"))
    out = df.join(stats, list(keys), "left")
    ratio = safe_ratio(F.col(amount), F.col("group_stat"))
    return out.withColumn("ratio", ratio if round_to is None else F.round(ratio, round_to))


# ---------------------------------------------------------------- quantile bins

def bin_edges(counts: DataFrame, probs: Sequence[float], duplicates: str = "raise",
              round_to: int | None = None) -> DataFrame:
    """One row, one array: the quantile edges of a table of counted values.

    Repeated edges are an error, or are merged with ``duplicates="drop"``.
    """
    q = F.col("quantiles")
    if round_to is not None:
        q = F.transform(q, lambda e: F.round(e, round_to))
    if duplicates == "drop":
        q = F.array_distinct(q)
    else:
        repeated = F.size(F.array_distinct(q)) < F.size(q)
        q = F.when(repeated, F.raise_error(F.lit("bin edges must be unique")).cast("array<double>")).otherwise(q)
    return quantiles_of_counts(counts, [], list(probs)).select(q.alias("edges"))


def assign_bins(df: DataFrame, value: str, edges: DataFrame, n_edges: int, name: str = "bin_id") -> DataFrame:
    """Right-closed bins 1..m, lowest value included; NULL values get no bin."""
    with_edges = df.withColumn("_e", edges.scalar())
    above = sum(
        F.when(safe_flag(F.col(value) > F.get("_e", F.lit(i))), 1).otherwise(0) for i in range(1, n_edges)
    )
    return with_edges.withColumn(name, F.when(F.col(value).isNotNull(), above + 1)).drop("_e")


def bin_table(edges: DataFrame) -> DataFrame:
    """One row per bin: id, low and high edge, and a label like ``(1, 3]``."""
    inner = F.posexplode(F.slice("edges", 2, F.greatest(F.size("edges") - 1, F.lit(0))))
    rows = edges.select("edges", inner.alias("pos", "hi"))
    return rows.select(
        (F.col("pos") + 1).alias("bin_id"), F.get("edges", F.col("pos")).alias("lo"), "hi",
    ).withColumn("label", F.format_string("(%s, %s]", F.col("lo").cast("string"), F.col("hi").cast("string")))


def probability_bins(spark, probs: Sequence[float]) -> DataFrame:
    """One row per bin: id, the two probabilities and their label."""
    rows = [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(probs, probs[1:]))]
    table = spark.createDataFrame(rows, "bin_id int, p_lo double, p_hi double")
    return table.withColumn("label", probability_label(F.col("p_lo"), F.col("p_hi")))


def quantile_bins(df: DataFrame, value: str, probs: Sequence[float] = RATIO_PROBABILITIES,
                  duplicates: str = "raise", round_to: int | None = None) -> DataFrame:
    """Rows with the id of their quantile bin; with ``round_to`` value and edges are compared rounded."""
    if round_to is not None:
        df = df.withColumn(value, F.round(value, round_to))
    edges = bin_edges(value_counts(df, [], value), probs, duplicates, round_to)
    return assign_bins(df, value, edges, len(probs))


def bin_stats(df: DataFrame, value: str, probs: Sequence[float] = RATIO_PROBABILITIES,
              duplicates: str = "raise", round_to: int | None = None) -> DataFrame:
    """Count, min and max per quantile bin. The input is read once, into counted values."""
    if round_to is not None:
        df = df.withColumn(value, F.round(value, round_to))
    counts = value_counts(df, [], value)
    edges = bin_edges(counts, probs, duplicates, round_to)
    return assign_bins(counts, "v", edges, len(probs)).groupBy("bin_id").agg(
        F.sum("c").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"))


def extremes(df: DataFrame, value: str, ties: Sequence[str], below: float = 0.0, above: float = 100.0,
             n: int = 5) -> DataFrame:
    """The ``n`` lowest rows under ``below`` and the ``n`` highest rows over ``above``."""
    order = [F.col(c).asc_nulls_last() for c in ties]
    low = df.where(F.col(value) < below).orderBy(F.col(value).asc(), *order).limit(n)
    high = df.where(F.col(value) > above).orderBy(F.col(value).desc(), *order).limit(n)
    return low.withColumn("side", F.lit("low")).unionByName(high.withColumn("side", F.lit("high")))


# ---------------------------------------------------------------- posting lag

def with_posting_lag(df: DataFrame, start: str = "txn_ts", end: str = "posted_ts") -> DataFrame:
    return df.withColumn("lag_days", whole_days(F.col(end), F.col(start)))


def lag_stats(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Count, min, mean (half-even, 2 places) and max of the amount per lag."""
    return df.dropna(subset=["lag_days"]).groupBy("lag_days").agg(
        F.count(amount).alias("transaction_count"),
        F.min(amount).cast("double").alias("min_amount"),
        half_even(F.try_divide(F.sum(amount).cast("double"), F.count(amount).cast("double")), 2).alias("mean_amount"),
        F.max(amount).cast("double").alias("max_amount"),
    )


# ---------------------------------------------------------------- change between periods

def period_totals(df: DataFrame, entity: Sequence[str], period: str = "ym", amount: str = "amount",
                  name: str = "monthly_spend") -> DataFrame:
    keys = [*entity, period]
    total = F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(38,2)")
    return df.dropna(subset=keys).groupBy(*keys).agg(total.cast("double").alias(name))


def period_change(df: DataFrame, entity: Sequence[str], period: str = "ym", amount: str = "amount") -> DataFrame:
    """Total per period without the zero ones, and its change in per cent to the one before it."""
    totals = period_totals(df, entity, period, amount).where(F.col("monthly_spend") != 0)
    before = F.lag("monthly_spend").over(Window.partitionBy(*entity).orderBy(period))
    return totals.withColumn(
        "pct_change", (F.try_divide(F.col("monthly_spend"), before) - 1) * 100)


def extreme_history(changes: DataFrame, entity: Sequence[str], n: int = 2, low: float = -100.0,
                    high: float = 1000.0, period: str = "ym") -> DataFrame:
    """All periods of the entities with the ``n`` lowest and the ``n`` highest changes.

    ``changes`` is read four times: store it first.
    """
    ties = [*entity, period]

    def side(rows: DataFrame, order, label: str) -> DataFrame:
        keys = rows.orderBy(order, *ties).limit(n).select(*entity)
        return changes.join(keys, list(entity), "left_semi").withColumn("side", F.lit(label))

    change = F.col("pct_change")
    lows = side(changes.where(change < low), change.asc(), "low")
    return lows.unionByName(side(changes.where(change > high), change.desc(), "high"))


def without_extreme(changes: DataFrame, entity: Sequence[str], limit: float = 1_000_000.0) -> DataFrame:
    """Leave out every entity that has a change beyond the limit on either side.

    ``changes`` is read twice: store it first.
    """
    beyond = changes.where((F.col("pct_change") < -limit) | (F.col("pct_change") > limit)).select(*entity)
    return changes.join(beyond, list(entity), "left_anti")


def beyond_change(changes: DataFrame, limit: float = 200_000.0) -> DataFrame:
    return changes.where((F.col("pct_change") > limit) | (F.col("pct_change") < -limit))


# ---------------------------------------------------------------- deviation from own history

def monthly_spike(df: DataFrame, entity: str = "vendor", period: str = "ym", amount: str = "amount",
                  min_periods: int = 3, sigmas: float = 7.0, min_total: float = 5000.0,
                  history: str = "transactions") -> DataFrame:
    """Monthly totals of entities with enough months, and whether a month is a spike.

    ``history="transactions"`` compares the total with mean and deviation of single amounts, as the
    original analysis does; ``history="totals"`` compares it with those of the monthly totals.
    """
    x = F.col(amount).cast("double")
    months = df.dropna(subset=[entity]).groupBy(entity, period).agg(
        F.coalesce(F.sum(amount).cast("double"), F.lit(0.0)).alias("monthly_tot"),
        F.count(x).alias("_n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("_avg"),
        F.coalesce(F.var_samp(x), F.lit(0.0)).alias("_var"),
    )
    own = Window.partitionBy(entity)
    if history == "transactions":
        # Mean and deviation of single amounts, put together from those of the months.
        n = F.sum("_n").over(own)
        within = (F.col("_n") - F.least(F.col("_n"), F.lit(1))) * F.col("_var")
        between = F.col("_n") * (F.col("_avg") - F.col("monthly_avg")) * (F.col("_avg") - F.col("monthly_avg"))
        rows = months.withColumn(
            "monthly_avg", F.try_divide(F.sum(F.col("_n") * F.col("_avg")).over(own), n.cast("double")),
        ).withColumn(
            "monthly_std", F.sqrt(F.try_divide(F.sum(within + between).over(own), F.when(n > 1, (n - 1).cast("double")))))
        rows = rows.withColumn("n_months", F.count(period).over(own)).where(F.col(period).isNotNull())
    else:
        rows = months.where(F.col(period).isNotNull()).withColumns({
            "n_months": F.count(F.lit(1)).over(own),
            "monthly_avg": F.avg("monthly_tot").over(own),
            "monthly_std": F.stddev_samp("monthly_tot").over(own),
        })
    far = F.abs(F.col("monthly_tot") - F.col("monthly_avg")) > sigmas * F.col("monthly_std")
    return rows.where(F.col("n_months") > min_periods).select(
        entity, period, "monthly_tot", "n_months", "monthly_avg", "monthly_std",
        safe_flag(far & (F.col("monthly_tot") > min_total)).alias("anomaly"))


def velocity(df: DataFrame, entity: Sequence[str], ts: str = "txn_ts", period: str = "day",
             sigmas: float = 4.0) -> DataFrame:
    """Rows per entity and day, week or hour, flagged above mean + ``sigmas`` deviations.

    One row per entity and period reaches the window, so its size is bound by the calendar.
    """
    cuts = {
        "day": calendar_day(F.col(ts)), "week": week_start(F.col(ts)),
        "hour": F.date_trunc("hour", F.col(ts)),
    }
    counts = row_counts(df.withColumn("period", cuts[period]), [*entity, "period"], "txns")
    return _above_own_mean(counts, entity, sigmas)


def _above_own_mean(counts: DataFrame, entity: Sequence[str], sigmas: float) -> DataFrame:
    own = Window.partitionBy(*entity)
    return counts.withColumns({
        "mean": F.avg("txns").over(own), "std": F.stddev_samp("txns").over(own),
    }).withColumn("anomaly", safe_flag(F.col("txns") > F.col("mean") + sigmas * F.col("std")))


def velocity_shares(df: DataFrame, entity: Sequence[str], ts: str = "txn_ts", sigmas: float = 4.0) -> DataFrame:
    """Share of entities with a flagged day, and of those with a flagged week.

    The rows are read once, into stored counts per day; weeks are added up from those.
    """
    daily = cut_lineage(row_counts(df.withColumn("period", calendar_day(F.col(ts))), [*entity, "period"], "txns"))
    weekly = daily.groupBy(*entity, week_start(F.col("period")).alias("period")).agg(F.sum("txns").alias("txns"))
    parts = [flagged_share(daily, entity, _above_own_mean(counts, entity, sigmas).where("anomaly")).withColumn("period", F.lit(name))
             for name, counts in (("day", daily), ("week", weekly))]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- refunds

def refund_patterns(df: DataFrame, keys: Sequence[str], amount: str = "amount", max_txn_ratio: float = 0.5,
                    max_amt_ratio: float = 0.5) -> DataFrame:
    totals = conditional_totals(df, keys, amount)
    refunded = F.abs("amt_refunded")
    return totals.withColumns({
        "refund_txn_ratio": F.try_divide(F.col("total_refunds").cast("double"), F.col("transaction_count").cast("double")),
        "refund_amt_ratio": F.try_divide(refunded, F.col("amt_purchased") + refunded),
    }).withColumns({
        "high_refund_rate": safe_flag(F.col("refund_txn_ratio") > max_txn_ratio),
        "large_refund_amt": safe_flag(F.col("refund_amt_ratio") > max_amt_ratio),
    })


def refund_anomalies(patterns: DataFrame, keys: Sequence[str], max_refunded: float = -300.0,
                     n: int | None = None, ascending: bool = False) -> DataFrame:
    """Flagged periods, nearest to the limit first (or the largest refunds with ``ascending``)."""
    hits = patterns.where(
        F.col("high_refund_rate") & F.col("large_refund_amt") & (F.col("amt_refunded") < max_refunded))
    if n is None:
        return hits
    lead = F.col("amt_refunded").asc() if ascending else F.col("amt_refunded").desc()
    return hits.orderBy(lead, *keys).limit(n)


# ---------------------------------------------------------------- time since the last event

def days_since_previous(df: DataFrame, entity: Sequence[str], ts: str, ties: Sequence[str]) -> DataFrame:
    """Every row with whole days since the entity's previous row, NULL for its first."""
    lagged = split_lag(df, entity, [ts, *ties], calendar_day(F.col(ts)), ts, "_before")
    return lagged.withColumn("days_since_last", whole_days(F.col(ts), F.col("_before"))).drop("_before")


def gap_counts(df: DataFrame, entity: Sequence[str], ts: str) -> DataFrame:
    """How often each gap in days occurs.

    Only (entity, time) counts are ordered: of rows at the same time all but one have gap 0.
    """
    moments = row_counts(df, [*entity, ts], "_n")
    gaps = split_lag(moments, entity, [ts], calendar_day(F.col(ts)), ts, "_before")
    first = gaps.select(whole_days(F.col(ts), F.col("_before")).alias("days"), F.lit(1).cast("bigint").alias("n"))
    repeats = gaps.where(F.col("_n") > 1).select(F.lit(0).cast("bigint").alias("days"), (F.col("_n") - 1).alias("n"))
    return first.where(F.col("days").isNotNull()).unionByName(repeats).groupBy("days").agg(F.sum("n").alias("n"))


def gap_bins(df: DataFrame, entity: Sequence[str], ts: str,
             probs: Sequence[float] = GAP_PROBABILITIES) -> DataFrame:
    """Quantile bins of the gaps with their counts, repeated edges merged, empty bins at 0."""
    counts = cut_lineage(gap_counts(df, entity, ts).select(F.col("days").cast("double").alias("v"), F.col("n").alias("c")))
    edges = cut_lineage(bin_edges(counts, probs, duplicates="drop"))
    hits = assign_bins(counts, "v", edges, len(probs)).groupBy("bin_id").agg(F.sum("c").alias("count"))
    return bin_table(edges).join(hits, "bin_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def long_gaps(df: DataFrame, entity: Sequence[str], ts: str, min_days: int = 240) -> DataFrame:
    """Largest gap of every entity that has one above ``min_days``."""
    moments = row_counts(df, [*entity, ts], "_n")
    gaps = split_lag(moments, entity, [ts], calendar_day(F.col(ts)), ts, "_before")
    days = whole_days(F.col(ts), F.col("_before"))
    return (
        gaps.withColumn("days_since_last", days).where(F.col("days_since_last") > min_days)
        .groupBy(*entity).agg(F.max("days_since_last").alias("days_since_last"))
    )
