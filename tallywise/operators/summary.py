"""Summaries: totals, counts, box-plot figures, descriptions, profiles, shares, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallywise.functions.scalars import exact_mean, half_even, safe_flag
from tallywise.operators.ordered import exact_quantiles, quantiles_of_counts, value_counts
from tallywise.session import cut_lineage


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in a stated order."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """One row: the row count, the column count and the column names."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"),
    )


def total_by(df: DataFrame, keys: Sequence[str], amount: str = "amount", name: str = "total") -> DataFrame:
    """Sum per key; rows without a key are left out, an empty sum is 0."""
    total = F.coalesce(F.sum(amount).cast("double"), F.lit(0.0))
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(total.alias(name))


def monthly_summary(df: DataFrame, month: str = "ym", amount: str = "amount") -> DataFrame:
    return df.dropna(subset=[month]).groupBy(month).agg(
        F.coalesce(F.sum(amount).cast("double"), F.lit(0.0)).alias("total_amount"),
        F.count(amount).alias("transaction_count"),
    )


def row_counts(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def mean_by(df: DataFrame, keys: Sequence[str], amount: str = "amount", name: str = "mean") -> DataFrame:
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(exact_mean(F.col(amount)).alias(name))


def median_by(df: DataFrame, keys: Sequence[str], amount: str = "amount", name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, amount, [0.5]).select(*keys, F.get("quantiles", F.lit(0)).alias(name))


def distinct_per_key(df: DataFrame, key: str, value: str, name: str = "n_distinct") -> DataFrame:
    return df.dropna(subset=[key]).groupBy(key).agg(F.count_distinct(value).alias(name))


def top_n(df: DataFrame, by: str, n: int, ties: Sequence[str], ascending: bool = False) -> DataFrame:
    """First ``n`` rows by one column, missing values last, ties in the order of other columns."""
    lead = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(lead, *[F.col(c).asc_nulls_last() for c in ties]).limit(n)


def groups_at_zero(stats: DataFrame, stat: str) -> DataFrame:
    """How many groups have a statistic of exactly 0."""
    return stats.where(F.col(stat) == 0).agg(F.count(F.lit(1)).alias("n_groups"))


# Names of the box-plot figures, in report order.
BOXPLOT_STATS = (
    "01.count", "02.min", "03.Q1", "04.median", "05.Q3", "06.max", "07.IQR",
    "08.lower_bound", "09.upper_bound", "10.num_outliers",
)


def boxplot(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: count, min, quartiles, max, IQR, fences and the number of values outside them.

    The input is read once; quartiles and outliers both come from the counted values.
    """
    counts = value_counts(df, [key], value)
    q = quantiles_of_counts(counts, [key], [0.25, 0.5, 0.75]).select(
        key, *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    # Stored, so that its measured size chooses the join.
    bounds = cut_lineage(
        q.withColumn("iqr", F.col("q3") - F.col("q1"))
        .withColumn("lower_bound", F.col("q1") - 1.5 * F.col("iqr"))
        .withColumn("upper_bound", F.col("q3") + 1.5 * F.col("iqr"))
    )
    outside = (F.col("v") < F.col("lower_bound")) | (F.col("v") > F.col("upper_bound"))
    return counts.join(bounds, key).groupBy(key).agg(
        F.sum("c").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"),
        *[F.max(c).alias(c) for c in bounds.columns if c != key],
        F.coalesce(F.sum(F.when(outside, F.col("c"))), F.lit(0)).alias("num_outliers"),
    ).select(
        key, "count", "min", "q1", "median", "q3", "max", "iqr", "lower_bound", "upper_bound",
        "num_outliers",
    )


def boxplot_long(box: DataFrame, key: str) -> DataFrame:
    """One row per key and figure."""
    cols = [c for c in box.columns if c != key]
    pairs = F.array(*[
        F.struct(F.lit(label).alias("stat"), F.col(c).cast("double").alias("value"))
        for label, c in zip(BOXPLOT_STATS, cols)
    ])
    return box.select(key, F.explode(pairs).alias("p")).select(key, "p.stat", "p.value")


def _known(label: Column, months: Sequence[str]) -> Column:
    unknown = F.raise_error(F.concat(F.lit("month not in the list: "), label)).cast("string")
    return F.when(label.isNull() | label.isin(*months), label).otherwise(unknown)


def boxplot_matrix(box: DataFrame, month: str, months: Sequence[str]) -> DataFrame:
    """Figures as rows, months (``yyyy-MM``) as columns, rounded half-even to 2 places.

    A month of the table that is not in ``months`` stops the query.
    """
    # The inner rounding keeps the noise of interpolation from deciding ties.
    long = boxplot_long(box, month).select(
        _known(F.date_format(month, "yyyy-MM"), months).alias("ym_label"), "stat", half_even(F.round("value", 6), 2).alias("value"))
    return long.groupBy("stat").pivot("ym_label", list(months)).agg(F.first("value", ignorenulls=True))


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max of the values that are present."""
    counts = value_counts(df, [], value)
    c, v = F.col("c"), F.col("v")
    # No values leave no quantile row: max() keeps the one line of output.
    q = quantiles_of_counts(counts, [], [0.25, 0.5, 0.75]).agg(F.max("quantiles").alias("q")).scalar()
    n = F.coalesce(F.sum(c), F.lit(0))
    mean = counts.agg(F.try_divide(F.sum(v * c), F.sum(c).cast("double")).alias("m")).scalar()
    spread = F.sum(c * (v - F.col("_m")) * (v - F.col("_m")))
    return counts.withColumn("_m", mean).agg(
        n.alias("count"), F.max("_m").alias("mean"),
        F.sqrt(F.try_divide(spread, F.when(n > 1, (n - 1).cast("double")))).alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    ).withColumn("_q", q).select(
        "count", "mean", "std", "min",
        *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(("q25", "q50", "q75"))],
        "max",
    )


def conditional_totals(df: DataFrame, keys: Sequence[str], amount: str = "amount") -> DataFrame:
    """Numbers and sums of positive and of negative amounts, and the count of amounts."""
    x = F.col(amount)
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.count_if(x > 0).alias("total_purchases"),
        F.count_if(x < 0).alias("total_refunds"),
        F.coalesce(F.sum(F.when(x > 0, x)).cast("double"), F.lit(0.0)).alias("amt_purchased"),
        F.coalesce(F.sum(F.when(x < 0, x)).cast("double"), F.lit(0.0)).alias("amt_refunded"),
        F.count(x).alias("transaction_count"),
    )


def flagged_shares(df: DataFrame, keys: Sequence[str], rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Per rule: distinct keys of ``df``, distinct keys with a row that meets the rule, and the share in per cent.

    A NULL key counts as one key. Both inputs are read once and leave the map side one row per key.
    """
    keys = list(keys)
    flags = [f"_f{i}" for i in range(len(rules))]
    everyone = df.select(*keys, F.lit(1).alias("_in"), *[F.lit(0).alias(f) for f in flags])
    hits = rows.select(
        *keys, F.lit(0).alias("_in"), *[safe_flag(c).cast("int").alias(f) for f, c in zip(flags, rules.values())])
    per_key = everyone.unionByName(hits).groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("_in", *flags)])
    sums = per_key.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_in", *flags)])
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f).alias("n_flagged")) for f, r in zip(flags, rules)])
    return sums.select(F.col("_in").alias("n_total"), F.explode(pairs).alias("p")).select(
        "n_total", "p.n_flagged", "p.rule").withColumn(
        "pct_flagged", F.try_divide(F.col("n_flagged").cast("double"), F.col("n_total").cast("double")) * 100)


def flagged_share(df: DataFrame, keys: Sequence[str], flagged: DataFrame) -> DataFrame:
    """Distinct keys, distinct keys among the flagged rows, and their share in per cent."""
    return flagged_shares(df, keys, flagged, {"flagged": F.lit(True)}).drop("rule")


def class_share(df: DataFrame, label: str) -> DataFrame:
    """Rows per class and their share in per cent, rounded half-even to 2 places."""
    counts = row_counts(df, [label], "counts")
    total = counts.agg(F.sum("counts").cast("double").alias("t")).scalar()
    return counts.withColumn("_t", total).select(
        label, "counts", half_even(F.col("counts") / F.col("_t") * 100, 2).alias("perc"))


def profile_columns(df: DataFrame, samples: int = 10, seed: int = 42) -> DataFrame:
    """One row per column: type, missing values, distinct values and a few sampled values.

    The table is read once. Rows become (column, value) counts on the map side, so neither a
    frequent value nor a wide table puts one column into one task.
    """
    pairs = F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f.name).cast("string").alias("v"))
        for i, f in enumerate(df.schema.fields)
    ])
    values = (
        df.select(F.explode(pairs).alias("p")).groupBy("p.i", "p.v").agg(F.count(F.lit(1)).alias("n"))
    )
    counts = values.groupBy("i").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("v").alias("unique_count"),
    )
    # Ranking keeps the first rows of each task before the exchange.
    order = Window.partitionBy("i").orderBy("h", "v")
    picked = (
        values.where(F.col("v").isNotNull()).withColumn("h", F.xxhash64("v", F.lit(seed)))
        .withColumn("at", F.row_number().over(order)).where(F.col("at") <= samples)
        .groupBy("i").agg(F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]), "|",
        ).alias("sample_values"))
    )
    names = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "i int, column string, dtype string",
    )
    return (
        names.join(counts, "i", "left").join(picked, "i", "left")
        .select("column", "dtype", F.coalesce("null_count", F.lit(0)).alias("null_count"),
                F.coalesce("unique_count", F.lit(0)).alias("unique_count"), "sample_values")
    )


def null_rates(df: DataFrame, columns: Sequence[str], name: str = "null_rate") -> DataFrame:
    """Per cent of missing values per column, rounded half-even to 2 places; one pass."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), half_even(F.col(c) * 100, 2).alias(name)) for c in columns
    ])
    return rates.select(F.explode(pairs).alias("p")).select("p.*")


def empty_bins(bins: DataFrame, counts: DataFrame, on: str, count: str = "count") -> DataFrame:
    """Frequency table with the bins nothing fell into, at 0."""
    return bins.join(counts, on, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def mean_interval(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Mean per key with a normal 95 % interval."""
    aggs: list[Column] = []
    for c in columns:
        half = 1.96 * F.try_divide(F.stddev_samp(c), F.sqrt(F.count(c).cast("double")))
        aggs += [F.avg(c).alias(c), (F.avg(c) - half).alias(f"{c}_low"), (F.avg(c) + half).alias(f"{c}_high")]
    return df.dropna(subset=[key]).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *aggs)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
