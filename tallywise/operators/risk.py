"""Credit-risk tables: imputation, Weight of Evidence, class weights, metrics, curves, gains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywise.functions.scalars import fill_unknown, half_even
from tallywise.operators.ordered import rank_cuts, rank_part, running_totals, sortable
from tallywise.session import cut_lineage


def hash_split(df: DataFrame, ids: Sequence[str], train: float = 0.7, seed: int = 0,
               digest: str = "xxhash64", name: str = "is_train") -> DataFrame:
    """A repeatable split: the same row falls on the same side in every run and on any cluster.

    ``digest="md5"`` gives a split other engines can repeat; ``xxhash64`` is cheaper.
    """
    if digest == "md5":
        text = F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed)))
        draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 1000
    else:
        draw = F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(1000))
    return df.withColumn(name, draw < int(round(train * 1000)))


def impute_mean(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing numbers replaced by the mean of the training rows; one row of means for all columns."""
    means = train.agg(*[F.avg(c).alias(c) for c in columns]).select(F.struct(*columns).alias("m")).scalar()
    filled = df.withColumn("_m", means)
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m.{c}")) for c in columns}).drop("_m")


def null_rate_report(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing rates per column before and after imputation, for both sides of the split.

    One aggregate of each side: a column with a training mean has no missing value after imputation, one
    without keeps its rate.
    """
    def rates(side: DataFrame, name: str) -> DataFrame:
        return side.agg(F.struct(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).alias(name))

    def percent(side: str, c: str, after: bool = False) -> Column:
        rate = half_even(F.col(f"{side}.{c}") * 100, 2)
        return F.when(F.col(f"train.{c}") < 1, F.when(rate.isNotNull(), F.lit(0.0))).otherwise(rate) if after else rate

    # Both sides are one row.
    both = rates(train, "train").join(F.broadcast(rates(test, "test")))
    lines = F.array(*[F.struct(
        F.lit(c).alias("column"), percent("train", c).alias("train_before"),
        percent("train", c, True).alias("train_after"), percent("test", c).alias("test_before"),
        percent("test", c, True).alias("test_after")) for c in columns])
    return both.select(F.explode(lines).alias("l")).select("l.*").orderBy(F.col("train_before").desc(), "column")


def fill_categories(df: DataFrame, columns: Sequence[str], marker: str = "UNK") -> DataFrame:
    return df.withColumns({c: fill_unknown(F.col(c), marker) for c in columns})


def woe_table(train: DataFrame, columns: Sequence[str], label: str, smoothing: float = 1.0) -> DataFrame:
    """Weight of Evidence per column and category, all columns in one pass.

    ``ln(((pos + r) / (POS + 2r)) / ((neg + r) / (NEG + 2r)))``; 0 for a category seen once.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("category")) for c in columns])
    y = F.col(label).cast("bigint")
    per_category = (
        train.select(F.explode(pairs).alias("p"), y.alias("y")).groupBy("p.column", "p.category")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    )
    totals = train.agg(F.struct(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n")).alias("t")).scalar()
    r = F.lit(float(smoothing))
    pos_share = (F.col("pos") + r) / (F.col("t.pos") + 2 * r)
    neg_share = (F.col("n") - F.col("pos") + r) / (F.col("t.n") - F.col("t.pos") + 2 * r)
    return per_category.withColumn("t", totals).select(
        "column", "category", "n", "pos",
        F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.log(pos_share / neg_share)).alias("woe"),
    )


def woe_apply(df: DataFrame, woe: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Categories replaced by their weight; 0 for a category the training rows did not have.

    One equi-join per column: Spark broadcasts the weights when their measured size is small and
    splits a hot category when it is not.
    """
    out = df
    for c in columns:
        weights = woe.where(F.col("column") == c).select(F.col("category").alias(c), F.col("woe").alias("_w"))
        out = out.join(weights, c, "left").withColumn(f"{c}{suffix}", F.coalesce("_w", F.lit(0.0))).drop("_w")
    return out


def woe_encode(train: DataFrame, df: DataFrame, columns: Sequence[str], label: str, suffix: str = "") -> DataFrame:
    """Fit on the training rows and apply: missing categories become ``UNK`` on both sides.

    The fitted weights (one row per category) are stored once, so that the joins do not refit them.
    """
    weights = cut_lineage(woe_table(fill_categories(train, columns), columns, label))
    return woe_apply(fill_categories(df, columns), weights, columns, suffix)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, balanced weight ``n / (classes * n_c)`` and the positive weight ``neg / pos``."""
    counts = df.dropna(subset=[label]).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(
        F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.when(F.col(label) == 0, F.col("n"))).cast("double").alias("neg"),
        F.sum(F.when(F.col(label) == 1, F.col("n"))).cast("double").alias("pos"),
    ).alias("t")).scalar()
    return counts.withColumn("t", totals).select(
        label, "n", (F.col("t.n") / (F.col("t.k") * F.col("n"))).alias("balanced_weight"),
        F.try_divide(F.col("t.neg"), F.col("t.pos")).alias("scale_pos_weight"),
    )


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Each row with the balanced weight of its class; the classes are two, so their map is one row."""
    weights = class_weights(df, label).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(label), "balanced_weight"))).alias("m")).scalar()
    return df.withColumn("_m", weights).withColumn(name, F.col("_m")[F.col(label)]).drop("_m")


def confusion_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 in one aggregate; undefined ones are 0."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    counts = df.agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"),
        F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    or_zero = lambda x: F.coalesce(x, F.lit(0.0))
    return counts.select(
        "tp", "fp", "fn", "tn",
        or_zero(F.try_divide(tp + tn, tp + fp + fn + tn)).alias("accuracy"),
        or_zero(F.try_divide(tp, tp + fp)).alias("precision"),
        or_zero(F.try_divide(tp, tp + fn)).alias("recall"),
        or_zero(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def _score_totals(df: DataFrame, actual: str, score: str) -> DataFrame:
    one = F.when(F.col(actual) == 1, 1).otherwise(0)
    return running_totals(df, score, {"pos": one, "neg": 1 - one}, descending=True)


def roc_points(df: DataFrame, actual: str, score: str) -> DataFrame:
    """False and true positive rate at each distinct score taken as threshold."""
    t = _score_totals(df, actual, score)
    return t.select(
        F.col(score).alias("threshold"), F.col("cum_neg").alias("fp"), F.col("cum_pos").alias("tp"),
        F.try_divide(F.col("cum_neg").cast("double"), F.col("total_neg").cast("double")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("total_pos").cast("double")).alias("tpr"),
    )


def pr_points(df: DataFrame, actual: str, score: str) -> DataFrame:
    """Precision and recall at each distinct score taken as threshold."""
    t = _score_totals(df, actual, score)
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    return t.select(
        F.col(score).alias("threshold"), F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, F.col("total_pos").cast("double")).alias("recall"),
    )


def auc_exact(df: DataFrame, actual: str, score: str) -> DataFrame:
    """Area under the ROC curve; equal scores count half. Sums of whole numbers, so exact."""
    t = _score_totals(df, actual, score)
    # Twice the number of (positive, negative) pairs in the right order, ties counted once.
    twice = F.col("neg").cast("decimal(19,0)") * (2 * F.col("cum_pos") - F.col("pos")).cast("decimal(19,0)")
    pairs = F.max("total_pos").cast("double") * F.max("total_neg").cast("double")
    return t.agg(F.try_divide(F.sum(twice).cast("double") / 2, pairs).alias("auc"))


# ---------------------------------------------------------------- gains and profit

def with_decile(df: DataFrame, score: str, tie: str, parts: int = 10, name: str = "decile") -> DataFrame:
    """Decile by descending score: ``floor(row / (n / parts))`` for rows in that order.

    A NULL score ranks last, with minus infinity. Equal scores are in order of ``tie``: numbers, dates and
    times by value, other types by a hash and then by value, NULL first.
    """
    ranked = df.withColumns({
        "_score": F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))),
        "_tie": sortable(F.col(tie), df.schema[tie].dataType)})
    cuts = rank_cuts(ranked, "_score", "_tie", parts)
    return ranked.withColumn(name, rank_part(F.col("_score"), F.col("_tie"), cuts)).drop("_score", "_tie")


def gains_table(df: DataFrame, actual: str, decile: str = "decile", loan: float = 10_000.0,
                rate: float = 0.10, rounded_ks: bool = True) -> DataFrame:
    """Gains, lift, K-S and profit per decile. Only the ten decile rows meet a window.

    K-S comes from the rounded shares, as in the original report; ``rounded_ks=False`` uses exact ones.
    """
    per = df.groupBy(decile).agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.col(actual).cast("bigint")).alias("actual"))
    per = per.withColumn("non_actual", F.col("count") - F.col("actual"))
    so_far = Window.orderBy(decile).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = Window.partitionBy()
    cum = per.withColumns({
        "cum_count": F.sum("count").over(so_far),
        "cum_actual": F.sum("actual").over(so_far),
        "cum_non_actual": F.sum("non_actual").over(so_far),
        "if_random": F.sum("actual").over(all_rows) / F.lit(10.0) * F.row_number().over(Window.orderBy(decile)),
        "_pa": F.sum("actual").over(all_rows).cast("double"),
        "_pn": F.sum("non_actual").over(all_rows).cast("double"),
    })
    share_a = F.try_divide(F.col("cum_actual").cast("double"), F.col("_pa"))
    share_n = F.try_divide(F.col("cum_non_actual").cast("double"), F.col("_pn"))
    ks_a, ks_n = (half_even(share_a, 2), half_even(share_n, 2)) if rounded_ks else (share_a, share_n)
    return cum.select(
        decile, "count", "actual", "non_actual", "cum_count", "cum_actual", "cum_non_actual",
        half_even(share_a, 2).alias("percent_cum_actual"), half_even(share_n, 2).alias("percent_cum_non_actual"),
        "if_random",
        half_even(F.try_divide(F.col("cum_actual").cast("double"), F.col("if_random")), 2).alias("lift"),
        (F.abs(ks_a - ks_n) * 100).alias("ks"),
        half_even(F.col("cum_actual") / F.col("cum_count") * 100, 2).alias("gain"),
        (F.lit(loan) * rate * F.col("non_actual")).alias("revenue"),
        (F.lit(loan) * F.col("actual")).alias("cost"),
        (F.lit(loan) * rate * F.col("non_actual") - F.lit(loan) * F.col("actual")).alias("profit"),
    )


def profit_sensitivity(df: DataFrame, actual: str, decile: str = "decile", loan: float = 10_000.0,
                       rates: Sequence[float] = (0.04, 0.08, 0.12)) -> DataFrame:
    """Profit per decile under each rate, beside the sum over the profitable deciles."""
    per = df.groupBy(decile).agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.col(actual).cast("bigint")).alias("actual"))

    def profit(rate: Column) -> Column:
        return F.lit(loan) * rate * (F.col("count") - F.col("actual")) - F.lit(loan) * F.col("actual")

    by_rate = per.select(decile, "count", "actual", F.explode(F.array(*[F.lit(float(r)) for r in rates])).alias("rate"))
    rows = by_rate.withColumn("profit", profit(F.col("rate")))
    gain = F.coalesce(F.sum(F.when(F.col("profit") > 0, F.col("profit"))).over(Window.partitionBy("rate")), F.lit(0.0))
    return rows.withColumn("profitable_sum", gain)


