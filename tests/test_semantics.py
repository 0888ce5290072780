"""Hand-made cases: missing values, zero denominators, ties, calendars; pandas as the measure."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywise.functions import scalars as S
from tallywise.operators import anomaly, risk, summary


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) or v is None else 'string' if isinstance(v, str) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("r")).first()["r"]


def test_scalars(spark):
    assert one(spark, S.safe_ratio(F.col("a"), F.col("b")), a=3.0, b=0.0) == 0.0
    assert one(spark, S.safe_ratio(F.col("a"), F.col("b")), a=3.0, b=None) is None
    assert one(spark, S.safe_flag(F.col("a") > 1), a=None) is False
    assert one(spark, S.to_number(F.col("a"), "int"), a=" 48 ") == 48
    assert one(spark, S.to_number(F.col("a")), a="-") is None
    assert one(spark, S.half_even(F.col("a"), 2), a=0.125) == 0.12
    assert one(spark, S.fill_unknown(F.col("a")), a=None) == "UNK"
    assert one(spark, S.month_from_yyyymm(F.col("a")), a=201307) == dt.date(2013, 7, 1)
    assert one(spark, S.parse_us_timestamp(F.col("a")), a="07/30/2013 12:00:00 AM") == dt.datetime(2013, 7, 30)
    assert one(spark, S.parse_us_timestamp(F.col("a")), a="bad") is None
    assert one(spark, S.hms_seconds(F.col("a")), a="00:14:36") == 876
    assert [one(spark, S.hms_seconds(F.col("a")), a=x) for x in ("0:14:36", "00-14-36", "aa:bb:cc")] == [None] * 3
    assert one(spark, S.number_label(F.col("a"), F.col("b")), a=7, b="X") == "7 – X"
    assert one(spark, S.parse_list_literal(F.col("a")), a="['x','y']") == ["x", "y"]
    shares = spark.range(1).select(*S.softmax([F.lit(1.0), F.lit(2.0), F.lit(3.0)])).first()
    np.testing.assert_allclose(shares, np.exp([1, 2, 3]) / np.exp([1, 2, 3]).sum())


def test_calendar(spark):
    rows = [("2024-01-01 23:00:00", "2024-01-02 01:00:00"), ("2024-01-02 01:00:00", "2024-01-01 23:00:00"),
            ("2024-01-07 12:00:00", "2024-01-10 12:00:00"), ("2024-01-08 00:00:00", "2024-01-08 00:00:00")]
    pdf = pd.DataFrame(rows, columns=["a", "b"]).apply(pd.to_datetime)
    out = spark.createDataFrame(pdf).select(
        S.whole_days(F.col("b"), F.col("a")).alias("d"), S.week_start(F.col("a")).alias("w")).collect()
    assert [r["d"] for r in out] == (pdf["b"] - pdf["a"]).dt.days.tolist()
    assert [r["w"] for r in out] == pdf["a"].dt.to_period("W").apply(lambda p: p.start_time.date()).tolist()


TXN = "entity string, ym date, amount decimal(18,2), mcc string"


def txn(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame(
        [(e, dt.date(2024, m, 1), None if a is None else Decimal(str(a)), c) for e, m, a, c in rows], TXN)


def test_ratio_keeps_rows_without_key(spark):
    df = txn(spark, [("a", 1, 10, "x"), ("a", 1, 30, "x"), ("a", 1, 5, None), ("z", 1, 5, "x"), ("z", 1, -5, "x"), ("a", 1, None, "x")])
    for stat in ("mean", "median"):
        rows = anomaly.group_ratio(df, ["entity", "mcc"], stat=stat).collect()
        got = sorted((r["entity"], str(r["mcc"]), str(r["amount"]), r["ratio"]) for r in rows)
        assert got == [("a", "None", "5.00", None), ("a", "x", "10.00", 0.5), ("a", "x", "30.00", 1.5),
                       ("a", "x", "None", None), ("z", "x", "-5.00", 0.0), ("z", "x", "5.00", 0.0)]


def test_month_on_month_skips_zero_months_and_keeps_sign(spark):
    df = txn(spark, [("a", 1, 10, "x"), ("a", 2, 5, "x"), ("a", 2, -5, "x"), ("a", 4, -20, "x"), ("a", 5, 10, "x"), ("b", 1, 1, "x")])
    rows = anomaly.period_change(df, ["entity"]).orderBy("entity", "ym").collect()
    pdf = pd.DataFrame({"e": ["a"] * 3 + ["b"], "x": [10.0, -20.0, 10.0, 1.0]})
    want = (pdf.groupby("e")["x"].pct_change() * 100).tolist()
    assert [r["pct_change"] for r in rows] == [None if np.isnan(w) else w for w in want]


def test_extreme_history_lists_an_entity_once(spark):
    df = txn(spark, [("a", 1, 1, "x"), ("a", 2, 100, "x"), ("a", 3, 1, "x"), ("a", 4, 200, "x"), ("b", 1, 5, "x"), ("b", 2, 5, "x")])
    out = anomaly.extreme_history(anomaly.period_change(df, ["entity"]), ["entity"])
    assert [(r["entity"], r["side"]) for r in out.collect()] == [("a", "high")] * 4


def test_refunds_with_empty_sides(spark):
    df = txn(spark, [("buy", 1, 5, "x"), ("back", 1, -400, "x"), ("zero", 1, 0, "x"), ("none", 1, None, "x")])
    rows = {r["entity"]: r for r in anomaly.refund_patterns(df, ["entity", "ym"]).collect()}
    assert (rows["buy"]["amt_refunded"], rows["buy"]["refund_amt_ratio"]) == (0.0, 0.0)
    assert rows["back"]["high_refund_rate"] and rows["back"]["large_refund_amt"]
    assert rows["zero"]["refund_amt_ratio"] is None and rows["zero"]["large_refund_amt"] is False
    assert rows["none"]["refund_txn_ratio"] is None and rows["none"]["high_refund_rate"] is False
    hits = anomaly.refund_anomalies(anomaly.refund_patterns(df, ["entity", "ym"]), ["entity"], n=20)
    assert [r["entity"] for r in hits.collect()] == ["back"]


def test_velocity_flags_one_spike_and_never_a_single_period(spark):
    days = [dt.datetime(2024, 1, d, h) for d in range(1, 32) for h in range(2 if d < 31 else 20)]
    df = spark.createDataFrame([("busy", d) for d in days] + [("once", days[0])], "e string, txn_ts timestamp")
    rows = anomaly.velocity(df, ["e"]).where("anomaly").collect()
    assert [(r["e"], r["period"], r["txns"]) for r in rows] == [("busy", dt.date(2024, 1, 31), 20)]
    share = summary.flagged_share(df, ["e"], anomaly.velocity(df, ["e"]).where("anomaly")).first()
    assert (share["n_total"], share["n_flagged"], share["pct_flagged"]) == (2, 1, 50.0)


def test_flagged_share_counts_null_as_one_key(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "k string")
    assert summary.flagged_share(df, ["k"], df.where("k = 'a'")).first()["n_total"] == 2


@pytest.mark.parametrize("history", ["transactions", "totals"])
def test_monthly_spike_against_pandas(spark, history):
    rng = np.random.default_rng(2)
    rows = [(f"v{v}", m, round(float(x), 2), "x") for v in range(6) for m in range(1, 3 + v) for x in rng.normal(2000, 300, 5)]
    rows += [("v5", 7, 90_000.0, "x")]
    pdf = pd.DataFrame(rows, columns=["vendor", "ym", "amount", "mcc"])
    tot = pdf.groupby(["vendor", "ym"])["amount"].sum().reset_index(name="tot")
    base = pdf.groupby("vendor")["amount"] if history == "transactions" else tot.groupby("vendor")["tot"]
    stats = base.agg(["mean", "std"]).reset_index()
    n = tot.groupby("vendor")["ym"].nunique().reset_index(name="n")
    want = tot.merge(n[n["n"] > 3]).merge(stats).sort_values(["vendor", "ym"])
    got = anomaly.monthly_spike(txn(spark, rows).withColumnRenamed("entity", "vendor"), sigmas=2.0, history=history)
    got = got.toPandas().sort_values(["vendor", "ym"])
    np.testing.assert_allclose(got["monthly_avg"], want["mean"], rtol=1e-9)
    np.testing.assert_allclose(got["monthly_std"], want["std"], rtol=1e-9)
    flags = ((want["tot"] - want["mean"]).abs() > 2 * want["std"]) & (want["tot"] > 5000)
    assert got["anomaly"].tolist() == flags.tolist() and flags.any()


def test_quantile_bins_match_qcut(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.lognormal(0, 2, 2001)})
    got = anomaly.quantile_bins(spark.createDataFrame(pdf), "x").toPandas().sort_values("x")["bin_id"]
    want = pd.qcut(pdf["x"], list(anomaly.RATIO_PROBABILITIES), labels=False).loc[pdf["x"].sort_values().index] + 1
    assert got.tolist() == want.tolist()


def test_repeated_edges_raise_or_merge(spark):
    pdf = pd.DataFrame({"x": [0.0] * 50 + [float(i) for i in range(1, 51)]})
    df = spark.createDataFrame(pdf)
    with pytest.raises(Exception, match="bin edges must be unique"):
        anomaly.quantile_bins(df, "x", anomaly.GAP_PROBABILITIES).collect()
    got = anomaly.quantile_bins(df, "x", anomaly.GAP_PROBABILITIES, "drop").toPandas()["bin_id"].value_counts().sort_index()
    want = pd.qcut(pdf["x"], list(anomaly.GAP_PROBABILITIES), duplicates="drop").value_counts().sort_index()
    assert got.tolist() == want[want > 0].tolist()


def test_gaps_with_equal_times(spark):
    days = [0, 0, 0, 1, 5, 5, 300]
    rows = [("a", dt.datetime(2023, 1, 1) + dt.timedelta(days=d)) for d in days] + [("b", dt.datetime(2023, 1, 1))]
    df = spark.createDataFrame(rows, "e string, ts timestamp")
    counts = {r["days"]: r["n"] for r in anomaly.gap_counts(df, ["e"], "ts").collect()}
    want = pd.Series(days).diff().dropna().astype(int).value_counts().to_dict()
    assert counts == want
    assert [tuple(r) for r in anomaly.long_gaps(df, ["e"], "ts").collect()] == [("a", 295)]
    assert sum(r["count"] for r in anomaly.gap_bins(df, ["e"], "ts").collect()) == 6


def test_boxplot_and_description_against_pandas(spark):
    rng = np.random.default_rng(9)
    x = np.append(rng.normal(0, 1, 400), [50.0, -40.0])
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x}))
    box = summary.boxplot(df, "k", "x").first()
    q1, q3 = np.quantile(x, [0.25, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert box["count"] == 402 and box["num_outliers"] == ((x < lo) | (x > hi)).sum() >= 2
    np.testing.assert_allclose([box["lower_bound"], box["upper_bound"]], [lo, hi])
    np.testing.assert_allclose(list(summary.describe(df, "x").first()), pd.Series(x).describe()[["count", "mean", "std", "min", "25%", "50%", "75%", "max"]])
    assert summary.describe(df.where("false"), "x").first()["count"] == 0


def test_profile_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "n int, s string")
    rows = {r["column"]: r for r in summary.profile_columns(df).collect()}
    assert (rows["s"]["null_count"], rows["s"]["unique_count"], rows["n"]["unique_count"]) == (1, 2, 2)
    assert sorted(rows["s"]["sample_values"].split("|")) == ["a", "b"]


# ---------------------------------------------------------------- credit risk

def test_woe_once_seen_unseen_and_missing(spark):
    train = spark.createDataFrame([("a", 1), ("a", 0), ("a", 0), ("b", 1), (None, 1), (None, 0)], "c string, y int")
    test = spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "c string")
    got = {r["c"]: r["w"] for r in test.withColumnRenamed("c", "k").withColumn("c", F.col("k")).transform(
        lambda d: risk.woe_encode(train, d, ["c"], "y", "_w")).select(F.col("k").alias("c"), F.col("c_w").alias("w")).collect()}
    woe = lambda p, n: np.log(((p + 1) / (3 + 2)) / ((n - p + 1) / (3 + 2)))
    assert got["b"] == 0.0 and got["new"] == 0.0
    assert got["a"] == pytest.approx(woe(1, 3)) and got[None] == pytest.approx(woe(1, 2))


@pytest.mark.parametrize("positives, rate, profit", [
    (28, 0.04, -99_200), (28, 0.08, 81_600), (28, 0.10, 172_000), (28, 0.12, 262_400),
    (54, 0.08, -199_200), (54, 0.12, -28_800), (177, 0.10, -1_467_000), (131, 0.10, -961_000), (126, 0.10, -906_000),
])
def test_published_profits(spark, positives, rate, profit):
    df = spark.range(480).select(F.lit(0).alias("decile"), (F.col("id") < positives).cast("int").alias("actual"))
    assert risk.gains_table(df, "actual", rate=rate).first()["profit"] == pytest.approx(profit)
    row = risk.profit_sensitivity(df, "actual", rates=[rate]).first()
    assert row["profit"] == pytest.approx(profit) and row["profitable_sum"] == pytest.approx(max(profit, 0))


def test_gains_properties(spark):
    df = spark.range(4800).select(F.col("id"), (F.hash("id") % 5 == 0).cast("int").alias("y"), F.rand(1).alias("p"))
    rows = risk.gains_table(risk.with_decile(df, "p", "id"), "y").orderBy("decile").collect()
    assert [r["count"] for r in rows] == [480] * 10 and rows[-1]["lift"] == 1.0
    assert all(0 <= r["ks"] <= 100 for r in rows) and rows[-1]["percent_cum_actual"] == 1.0


def test_auc_and_curve(spark):
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 800), rng.integers(0, 50, 800) / 50
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert risk.auc_exact(df, "y", "s").first()["auc"] == pytest.approx(want, abs=1e-12)
    top = risk.roc_points(df, "y", "s").orderBy("threshold").first()
    assert (top["fpr"], top["tpr"]) == (1.0, 1.0)


def test_split_is_repeatable(spark):
    df = spark.range(5000)
    a = risk.hash_split(df, ["id"]).where("is_train")
    assert a.count() == risk.hash_split(df.repartition(5), ["id"]).where("is_train").intersect(a).count()
    assert 0.66 < a.count() / 5000 < 0.74


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 8 + [(1,)] * 2, "y int")
    rows = {r["y"]: r for r in risk.class_weights(df, "y").collect()}
    assert rows[0]["balanced_weight"] == 10 / 16 and rows[1]["balanced_weight"] == 2.5 and rows[1]["scale_pos_weight"] == 4.0
    assert {r["weight"] for r in risk.with_class_weight(df, "y").collect()} == {0.625, 2.5}
