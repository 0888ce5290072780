"""Order-dependent building blocks against numpy and brute force, hot groups included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywise.operators import ordered
from tallywise.operators.risk import with_decile

PROBS = [0.0, 0.001, 0.25, 0.5, 0.77, 0.999, 1.0]


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    hot = pd.DataFrame({"k": "hot", "x": np.round(rng.normal(100, 40, 4000), 2)})
    equal = pd.DataFrame({"k": "equal", "x": np.full(500, 3.5)})
    few = pd.DataFrame({"k": [f"k{i % 7}" for i in range(90)], "x": rng.exponential(10, 90)})
    return pd.concat([hot, equal, few, pd.DataFrame({"k": ["one"], "x": [1.25]})], ignore_index=True)


@pytest.mark.parametrize("small_group", [0, 50, 1_000_000])
def test_quantiles_per_key(spark, skewed, small_group):
    counts = ordered.value_counts(spark.createDataFrame(skewed), ["k"], "x")
    got = {r["k"]: (r["n"], r["quantiles"]) for r in
           ordered.quantiles_of_counts(counts, ["k"], PROBS, small_group=small_group).collect()}
    for key, part in skewed.groupby("k")["x"]:
        assert got[key][0] == len(part)
        np.testing.assert_allclose(got[key][1], part.quantile(PROBS).to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("small_group", [0, 1_000_000])
def test_quantiles_of_a_whole_column(spark, skewed, small_group):
    counts = ordered.value_counts(spark.createDataFrame(skewed), [], "x")
    row = ordered.quantiles_of_counts(counts, [], PROBS, small_group=small_group).first()
    np.testing.assert_allclose(row["quantiles"], skewed["x"].quantile(PROBS).to_numpy(), rtol=1e-12)


def test_quantiles_leave_out_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 5.0), ("b", None)], "k string, x double")
    rows = ordered.exact_quantiles(df, ["k"], "x", [0.5]).collect()
    assert [(r["k"], r["n"], r["quantiles"]) for r in rows] == [("a", 1, [1.0])]
    assert ordered.exact_quantiles(df.where("false"), [], "x", [0.5]).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"s": rng.integers(0, 300, 3000) / 7.0, "y": rng.integers(0, 2, 3000)})
    got = ordered.running_totals(
        spark.createDataFrame(pdf), "s", {"n": F.lit(1), "y": F.col("y")}, descending, buckets=16).toPandas()
    want = pdf.groupby("s").agg(n=("y", "size"), y=("y", "sum")).sort_index(ascending=not descending).cumsum()
    got = got.set_index("s").loc[want.index]
    assert (got["cum_n"] == want["n"]).all() and (got["cum_y"] == want["y"]).all()
    assert set(got["total_n"]) == {3000}


def test_previous_row_over_buckets(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"e": ["hot"] * 900 + [f"e{i % 5}" for i in range(100)],
                        "t": rng.integers(0, 400, 1000), "i": np.arange(1000)})
    out = ordered.split_lag(spark.createDataFrame(pdf), ["e"], ["t", "i"], F.floor(F.col("t") / 10), "t", "p", "pos").toPandas()
    want = pdf.sort_values(["e", "t", "i"])
    want["p"] = want.groupby("e")["t"].shift()
    want["pos"] = want.groupby("e").cumcount() + 1
    got = out.set_index("i").loc[want["i"]]
    assert got["p"].fillna(-1).tolist() == want["p"].fillna(-1).tolist()
    assert got["pos"].tolist() == want["pos"].tolist()


@pytest.mark.parametrize("n", [1, 5, 10, 11, 23, 480])
@pytest.mark.parametrize("levels", [1, 3, 10_000])
def test_deciles_with_ties(spark, n, levels):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"id": rng.permutation(n), "pred": rng.integers(0, levels, n) / 3.0})
    got = with_decile(spark.createDataFrame(pdf), "pred", "id").toPandas().set_index("id")["decile"]
    ranked = pdf.sort_values(["pred", "id"], ascending=[False, True]).reset_index(drop=True)
    want = dict(zip(ranked["id"], (ranked.index / (n / 10)).astype(int)))
    assert got.to_dict() == want


def test_deciles_with_text_ids(spark):
    pdf = pd.DataFrame({"id": [f"r{i}" for i in range(97)], "pred": [0.5] * 90 + [0.9] * 7})
    got = with_decile(spark.createDataFrame(pdf), "pred", "id").toPandas()
    want = pd.Series((np.arange(97) / 9.7).astype(int)).value_counts()
    assert got["decile"].value_counts().to_dict() == want.to_dict()
    assert set(got[got["pred"] == 0.9]["decile"]) == {0}
