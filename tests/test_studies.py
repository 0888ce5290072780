"""The whole analyses run on the test tables and agree with their parts."""

from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallywise.plans import studies
from tallywise.plans.catalog import BOOSTERS, LEXICON, MONTHS, NEGATIONS
from tallywise.sources import views

SF = "/root/testdata/sf0.001"


def test_spend_studies(spark):
    txn = views.txn(spark, SF, ["cardholder", "vendor", "mcc", "agency_number", "agency_name", "description", "ym",
                                "txn_ts", "posted_ts", "orderkey", "linenumber", "partkey", "amount"])
    overview = studies.spend_overview(txn, MONTHS)
    assert sum(r["transaction_count"] for r in overview["monthly_summary"].collect()) == 6000
    assert overview["monthly_boxplot"].count() == 10 and overview["top_agencies"].count() == 20
    ratio = studies.peer_ratio(txn, ["vendor", "mcc"], ["orderkey", "linenumber"])
    assert sum(r["count"] for r in ratio["bins"].collect()) == 6000
    assert sum(r["count"] for r in ratio["bin_stats"].collect()) == 6000
    assert studies.posting_lag(txn)["long"].where("lag_days <= 100").count() == 0
    mom = studies.month_on_month(txn, ["cardholder"])
    assert {r["rule"] for r in mom["shares"].collect()} == {"over_1000", "over_5000"}
    vendor = studies.vendor_month_on_month(txn, limit=100.0)
    assert vendor["share"].first()["n_flagged"] == vendor["beyond"].select("vendor").distinct().count()
    assert studies.vendor_spike(txn)["share"].first()["n_total"] == 10
    assert studies.refunds(txn, ["vendor", "ym"])["patterns"].where("high_refund_rate is null").count() == 0
    assert studies.velocities(txn, ["vendor"])["day_share"].first()["n_total"] == 10
    assert studies.idle_time(txn, ["cardholder"])["bins"].count() > 0


def test_other_studies(spark):
    lexicon = spark.createDataFrame(list(LEXICON), "token string, valence double")
    mood = studies.sentiment_study(views.reviews(spark, SF), lexicon, NEGATIONS, BOOSTERS)
    assert mood["by_rating"].count() == 5 and mood["one_star_positive"].count() == 1
    tagged = studies.store_regions(views.places(spark, SF), views.boxes(spark, SF), "place_id")
    assert tagged.count() == 150 and tagged.where("region is null").count() == 0
    colors = studies.dominant_colors(views.pixels(spark, SF), 2)
    assert colors["palette_by_share"].count() == colors["centers"].count() == 20
    cuts = studies.cut_timeline(views.cut_points(spark, SF))
    assert cuts["segments"].where("start_s is null or end_s is null").count() == 0


def test_credit_queries_search_all_candidates(spark, monkeypatch):
    searched = []

    def search(train, search, label, folds, candidates, row_id):
        searched.append((search.kind, candidates or search.candidates, folds))
        return SimpleNamespace(bestModel=None)

    none = spark.createDataFrame([], "row_id string, label int, predicted int, probability double")
    monkeypatch.setattr(studies, "_prepared", lambda *a: (None, None))
    monkeypatch.setattr(studies.models, "random_search", search)
    monkeypatch.setattr(studies.models, "predict", lambda *a: none)
    monkeypatch.setattr(studies.models, "feature_importance", lambda *a: [("a", 1.0)])
    queries = entry.queries()
    queries["credit_risk_scores"](spark, SF)
    assert searched == [("tree", 30, 5), ("logistic", 50, 5), ("boosted", 40, 5)]
    searched.clear()
    queries["credit_risk_importance"](spark, SF)
    assert searched == [("tree", 30, 5)]


def test_credit_rows_are_joined_once_in_parts(spark, monkeypatch):
    """What made the loans runs once for each row, and parts of the loans hold each row once."""
    whole = views.loans(spark, SF)
    monkeypatch.setattr(views, "LOAN_ROWS", 1000)
    parts = views.loan_parts(spark, SF)
    assert len(parts) > 3 and all(p.count() > 0 for p in parts)
    rows = lambda df: sorted(map(str, df.collect()))
    assert sorted(r for p in parts for r in rows(p)) == rows(whole)

    seen = spark.sparkContext.accumulator(0)

    def marked(x):
        seen.add(1)
        return x

    numbers, categories = list(views.LOAN_NUMBERS), list(views.LOAN_CATEGORIES)
    counted = [p.withColumn("label", F.udf(marked, "int")("label")) for p in parts]
    train, test = studies._prepared(counted, numbers, categories, "label", "row_id", 0.7, 0, True)
    assert train.count() + test.count() == whole.count() == seen.value
    one, none = studies._prepared(whole, numbers, categories, "label", "row_id", 0.7, 0)
    assert none is None and one.columns == train.columns == ["row_id", "label", "weight", "features"]
    ids = lambda df: rows(df.select("row_id", "label", F.round("weight", 9)))
    assert ids(one) == ids(train) and set(test.columns) == {"row_id", "label", "features"}
    near = lambda df: np.array([r.features.toArray() for r in df.orderBy("row_id", F.col("features").cast("string")).collect()])
    assert np.allclose(near(one), near(train))
