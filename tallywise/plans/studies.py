"""Whole analyses by name, each a few operators over one input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.functions.scalars import number_label
from tallywise.operators import anomaly, detection, geo, imaging, models, risk, summary, text, timeline
from tallywise.session import cut_lineage, cut_parts, recorded_scratch, remove_scratch, shuffles_removed


# ---------------------------------------------------------------- spend overview

def spend_overview(txn: DataFrame, months: Sequence[str]) -> dict[str, DataFrame]:
    """Monthly totals and box-plot matrix, and the top agencies, descriptions and vendors."""
    agencies = summary.total_by(txn, ["agency_number", "agency_name"]).withColumn(
        "agency_label", number_label(F.col("agency_number"), F.col("agency_name")))
    mccs = summary.distinct_per_key(txn, "vendor", "mcc", "n_mccs")
    return {
        "monthly_summary": summary.monthly_summary(txn),
        "monthly_boxplot": summary.boxplot_matrix(summary.boxplot(txn, "ym", "amount"), "ym", months),
        "top_agencies": summary.top_n(agencies, "total", 20, ["agency_label"]),
        "top_descriptions": summary.top_n(summary.total_by(txn, ["description"]), "total", 20, ["description"]),
        "top_vendors": summary.top_n(summary.total_by(txn, ["vendor"]), "total", 40, ["vendor"]),
        "top_vendors_by_mccs": summary.top_n(mccs, "n_mccs", 10, ["vendor"]),
        "mean_mccs": mccs.agg(F.avg("n_mccs").alias("mean_mccs")),
    }


# ---------------------------------------------------------------- anomaly features

def ratio_bin_counts(rows: DataFrame, round_to: int | None = 9) -> DataFrame:
    """Rows per probability bin of the ratio, with the bin's label; empty bins at 0."""
    probs = anomaly.RATIO_PROBABILITIES
    counts = anomaly.bin_stats(rows, "ratio", probs, round_to=round_to).select("bin_id", "count")
    labels = anomaly.probability_bins(rows.sparkSession, probs).select("bin_id", "label")
    return summary.empty_bins(labels, counts, "bin_id")


def peer_ratio(txn: DataFrame, keys: Sequence[str], ties: Sequence[str], stat: str = "median") -> dict[str, DataFrame]:
    """Ratio to the group mean or median: description, bins, figures per bin and the extremes."""
    rows = cut_lineage(anomaly.group_ratio(txn, keys, stat=stat))
    return {
        "rows": rows,
        "description": summary.describe(rows, "ratio"),
        "bins": ratio_bin_counts(rows, None),
        "bin_stats": anomaly.bin_stats(rows, "ratio"),
        "extremes": anomaly.extremes(rows, "ratio", ties),
    }


def posting_lag(txn: DataFrame, min_days: int = 100) -> dict[str, DataFrame]:
    rows = anomaly.with_posting_lag(txn)
    return {"stats": anomaly.lag_stats(rows), "long": rows.where(F.col("lag_days") > min_days)}


def month_on_month(txn: DataFrame, entity: Sequence[str], limits: Sequence[float] = (1000.0, 5000.0)) -> dict[str, DataFrame]:
    changes = anomaly.period_change(txn, entity)
    # One row per entity and month, read by all that follows.
    changes = cut_lineage(changes)
    rules = {f"over_{limit:g}": F.col("pct_change") > limit for limit in limits}
    return {
        "changes": changes, "description": summary.describe(changes, "pct_change"),
        "extremes": anomaly.extreme_history(changes, entity),
        "shares": summary.flagged_shares(txn, entity, changes, rules),
    }


def vendor_month_on_month(txn: DataFrame, entity: Sequence[str] = ("vendor",), extreme: float = 1_000_000.0,
                          limit: float = 200_000.0) -> dict[str, DataFrame]:
    """Changes without the entities of extreme ones, and who is still beyond the limit."""
    changes = cut_lineage(anomaly.period_change(txn, list(entity)))
    kept = anomaly.without_extreme(changes, list(entity), extreme)
    beyond = anomaly.beyond_change(kept, limit)
    return {
        "description": summary.describe(changes, "pct_change"),
        "trimmed_description": summary.describe(kept, "pct_change"),
        "beyond": beyond, "share": summary.flagged_share(txn, list(entity), beyond),
    }


def vendor_spike(txn: DataFrame) -> dict[str, DataFrame]:
    rows = cut_lineage(anomaly.monthly_spike(txn))
    hits = rows.where("anomaly")
    return {"rows": rows, "share": summary.flagged_share(txn, ["vendor"], hits)}


def refunds(txn: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    patterns = cut_lineage(anomaly.refund_patterns(txn, keys))
    return {"patterns": patterns, "anomalies": anomaly.refund_anomalies(patterns, keys, n=20)}


def velocities(txn: DataFrame, entity: Sequence[str]) -> dict[str, DataFrame]:
    out = {}
    for period in ("day", "week"):
        rows = cut_lineage(anomaly.velocity(txn, entity, period=period))
        out[period] = rows
        out[f"{period}_share"] = summary.flagged_share(txn, entity, rows.where("anomaly"))
    return out


def idle_time(txn: DataFrame, entity: Sequence[str], ts: str = "txn_ts") -> dict[str, DataFrame]:
    return {"bins": anomaly.gap_bins(txn, entity, ts), "long": anomaly.long_gaps(txn, entity, ts)}


# ---------------------------------------------------------------- credit risk

def _prepared(loans: DataFrame | Sequence[DataFrame], numbers: Sequence[str], categories: Sequence[str], label: str, row_id: str,
              train_share: float, seed: int, with_test: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Training rows as feature vectors, and the test rows if wanted, fitted on the training rows only; both are stored.

    ``loans`` may come in parts, which are stored in turn. Rows are stored a column each, which takes less room than
    vectors, and become vectors as they are read.
    """
    parts, columns = [loans] if isinstance(loans, DataFrame) else list(loans), [*numbers, *categories]
    spark, packed = parts[0].sparkSession, {"compression": "zstd"}

    def stored(side: DataFrame, weighed: bool) -> DataFrame:
        ready = risk.woe_apply(
            risk.fill_categories(risk.impute_mean(train, side, numbers), categories), weights, categories)
        kept = cut_parts([(risk.with_class_weight(ready, label) if weighed else ready).select(
            row_id, label, *columns, *(["weight"] if weighed else []))], **packed)
        return models.feature_matrix(kept, columns, [c for c in kept.columns if c not in columns])

    # The loans are joined once; what is read again and again is made from the stored rows, which then go.
    with recorded_scratch() as paths, shuffles_removed(spark):
        split = cut_parts([risk.hash_split(p.select(row_id, label, *columns), [row_id], train_share, seed) for p in parts], **packed)
        train, test = split.where("is_train"), split.where("NOT is_train")
        weights = cut_lineage(risk.woe_table(risk.fill_categories(train, categories), categories, label))
        used = list(paths)
        out = stored(train, True), stored(test, False) if with_test else None
    remove_scratch(spark, used)
    return out


def credit_models(train: DataFrame, label: str = "label", folds: int = 5, candidates: int | None = None,
                  searches: Sequence[models.Search] = (models.TREE, models.LOGISTIC, models.BOOSTED),
                  row_id: str = "row_id"):
    return {s.kind: models.random_search(train, s, label, folds=folds, candidates=candidates, row_id=row_id).bestModel
            for s in searches}


def credit_scores(spark: SparkSession, loans: DataFrame | Sequence[DataFrame], numbers: Sequence[str], categories: Sequence[str],
                  label: str = "label", row_id: str = "row_id", folds: int = 5, candidates: int | None = None,
                  searches: Sequence[models.Search] = (models.TREE, models.LOGISTIC, models.BOOSTED)) -> DataFrame:
    """Test rows with class and probability of each searched model."""
    train, test = _prepared(loans, numbers, categories, label, row_id, 0.7, 0, True)
    out: DataFrame | None = None
    for kind, model in credit_models(train, label, folds, candidates, searches, row_id).items():
        scored = models.predict(model, test, [row_id, label]).withColumn("model", F.lit(kind))
        out = scored if out is None else out.unionByName(scored)
    return out


def credit_importance(spark: SparkSession, loans: DataFrame | Sequence[DataFrame], numbers: Sequence[str], categories: Sequence[str],
                      label: str = "label", row_id: str = "row_id", folds: int = 5, candidates: int | None = None,
                      n: int = 20) -> DataFrame:
    """The ``n`` features the best tree uses most; one row per feature."""
    train, _ = _prepared(loans, numbers, categories, label, row_id, 0.7, 0)
    model = credit_models(train, label, folds, candidates, [models.TREE], row_id)["tree"]
    rows = models.feature_importance(model, [*numbers, *categories], n)
    return spark.createDataFrame([(a, float(b)) for a, b in rows], "feature string, importance double")


def model_report(scored: DataFrame, label: str = "label", row_id: str = "row_id", loan: float = 10_000.0,
                 rate: float = 0.10) -> dict[str, DataFrame]:
    """Metrics, curves, gains and profit of one model's scored rows."""
    ranked = risk.with_decile(scored, "probability", row_id)
    return {
        "metrics": risk.confusion_metrics(scored, label, "predicted"),
        "auc": risk.auc_exact(scored, label, "probability"),
        "roc": risk.roc_points(scored, label, "probability"),
        "pr": risk.pr_points(scored, label, "probability"),
        "gains": risk.gains_table(ranked, label, loan=loan, rate=rate),
        "sensitivity": risk.profit_sensitivity(ranked, label, loan=loan),
    }


# ---------------------------------------------------------------- text

def tag_study(posts: DataFrame, id_col: str, text_col: str, tags: str, stop_words: Sequence[str],
              kinds: Sequence[str] = ("sgd", "logistic", "svc"), train_share: float = 0.8) -> DataFrame:
    """Held-out mean Jaccard of one-model-per-label taggers, one row per kind of model."""
    labels = text.label_list(posts, tags)
    space = models.fit_terms(posts, id_col, text_col, stop_words)
    ready = cut_lineage(risk.hash_split(
        space.transform(text.tag_indicators(posts, tags, labels), text_col), [id_col], train_share,
    ).select(id_col, tags, "indicators", "features", "is_train"))
    train, test = ready.where("is_train"), ready.where("NOT is_train")
    out: DataFrame | None = None
    for kind in kinds:
        fitted = models.fit_tag_models(train, "indicators", labels, kind, id_col)
        score = text.jaccard_mean(models.predict_tags(fitted, test, labels), tags, "predicted").withColumn("kind", F.lit(kind))
        out = score if out is None else out.unionByName(score)
    return out


def sentiment_study(reviews: DataFrame, lexicon: DataFrame, negations: Sequence[str],
                    boosters: dict[str, float]) -> dict[str, DataFrame]:
    scores = text.with_prefix(text.lexicon_sentiment(reviews, "id", "text", lexicon, negations, boosters), "id", "vader")
    rated = reviews.join(scores, "id", "left")
    return {
        "ratings": summary.row_counts(reviews, ["score"]),
        "scores": rated,
        "by_rating": text.mean_scores(rated, "score", ["vader_compound", "vader_neg", "vader_neu", "vader_pos"]),
        "one_star_positive": text.most_contrary(rated, "score", 1, "vader_pos", "id"),
        "five_star_negative": text.most_contrary(rated, "score", 5, "vader_neg", "id"),
    }


# ---------------------------------------------------------------- geo, imaging, detection, timeline

def store_regions(stores: DataFrame, polygons: DataFrame, store_id: str) -> DataFrame:
    return stores.join(geo.tag_points(stores, polygons, store_id), store_id, "left")


def dominant_colors(pixels: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    centers, assigned = imaging.kmeans_colors(pixels, k)
    shares = imaging.cluster_share(assigned)
    return {
        "mean": imaging.mean_color(pixels), "mode": imaging.mode_color(pixels), "centers": centers,
        "palette": imaging.even_palette(centers), "palette_by_share": imaging.palette_strip(centers, shares),
    }


def text_boxes(cells: DataFrame, ratio_x: float, ratio_y: float, min_score: float = 0.5) -> DataFrame:
    """Boxes per frame in the coordinates of the original frame."""
    return detection.rescale_boxes(detection.nms_boxes(detection.decode_boxes(cells, min_score)), ratio_x, ratio_y)


def cut_timeline(cuts: DataFrame) -> dict[str, DataFrame]:
    return {"segments": timeline.segments(cuts), "rejected": timeline.rejected_cuts(cuts)}
