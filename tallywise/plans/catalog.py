"""Every operator as a query over the test tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywise.functions import scalars as S
from tallywise.operators import anomaly, detection, geo, imaging, models, risk, summary, text, timeline
from tallywise.plans import studies
from tallywise.session import cut_lineage, scratch_path, tune
from tallywise.sources import readers, views
from tallywise.streaming import monitors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(places: int = 6) -> Callable[[Query], Query]:
    """Register a query; doubles of its result are rounded so that engines can be compared."""
    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(tune(spark), sf_dir), places)

        QUERIES[fn.__name__] = run
        return run

    return register


def rounded(df: DataFrame, places: int) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(c, places) for c in doubles}) if doubles else df


# Parameters of the queries; the oracle uses the same ones.
MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13) if (y, m) <= (2001, 8)]
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "on", "it", "for", "as", "was", "be", "with", "by",
              "this", "are", "at", "from", "an", "de", "la", "que", "le", "en", "der", "die", "und")
LEXICON = (("thatin", 1.9), ("hehely", -1.5), ("inoran", 2.4), ("orantion", -2.2), ("ononst", 0.8),
           ("rewh", 1.3), ("orre", -1.1), ("eau", 1.6), ("elle", -2.7), ("ment", 3.1), ("keit", -0.9), ("ung", 2.0))
NEGATIONS = ("on", "la", "und", "not", "no")
BOOSTERS = {"of": 0.293, "ci": -0.293, "der": 0.293}
KMEANS_K = (5, 3, 1)
SPLIT_SEED = 0


def _amounts(spark, sf, *columns):
    return views.txn(spark, sf, [*columns, "amount"])


# ---------------------------------------------------------------- parsing

@query()
def parsed_order_text(spark, sf):
    """Months, US timestamps and amounts parsed back from text, some of which is no number."""
    day = F.col("o_orderdate")
    raw = views.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(day, "yyyyMM").alias("ym"), F.date_format(day, "M/d/yyyy h:mm:ss a").alias("moment"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(" - ")).otherwise(
            F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" "))).alias("amount"))
    return raw.select(
        "o_orderkey", S.month_start(S.month_from_yyyymm(F.col("ym"))).alias("month"),
        F.date_format(S.parse_us_timestamp(F.col("moment")), "yyyy-MM-dd HH:mm:ss").alias("moment"),
        S.to_number(F.col("amount"), "decimal(18,2)").cast("double").alias("amount"))


# ---------------------------------------------------------------- summaries

@query()
def table_shape(spark, sf):
    return summary.shape(views.table(spark, sf, "lineitem"))


@query()
def preview_rows(spark, sf):
    return summary.preview(views.table(spark, sf, "orders"), ["o_orderkey"], 500)


@query()
def monthly_summary(spark, sf):
    return summary.monthly_summary(_amounts(spark, sf, "ym"))


@query()
def monthly_boxplot(spark, sf):
    return summary.boxplot(_amounts(spark, sf, "ym"), "ym", "amount")


@query()
def boxplot_event_type(spark, sf):
    return summary.boxplot(views.table(spark, sf, "events"), "event_type", "value")


@query()
def monthly_boxplot_matrix(spark, sf):
    return summary.boxplot_matrix(summary.boxplot(_amounts(spark, sf, "ym"), "ym", "amount"), "ym", MONTHS)


@query()
def top_agencies(spark, sf):
    totals = summary.total_by(_amounts(spark, sf, "agency_number", "agency_name"), ["agency_number", "agency_name"])
    label = S.number_label(F.col("agency_number"), F.col("agency_name"))
    return summary.top_n(totals.select(label.alias("agency_label"), "total"), "total", 20, ["agency_label"])


@query()
def top_descriptions(spark, sf):
    totals = summary.total_by(_amounts(spark, sf, "description"), ["description"])
    return summary.top_n(totals, "total", 20, ["description"])


@query()
def top_vendors(spark, sf):
    return summary.top_n(summary.total_by(_amounts(spark, sf, "vendor"), ["vendor"]), "total", 40, ["vendor"])


@query()
def top_reasons(spark, sf):
    counts = summary.row_counts(_amounts(spark, sf, "description"), ["description"])
    return summary.top_n(counts, "count", 20, ["description"])


@query()
def mccs_per_vendor(spark, sf):
    return summary.distinct_per_key(_amounts(spark, sf, "vendor", "mcc"), "vendor", "mcc", "n_mccs")


@query()
def top_vendors_by_mccs(spark, sf):
    per = summary.distinct_per_key(_amounts(spark, sf, "vendor", "mcc"), "vendor", "mcc", "n_mccs")
    return summary.top_n(per, "n_mccs", 10, ["vendor"])


@query()
def mean_mccs_per_vendor(spark, sf):
    per = summary.distinct_per_key(_amounts(spark, sf, "vendor", "mcc"), "vendor", "mcc", "n_mccs")
    return per.agg(F.avg("n_mccs").alias("mean_mccs"))


@query()
def rating_counts(spark, sf):
    return summary.row_counts(views.reviews(spark, sf), ["score"])


@query()
def profile_columns(spark, sf):
    return summary.profile_columns(views.loans(spark, sf)).drop("sample_values")


@query()
def null_rates(spark, sf):
    loans = views.loans(spark, sf)
    return summary.null_rates(loans, loans.columns)


@query()
def class_share(spark, sf):
    return summary.class_share(views.loans(spark, sf), "label")


# ---------------------------------------------------------------- peer ratios

VENDOR_MCC = ["vendor", "mcc"]
RATIO_OUT = ["orderkey", "linenumber", "partkey", "vendor", "mcc"]


def _ratio(spark, sf, stat, round_to=9):
    return anomaly.group_ratio(views.txn(spark, sf, [*RATIO_OUT, "amount"]), VENDOR_MCC, stat=stat, round_to=round_to)


def _ratio_rows(df):
    return df.select(*RATIO_OUT, F.col("amount").cast("double").alias("amount"), "group_stat", "ratio")


@query()
def vendor_mcc_mean(spark, sf):
    return summary.mean_by(_amounts(spark, sf, *VENDOR_MCC), VENDOR_MCC, name="vendor_mcc_avg")


@query()
def vendor_mcc_median(spark, sf):
    return summary.median_by(_amounts(spark, sf, *VENDOR_MCC), VENDOR_MCC, name="vendor_mcc_median")


@query()
def zero_median_groups(spark, sf):
    medians = summary.median_by(_amounts(spark, sf, *VENDOR_MCC), VENDOR_MCC, name="m")
    return summary.groups_at_zero(medians, "m")


@query()
def ratio_to_mean(spark, sf):
    return _ratio_rows(_ratio(spark, sf, "mean", None))


@query()
def ratio_to_median(spark, sf):
    return _ratio_rows(_ratio(spark, sf, "median", None))


@query()
def describe_ratio(spark, sf):
    return summary.describe(_ratio(spark, sf, "median"), "ratio")


@query()
def ratio_bins(spark, sf):
    return studies.ratio_bin_counts(_ratio(spark, sf, "median"))


@query()
def ratio_bin_rows(spark, sf):
    rows = cut_lineage(_ratio_rows(_ratio(spark, sf, "median")))
    return anomaly.quantile_bins(rows, "ratio", round_to=9).select(*RATIO_OUT, F.col("amount"), "bin_id")


@query()
def ratio_bin_stats(spark, sf):
    return anomaly.bin_stats(_ratio(spark, sf, "mean"), "ratio", round_to=9)


@query()
def ratio_extremes(spark, sf):
    rows = cut_lineage(_ratio_rows(_ratio(spark, sf, "median", None)).where((F.col("ratio") < 0) | (F.col("ratio") > 1.5)))
    return anomaly.extremes(rows, "ratio", RATIO_OUT, below=0.0, above=1.5)


# ---------------------------------------------------------------- posting lag

LAG_COLUMNS = ["orderkey", "linenumber", "partkey", "vendor", "txn_ts", "posted_ts", "amount"]


@query()
def posting_lag_stats(spark, sf):
    return anomaly.lag_stats(anomaly.with_posting_lag(views.txn(spark, sf, ["txn_ts", "posted_ts", "amount"])))


@query()
def long_lags(spark, sf):
    rows = anomaly.with_posting_lag(views.txn(spark, sf, LAG_COLUMNS)).where(F.col("lag_days") > 100)
    return rows.select("orderkey", "linenumber", "partkey", "vendor", F.col("amount").cast("double").alias("amount"), "lag_days")


# ---------------------------------------------------------------- month on month

def _changes(spark, sf, entity):
    return anomaly.period_change(_amounts(spark, sf, entity, "ym"), [entity])


@query(4)
def cardholder_mom(spark, sf):
    return _changes(spark, sf, "cardholder")


@query(4)
def vendor_mom(spark, sf):
    return _changes(spark, sf, "vendor")


@query(3)
def describe_mom(spark, sf):
    return summary.describe(_changes(spark, sf, "cardholder"), "pct_change")


@query(4)
def mom_extreme_history(spark, sf):
    return anomaly.extreme_history(cut_lineage(_changes(spark, sf, "cardholder")), ["cardholder"])


@query(4)
def vendor_mom_trimmed(spark, sf):
    return anomaly.without_extreme(cut_lineage(_changes(spark, sf, "vendor")), ["vendor"], limit=20_000)


@query(4)
def vendor_mom_beyond(spark, sf):
    return anomaly.beyond_change(_changes(spark, sf, "vendor"), limit=2_000)


@query()
def flagged_share(spark, sf):
    base = _amounts(spark, sf, "cardholder", "ym")
    changes = anomaly.period_change(base, ["cardholder"])
    rules = {f"over_{limit}": F.col("pct_change") > limit for limit in (1000, 5000)}
    return summary.flagged_shares(base, ["cardholder"], changes, rules)


@query(3)
def vendor_monthly_spike(spark, sf):
    return anomaly.monthly_spike(_amounts(spark, sf, "vendor", "ym"))


@query(3)
def vendor_monthly_spike_own_history(spark, sf):
    return anomaly.monthly_spike(_amounts(spark, sf, "vendor", "ym"), sigmas=2.0, history="totals")


# ---------------------------------------------------------------- refunds, velocity, gaps

@query()
def refund_cardholder(spark, sf):
    return anomaly.refund_patterns(_amounts(spark, sf, "cardholder", "ym"), ["cardholder", "ym"])


@query()
def refund_vendor(spark, sf):
    return anomaly.refund_patterns(_amounts(spark, sf, "vendor", "ym"), ["vendor", "ym"])


@query()
def refund_anomalies(spark, sf):
    keys = ["cardholder", "ym"]
    return anomaly.refund_anomalies(anomaly.refund_patterns(_amounts(spark, sf, *keys), keys), keys, n=20)


def _velocity(spark, sf, entity, period):
    return anomaly.velocity(views.txn(spark, sf, [entity, "txn_ts"]), [entity], period=period)


@query()
def velocity_day_cardholder(spark, sf):
    return _velocity(spark, sf, "cardholder", "day")


@query()
def velocity_week_cardholder(spark, sf):
    return _velocity(spark, sf, "cardholder", "week")


@query()
def velocity_day_vendor(spark, sf):
    return _velocity(spark, sf, "vendor", "day")


@query()
def velocity_week_vendor(spark, sf):
    return _velocity(spark, sf, "vendor", "week")


@query()
def velocity_hour_user(spark, sf):
    hourly = anomaly.velocity(views.table(spark, sf, "events"), ["user_id"], ts="ts", period="hour")
    return hourly.withColumn("period", F.col("period").cast("timestamp_ntz"))


@query()
def velocity_flagged_share(spark, sf):
    return anomaly.velocity_shares(views.txn(spark, sf, ["vendor", "txn_ts"]), ["vendor"])


@query()
def days_since_last(spark, sf):
    rows = views.txn(spark, sf, ["cardholder", "txn_ts", *views.TXN_KEY])
    out = anomaly.days_since_previous(rows, ["cardholder"], "txn_ts", list(views.TXN_KEY))
    return out.select("cardholder", "orderkey", "linenumber", "partkey", "vendor",
                      F.col("amount").cast("double").alias("amount"), "days_since_last")


@query()
def days_since_last_event(spark, sf):
    out = anomaly.days_since_previous(views.table(spark, sf, "events"), ["user_id"], "ts", ["event_id"])
    return out.select("user_id", "event_id", "days_since_last")


@query()
def gap_bins(spark, sf):
    return anomaly.gap_bins(views.txn(spark, sf, ["cardholder", "txn_ts"]), ["cardholder"], "txn_ts")


@query()
def long_gaps(spark, sf):
    return anomaly.long_gaps(views.txn(spark, sf, ["cardholder", "txn_ts"]), ["cardholder"], "txn_ts")


# ---------------------------------------------------------------- credit risk

NUMBERS, CATEGORIES = list(views.LOAN_NUMBERS), list(views.LOAN_CATEGORIES)


def _split(spark, sf):
    df = risk.hash_split(views.loans(spark, sf), ["row_id"], 0.7, SPLIT_SEED, digest="md5")
    return df.where("is_train"), df.where("NOT is_train"), df


@query()
def hash_split(spark, sf):
    return _split(spark, sf)[2].select("row_id", "is_train")


@query(3)
def impute_mean(spark, sf):
    train, test, _ = _split(spark, sf)
    return risk.impute_mean(train, test, NUMBERS).select("row_id", *NUMBERS)


@query()
def null_rate_report(spark, sf):
    train, test, _ = _split(spark, sf)
    return risk.null_rate_report(train, test, NUMBERS)


@query()
def fill_unknown(spark, sf):
    return risk.fill_categories(views.loans(spark, sf), CATEGORIES).select("row_id", *CATEGORIES)


@query()
def woe_table(spark, sf):
    train, _, _ = _split(spark, sf)
    return risk.woe_table(risk.fill_categories(train, CATEGORIES), CATEGORIES, "label")


@query()
def woe_apply(spark, sf):
    train, test, _ = _split(spark, sf)
    return risk.woe_encode(train, test, CATEGORIES, "label").select("row_id", *CATEGORIES)


@query()
def class_weights(spark, sf):
    return risk.class_weights(views.loans(spark, sf), "label")


def _predicted(spark, sf):
    return views.scored(spark, sf).withColumn("predicted", F.when(F.col("pred") >= 50, 1).otherwise(0))


@query()
def confusion_metrics(spark, sf):
    return risk.confusion_metrics(_predicted(spark, sf), "actual", "predicted")


@query()
def roc_points(spark, sf):
    return risk.roc_points(views.scored(spark, sf), "actual", "pred")


@query()
def pr_points(spark, sf):
    return risk.pr_points(views.scored(spark, sf), "actual", "pred")


@query(9)
def auc_exact(spark, sf):
    return risk.auc_exact(views.scored(spark, sf), "actual", "pred")


@query()
def deciles(spark, sf):
    return risk.with_decile(views.scored(spark, sf), "pred", "id").select("id", "decile")


@query()
def deciles_tied(spark, sf):
    tied = views.scored(spark, sf).withColumn("pred", F.floor(F.col("pred") / 100).cast("double"))
    return risk.with_decile(tied, "pred", "id").select("id", "decile")


@query()
def gains_table(spark, sf):
    return risk.gains_table(risk.with_decile(views.scored(spark, sf), "pred", "id"), "actual")


@query()
def profit_sensitivity(spark, sf):
    return risk.profit_sensitivity(risk.with_decile(views.scored(spark, sf), "pred", "id"), "actual")


@query()
def credit_risk_scores(spark, sf):
    # All three searches at their full budgets: 30, 50 and 40 candidates.
    return studies.credit_scores(spark, views.loan_parts(spark, sf), NUMBERS, CATEGORIES, folds=5)


@query()
def credit_risk_importance(spark, sf):
    return studies.credit_importance(spark, views.loan_parts(spark, sf), NUMBERS, CATEGORIES, folds=5)


# ---------------------------------------------------------------- text

@query()
def tokens_clean(spark, sf):
    out = text.clean_tokens(views.documents(spark, sf), "text", STOP_WORDS)
    return out.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query()
def lemma_lookup(spark, sf):
    tokens = text.clean_tokens(views.documents(spark, sf), "text", STOP_WORDS)
    # A lemma table from the texts themselves: a final "s" falls off longer words.
    lookup = tokens.select(F.explode_outer("tokens").alias("token")).distinct().where(
        F.col("token").endswith("s") & (F.length("token") > 4)
    ).select("token", F.expr("substring(token, 1, length(token) - 1)").alias("lemma"))
    out = text.lemmatize(tokens, "doc_id", "tokens", lookup)
    return out.select("doc_id", F.array_join("lemmas", " ").alias("lemmas"))


@query()
def tag_indicators(spark, sf):
    posts = text.with_tags(views.posts(spark, sf), "tags")
    labels = text.label_list(posts, "tags")
    out = text.tag_indicators(posts, "tags", labels)
    return out.select("id", F.array_join(F.transform("indicators", lambda i: i.cast("string")), "").alias("indicators"))


@query()
def tags_restored(spark, sf):
    posts = text.with_tags(views.posts(spark, sf), "tags")
    labels = text.label_list(posts, "tags")
    back = text.tags_from_indicators(text.tag_indicators(posts, "tags", labels), "indicators", labels, "back")
    return back.select("id", F.array_join("back", ",").alias("tags"))


@query()
def label_counts(spark, sf):
    return text.label_table(text.with_tags(views.posts(spark, sf), "tags"), "tags")


@query()
def tfidf_weights(spark, sf):
    return text.tfidf(views.documents(spark, sf), "doc_id", "text", STOP_WORDS)


@query()
def tfidf_vocabulary(spark, sf):
    return text.vocabulary(views.documents(spark, sf), "doc_id", "text", STOP_WORDS)


@query()
def jaccard_mean(spark, sf):
    docs = views.documents(spark, sf)
    guessed = F.when(F.col("n_chars") > 1000, F.col("lang")).otherwise(F.lit("en"))
    pairs = docs.select(F.array("lang", "source").alias("actual"), F.array(guessed, F.lit("src1")).alias("predicted"))
    return text.jaccard_mean(pairs, "actual", "predicted")


def _sentiment(spark, sf):
    lexicon = spark.createDataFrame(list(LEXICON), "token string, valence double")
    return text.lexicon_sentiment(views.reviews(spark, sf), "id", "text", lexicon, NEGATIONS, BOOSTERS)


@query()
def lexicon_sentiment(spark, sf):
    return _sentiment(spark, sf)


def _rated(spark, sf):
    scores = text.with_prefix(_sentiment(spark, sf), "id", "vader")
    return views.reviews(spark, sf).join(scores, "id", "left")


@query()
def sentiment_by_rating(spark, sf):
    return text.mean_scores(_rated(spark, sf), "score", [f"vader_{c}" for c in ("neg", "neu", "pos", "compound")])


@query(4)
def sentiment_interval(spark, sf):
    return summary.mean_interval(_rated(spark, sf), "score", ["vader_compound"])


@query()
def most_contrary_text(spark, sf):
    rated = _rated(spark, sf).withColumns({"pos6": F.round("vader_pos", 6), "neg6": F.round("vader_neg", 6)})
    low = text.most_contrary(rated, "score", 1, "pos6", "id").withColumn("kind", F.lit("one_star_positive"))
    high = text.most_contrary(rated, "score", 5, "neg6", "id").withColumn("kind", F.lit("five_star_negative"))
    return low.unionByName(high).select("kind", "id", "score", "text")


def length_scorer():
    """A stand-in for a text model: raw scores from lengths and marks."""
    def score(texts: Sequence[str]) -> list[list[float]]:
        return [[len(t) % 7 / 2.0, len(t) % 5 / 2.0, t.count("a") % 3 / 2.0] for t in texts]

    return score


@query()
def model_sentiment(spark, sf):
    return text.model_sentiment(views.reviews(spark, sf), "id", "text", length_scorer)


@query()
def tag_predictions(spark, sf):
    return studies.tag_study(views.documents(spark, sf).select("doc_id", "text", F.array("lang").alias("tags")),
                             "doc_id", "text", "tags", STOP_WORDS)


# ---------------------------------------------------------------- geo, imaging, detection, timeline

@query()
def region_enrich(spark, sf):
    nation, supplier = views.table(spark, sf, "nation"), views.table(spark, sf, "supplier")
    # One name is spelt differently on the attribute side.
    spelt = F.regexp_replace("n_name", "^NATION_7$", "NATION 7").alias("province")
    facts = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(spelt).agg(
        F.count(F.lit(1)).alias("suppliers"), F.max("s_acctbal").alias("top_balance"))
    return geo.region_enrich(nation, facts, "n_name", "province", ["suppliers", "top_balance"])


@query()
def point_in_polygon(spark, sf):
    return geo.tag_points(views.places(spark, sf), views.boxes(spark, sf), "place_id")


@query()
def mean_color(spark, sf):
    return imaging.mean_color(views.pixels(spark, sf))


@query()
def mode_color(spark, sf):
    return imaging.mode_color(views.pixels(spark, sf))


def _palettes(spark, sf):
    """Palettes at rest: centres and shares for each number of colours."""
    centers, assigned = imaging.kmeans_palettes(views.pixels(spark, sf), KMEANS_K)
    return centers, imaging.cluster_share(assigned)


@query()
def kmeans_palette(spark, sf):
    return _palettes(spark, sf)[0]


@query()
def cluster_share(spark, sf):
    return _palettes(spark, sf)[1]


@query()
def palette_strip(spark, sf):
    return imaging.palette_strip(*_palettes(spark, sf))


@query()
def decode_boxes(spark, sf):
    return detection.decode_boxes(views.cells(spark, sf))


@query()
def rescale_boxes(spark, sf):
    return detection.rescale_boxes(detection.decode_boxes(views.cells(spark, sf)), 1000 / 320, 562 / 320)


@query()
def nms_boxes(spark, sf):
    return detection.nms_boxes(detection.decode_boxes(views.cells(spark, sf)))


@query()
def timeline_segments(spark, sf):
    return timeline.segments(views.cut_points(spark, sf))


@query()
def timeline_rejects(spark, sf):
    return timeline.rejected_cuts(views.cut_points(spark, sf)).select("video_id", "seq", "cut")


@query()
def text_lines(spark, sf):
    """Lines of the documents, by way of text files, and how often each occurs."""
    path = scratch_path(spark, "lines")
    views.documents(spark, sf).select(F.explode(F.split(F.regexp_replace("text", "\r", " "), "\n")).alias("line")).write.text(path)
    return readers.read_lines(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- streams

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, sf):
    return monitors.read_event_stream(spark, sf, EVENT_SCHEMA, "events.parquet")


def _day(df):
    return df.withColumn("window_start", F.to_date("window_start"))


@query()
def stream_velocity(spark, sf):
    return _day(monitors.run_to_table(monitors.stream_velocity(_events(spark, sf), "user_id"), "velocity"))


@query()
def stream_velocity_week(spark, sf):
    counts = monitors.stream_velocity(_events(spark, sf), "user_id", period="week")
    return _day(monitors.run_to_table(counts, "velocity-week"))


@query()
def stream_velocity_flag(spark, sf):
    history = anomaly.velocity(views.table(spark, sf, "events"), ["user_id"], ts="ts", period="day")
    baseline = cut_lineage(history.groupBy("user_id").agg(F.max("mean").alias("mean"), F.max("std").alias("std")))
    counts = monitors.stream_velocity(_events(spark, sf), "user_id")
    return _day(monitors.run_to_table(monitors.flag_velocity(counts, baseline, "user_id", 2.0), "velocity-flag"))


@query()
def stream_refunds(spark, sf):
    amount = F.col("value").cast("decimal(18,2)")
    stream = monitors.stream_refunds(_events(spark, sf), "user_id", F.col("event_type") == "error", amount)
    return _day(monitors.run_to_table(stream, "refunds"))


@query()
def stream_gap(spark, sf):
    return monitors.gaps_by_batch(_events(spark, sf), "user_id", "event_id")


@query()
def stream_gap_state(spark, sf):
    return monitors.run_to_table(monitors.stream_gaps(_events(spark, sf), "user_id", "event_id"), "gap-state")


@query()
def stream_distinct(spark, sf):
    # Every event is delivered twice.
    twice = _events(spark, sf).unionByName(_events(spark, sf))
    stream = monitors.without_repeats(twice, ["event_id"]).select("event_id", "user_id")
    return monitors.run_to_table(stream, "distinct")


