"""Text operators: tokens, lemmas, tags, TF-IDF, lexicon and model sentiment, ratings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallywise.functions.scalars import parse_list_literal, softmax
from tallywise.functions.text import drop_stop_words, term_tokens, words
from tallywise.session import cut_lineage

# Fixed values of the published rule-based sentiment method.
NEGATION_FACTOR = -0.74
BOOST_DAMPING = (1.0, 0.95, 0.9)
EXCLAMATION = 0.292
NORMALISER = 15.0

# A lexicon up to this size is matched inside the text row; a larger one by the join alone.
LEXICON_LIMIT = 20_000


def clean_tokens(df: DataFrame, text: str, stop_words: Sequence[str], name: str = "tokens") -> DataFrame:
    """Lower-case words without punctuation and stop words; negations are the caller's to keep."""
    return df.withColumn(name, drop_stop_words(words(F.col(text)), stop_words))


def lemmatize(df: DataFrame, id_col: str, tokens: str, lookup: DataFrame, name: str = "lemmas") -> DataFrame:
    """Tokens replaced by the lemma of a ``(token, lemma)`` table, in place; others stay.

    Of several lemmas of a token the first in order of text is taken.
    The rows of one text leave the map side as one partial list.
    """
    flat = df.select(id_col, F.posexplode_outer(tokens).alias("pos", "token"))
    hit = flat.join(lookup.groupBy("token").agg(F.min("lemma").alias("lemma")), "token", "left")
    pair = F.when(F.col("token").isNotNull(), F.struct("pos", F.coalesce("lemma", "token").alias("lemma")))
    grouped = hit.groupBy(id_col).agg(F.sort_array(F.collect_list(pair)).alias("_l"))
    return grouped.select(id_col, F.transform("_l", lambda p: p["lemma"]).alias(name))


# ---------------------------------------------------------------- tags

def with_tags(df: DataFrame, literal: str, name: str = "tags") -> DataFrame:
    return df.withColumn(name, parse_list_literal(F.col(literal)))


def label_table(df: DataFrame, tags: str) -> DataFrame:
    """Distinct labels with their number of rows."""
    return df.select(F.explode(F.array_distinct(tags)).alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"))


def label_list(df: DataFrame, tags: str, limit: int = 10_000) -> list[str]:
    """The sorted labels on the driver, as one model per label needs them; too many are an error."""
    found = label_table(df, tags).select("label").limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} labels")
    return sorted(r["label"] for r in found)


def tag_indicators(df: DataFrame, tags: str, labels: Sequence[str], name: str = "indicators") -> DataFrame:
    """0/1 per label, in the order of the labels."""
    vocabulary = F.array(*[F.lit(x) for x in labels])
    return df.withColumn(name, F.transform(vocabulary, lambda x: F.array_contains(tags, x).cast("int")))


def tags_from_indicators(df: DataFrame, indicators: str, labels: Sequence[str], name: str = "tags") -> DataFrame:
    vocabulary = F.array(*[F.lit(x) for x in labels])
    pairs = F.zip_with(vocabulary, F.col(indicators), lambda x, on: F.when(on == 1, x))
    return df.withColumn(name, F.filter(pairs, lambda x: x.isNotNull()))


def jaccard_mean(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean over rows of |both| / |either| in per cent; rows without any label are left out."""
    both = F.size(F.array_intersect(actual, predicted)).cast("double")
    either = F.size(F.array_union(actual, predicted)).cast("double")
    return df.agg((F.avg(F.try_divide(both, either)) * 100).alias("jaccard"))


# ---------------------------------------------------------------- TF-IDF

class _Grams:
    """The words of an Arrow batch of token lists as numbers, and its pairs of neighbours, both without stop words."""

    def __init__(self, tokens: pa.Array, stop_words: Sequence[str]):
        flat = pc.list_flatten(tokens).dictionary_encode()
        self.words, word = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kept = ~pc.is_in(self.words, pa.array(stop_words, pa.string())).to_numpy(zero_copy_only=False).astype(bool)[word]
        self.word, self.row = word[kept], pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)[kept]
        self.first = np.flatnonzero(self.row[1:] == self.row[:-1])
        self.pair = self.word[self.first] * max(1, len(self.words)) + self.word[self.first + 1]

    def joined(self, pairs: np.ndarray) -> pa.Array:
        left, right = (self.words.take(pa.array(x)) for x in np.divmod(pairs, max(1, len(self.words))))
        return pc.binary_join_element_wise(left, right, " ")


def term_totals(df: DataFrame, text: str, stop_words: Sequence[str]) -> DataFrame:
    """Each one- and two-word term of the corpus, stop words dropped first, with how often it occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = _Grams(batch.column("_t"), stop_words)
            words, count = np.unique(grams.word, return_counts=True)
            yield pa.RecordBatch.from_arrays([grams.words.take(pa.array(words)), pa.array(count.astype(np.int64))], ["term", "n"])
            pairs, count = np.unique(grams.pair, return_counts=True)
            yield pa.RecordBatch.from_arrays([grams.joined(pairs), pa.array(count.astype(np.int64))], ["term", "n"])

    stop_words = list(stop_words)
    return df.select(term_tokens(F.col(text)).alias("_t")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("total"))


def _numbered(df: DataFrame, id_col: str, text: str, stop_words: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """``id, _no, n``: how often each of ``terms``, by its number, occurs in each row of ``df``."""
    known = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda found: pc.fill_null(pc.index_in(found, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        for batch in batches:
            grams = _Grams(batch.column("_t"), stop_words)
            one = number(grams.words)[grams.word]
            pairs, where = np.unique(grams.pair, return_inverse=True)
            term = np.concatenate((one, number(grams.joined(pairs))[where]))
            key = (np.concatenate((grams.row, grams.row[grams.first])) * len(terms) + term)[term >= 0]
            key, count = np.unique(key, return_counts=True)
            row, term = np.divmod(key, max(1, len(terms)))
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(row)), pa.array(term.astype(np.int32)),
                                              pa.array(count.astype(np.int64))], [id_col, "_no", "n"])

    stop_words = list(stop_words)
    schema = T.StructType([df.schema[id_col], T.StructField("_no", T.IntegerType()), T.StructField("n", T.LongType())])
    return df.select(id_col, term_tokens(F.col(text)).alias("_t")).mapInArrow(run, schema)


def _top_terms(df: DataFrame, text: str, stop_words: Sequence[str], size: int) -> tuple[DataFrame, list[str], DataFrame]:
    """The ``size`` most frequent terms: stored with their totals, as a list, and with the numbers of ``_numbered``."""
    top = cut_lineage(term_totals(df, text, stop_words).orderBy(F.col("total").desc(), "term").limit(size))
    terms = [r["term"] for r in top.select("term").collect()]
    # Numbers are shuffled, not the terms.
    return top, terms, F.broadcast(df.sparkSession.createDataFrame(list(enumerate(terms)), "_no int, term string"))


def term_counts(df: DataFrame, id_col: str, text: str, stop_words: Sequence[str],
                size: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Stored counts per text and term, and the vocabulary with its document frequency.

    The vocabulary is the ``size`` most frequent terms of the corpus. They are found first, from
    counts that carry no text id; only their occurrences are then counted per text. Words are numbered
    and counted a batch at a time, so that no row is made for an occurrence. The cut to ``size`` rows
    bounds what the driver sends to the tasks.
    """
    top, terms, names = _top_terms(df, text, stop_words, size)
    found = _numbered(df, id_col, text, stop_words, terms)
    # Rows that share an id are one text.
    counts = cut_lineage(found.groupBy(id_col, "_no").agg(F.sum("n").alias("tf")).join(names, "_no").select(id_col, "term", "tf"))
    vocabulary = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(top), "term")
    return counts, vocabulary.select("term", "total", "df")


def vocabulary(df: DataFrame, id_col: str, text: str, stop_words: Sequence[str], size: int = 5000) -> DataFrame:
    """The most frequent terms with their total and their document frequency; no counts per text are stored."""
    top, terms, names = _top_terms(df, text, stop_words, size)
    texts = _numbered(df, id_col, text, stop_words, terms).select(id_col, "_no").distinct()
    counted = texts.groupBy("_no").agg(F.count(F.lit(1)).alias("df")).join(names, "_no")
    return counted.join(F.broadcast(top), "term").select("term", "total", "df")


def tfidf(df: DataFrame, id_col: str, text: str, stop_words: Sequence[str], size: int = 5000) -> DataFrame:
    """Smoothed, L2-normalised weights ``tf * (ln((1 + n) / (1 + df)) + 1)`` per text and term."""
    counts, terms = term_counts(df, id_col, text, stop_words, size)
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    # At most `size` terms, and so at most `size` rows per text in the window.
    raw = counts.join(F.broadcast(terms.select("term", "df")), "term").withColumn("_n", n).withColumn(
        "_w", F.col("tf") * (F.log((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", "tf", (F.col("_w") / norm).alias("weight"))


# ---------------------------------------------------------------- sentiment

def lexicon_sentiment(df: DataFrame, id_col: str, text: str, lexicon: DataFrame,
                      negations: Sequence[str], boosters: dict[str, float]) -> DataFrame:
    """``neg``, ``neu``, ``pos`` and ``compound`` per text from a ``(token, valence)`` table.

    A word's valence is raised by a booster and turned by a negation among the three words before
    it; up to four exclamation marks add emphasis. One partial row per text leaves each task.
    """
    # From the first to the last word character between white space.
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\p{L}\p{N}_](?:\S*[\p{L}\p{N}_])?"), F.lit(0))
    marks = F.least(F.length(text) - F.length(F.replace(F.col(text), F.lit("!"), F.lit(""))), F.lit(4))
    # Only words of the lexicon become rows, each with the three words before it.
    known = [r["token"] for r in lexicon.select("token").limit(LEXICON_LIMIT + 1).collect()]
    places = F.sequence(F.lit(0), F.size("_t") - 1)
    if len(known) <= LEXICON_LIMIT:
        places = F.filter(places, lambda i: F.get("_t", i).isin(*known))
    hits = F.when(F.size("_t") > 0, F.transform(places, lambda i: F.struct(
        F.get("_t", i).alias("token"), *[F.get("_t", i - d).alias(f"b{d}") for d in (1, 2, 3)])))
    flat = (
        df.select(id_col, tokens.alias("_t"), (marks * EXCLAMATION).alias("_emph"))
        .select(id_col, "_emph", F.size("_t").alias("_len"), hits.alias("_h"))
        .select(id_col, "_emph", "_len", F.explode_outer("_h").alias("s"))
        .select(id_col, "_emph", "_len", "s.*")
    )
    hit = flat.join(lexicon.select("token", "valence"), "token", "left")
    v = F.col("valence")

    def boost(d: int) -> Column:
        case = F.lit(0.0)
        for word, amount in boosters.items():
            case = F.when(F.col(f"b{d}") == word, F.lit(amount * BOOST_DAMPING[d - 1])).otherwise(case)
        return case

    lift = boost(1) + boost(2) + boost(3)
    negated = F.coalesce(
        F.col("b1").isin(*negations), F.lit(False)) | F.coalesce(F.col("b2").isin(*negations), F.lit(False)) | (
        F.coalesce(F.col("b3").isin(*negations), F.lit(False)))
    raised = v + F.when(v > 0, lift).when(v < 0, -lift).otherwise(F.lit(0.0))
    valence = F.when(v.isNotNull() & (v != 0), F.when(negated, raised * NEGATION_FACTOR).otherwise(raised))
    # Fixed-point sums do not depend on the order in which tasks deliver their parts.
    fixed = lambda x: F.sum(F.round(x, 6).cast("decimal(18,6)"))
    per_text = hit.withColumn("_v", valence).groupBy(id_col).agg(
        F.max("_emph").alias("e"), F.max("_len").alias("len"),
        F.coalesce(fixed(F.col("_v")).cast("double"), F.lit(0.0)).alias("s"),
        F.coalesce(fixed(F.when(F.col("_v") > 0, F.col("_v") + 1)).cast("double"), F.lit(0.0)).alias("p"),
        F.coalesce(fixed(F.when(F.col("_v") < 0, 1 - F.col("_v"))).cast("double"), F.lit(0.0)).alias("m"),
        F.count(F.when(F.col("_v") != 0, 1)).alias("k"),
    )
    s = F.when(F.col("s") > 0, F.col("s") + F.col("e")).when(F.col("s") < 0, F.col("s") - F.col("e")).otherwise(F.lit(0.0))
    shares = per_text.select(
        id_col, s.alias("s"),
        F.when(F.col("p") > F.col("m"), F.col("p") + F.col("e")).otherwise(F.col("p")).alias("p"),
        F.when(F.col("p") < F.col("m"), F.col("m") + F.col("e")).otherwise(F.col("m")).alias("m"),
        (F.greatest("len", F.lit(0)) - F.col("k")).cast("double").alias("z"),
    ).withColumn("total", F.col("p") + F.col("m") + F.col("z"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(0.0))
    return shares.select(
        id_col, share("m").alias("neg"), share("z").alias("neu"), share("p").alias("pos"),
        (F.col("s") / F.sqrt(F.col("s") * F.col("s") + NORMALISER)).alias("compound"),
    )


Scorer = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def model_sentiment(df: DataFrame, id_col: str, text: str, load_scorer: Callable[[], Scorer]) -> DataFrame:
    """``neg``, ``neu``, ``pos`` by softmax over the three raw scores of a plug-in model.

    The model is loaded once per task and gets the row's own text in batches.
    """
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load_scorer()
        for batch in batches:
            raw = pd.DataFrame(list(scorer(batch[text].fillna("").tolist())), columns=["z0", "z1", "z2"], dtype="float64")
            yield pd.concat([batch[[id_col]].reset_index(drop=True), raw], axis=1)

    id_type = df.schema[id_col].dataType.simpleString()
    raw = df.select(id_col, text).mapInPandas(score, f"{id_col} {id_type}, z0 double, z1 double, z2 double")
    shares = softmax([F.col("z0"), F.col("z1"), F.col("z2")])
    return raw.select(id_col, *[c.alias(n) for c, n in zip(shares, ("neg", "neu", "pos"))])


def with_prefix(scores: DataFrame, id_col: str, prefix: str) -> DataFrame:
    return scores.select(id_col, *[F.col(c).alias(f"{prefix}_{c}") for c in scores.columns if c != id_col])


def mean_scores(df: DataFrame, rating: str, scores: Sequence[str]) -> DataFrame:
    return df.dropna(subset=[rating]).groupBy(rating).agg(*[F.avg(c).alias(c) for c in scores])


def most_contrary(df: DataFrame, rating: str, value: int, score: str, id_col: str) -> DataFrame:
    """The row of one rating with the highest opposite score; ties go to the lowest id."""
    return df.filter(F.col(rating) == value).orderBy(F.col(score).desc_nulls_last(), id_col).limit(1)
