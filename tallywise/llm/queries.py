"""One query for each operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.llm import (align, bpe, brown, covertree, decontaminate, hardneg, jaccard, langid, licenses, lines, pii, substrings,
                           toxicity)
from tallywise.llm.common import remainder
from tallywise.llm.oracle import ORACLE_SQL  # noqa: F401
from tallywise.session import tune
from tallywise.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """The tokenizer's file as text, read on the driver."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


@query
def op3_bpe(spark, sf_dir):
    return bpe.digests(bpe.encode(views.table(spark, sf_dir, "documents"), tokenizer_json()))


@query
def op7_substrings(spark, sf_dir):
    return substrings.digests(substrings.dedup(views.table(spark, sf_dir, "documents"), length=20))


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Labels of rows that are not held out teach the model."""
    labels = views.table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    labels = labels.select("doc_id", F.col("toxic").alias("label"))
    return toxicity.fit(docs.select("doc_id", "text").join(labels, "doc_id"))


@query
def op10_toxicity(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, spark, sf_dir))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_decontamination(spark, sf_dir):
    return decontaminate.digests(decontaminate.contamination(
        views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "benchmark"), window=13, share=1 / 20,
        near=(30, 0.8)))


@query
def op6_covertree(spark, sf_dir):
    return covertree.near_duplicates(views.table(spark, sf_dir, "embeddings"), cosine=0.9)


@query
def op2_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(views.table(spark, sf_dir, "documents"), size=5, percent=75)


@query
def op5_brown_lm(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 5) == 1)
    return brown.score(docs)


@query
def op4_line_dedup(spark, sf_dir):
    """Removed lines by number, and a digest of the text that is left."""
    return _line_digests(lines.dedup(views.table(spark, sf_dir, "documents"), least_words=5))


def _line_digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", F.size("removed_lines").cast("long").alias("n_removed"),
                          F.concat_ws(",", F.col("removed_lines").cast("array<string>")).alias("removed_lines"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query
def op1_licenses(spark, sf_dir):
    """Each document's license matches, as text."""
    found = licenses.scan(views.table(spark, sf_dir, "documents"), licenses.template_table(spark), containment=0.75)
    written = F.transform("licenses", lambda m: F.format_string(
        "%s:%d-%d", m["license_id"], m["start"], m["end"]))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"),
                        F.concat_ws(",", written).alias("licenses"),
                        F.array_max(F.transform("licenses", lambda m: m["containment"])).alias("most_containment"))


@query
def op9_pii(spark, sf_dir):
    """How many values of each document were replaced, their kinds, and a digest of the new text."""
    done = pii.pseudonymize(views.table(spark, sf_dir, "documents"), key="fixed key of this query")
    return done.select("doc_id", F.size("pii_kinds").cast("long").alias("n_values"),
                       F.concat_ws(",", F.array_sort("pii_kinds")).alias("kinds"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query
def op11_alignment(spark, sf_dir):
    return align.digests(align.align(views.table(spark, sf_dir, "documents"), *align.tokenizers()))


@query
def op12_language(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    predicted = langid.predict(docs, langid.fit(docs.where(remainder("doc_id", 4) != 2)))
    return predicted.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op13_hard_negatives(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors.withColumn("label", moved))
