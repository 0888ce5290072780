"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.llm import bpe, decontaminate, jaccard, lines, toxicity
from tallywise.llm.common import own_names
from tallywise.llm.queries import tokenizer_json, toxicity_model
from tallywise.session import cut_lineage, recorded_scratch, remove_scratch, tune
from tallywise.sources import views

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Text that a task of the last stage holds at a time; its executors still hold memory of the stages before.
TOKEN_CHUNK_BYTES = 4 << 20
#: Scratch tables of the stage called last. Its result is written by the time the next one is called.
_left: list[str] = []


def stage(fn: Stage) -> Stage:
    """A stage that first removes what the stage before it left in the shared folder."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_scratch(spark, _left)
        with recorded_scratch() as made:
            out = fn(tune(spark), docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but doc_id and text under names that no operator adds, and those names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = dict(zip(others, own_names(*(f"c{i}" for i in range(len(others))))))
    return docs.select("doc_id", "text", *(F.col(c).alias(n) for c, n in named.items())), named


def _back(docs: DataFrame, named: dict[str, str], columns: list[str]) -> DataFrame:
    return docs.select(*(F.col(named.get(c, c)).alias(c) for c in columns))


@stage
def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; the model learns from the labelled ones among ``docs``."""
    own, named = _apart(docs)
    scored = toxicity.score(own, toxicity_model(docs, spark, sf_dir), keep=tuple(own.columns))
    return _back(scored.where("score < 0.5"), named, docs.columns)


@stage
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the lines that repeat an earlier one; ``n_chars`` is that of the new text."""
    own, named = _apart(docs)
    cleaned = lines.dedup(own)
    if "n_chars" in named:
        n = named["n_chars"]
        cleaned = cleaned.withColumn(n, F.when(
            F.size("removed_lines") > 0, F.length("text")).otherwise(F.col(n)).cast(docs.schema["n_chars"].dataType))
    return _back(cleaned, named, docs.columns)


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near copies of one another the one with the smallest doc_id; all without near copies.

    Texts without words are near copies of nothing. Where rows share the smallest doc_id all of them stay.
    """
    found = jaccard.near_duplicates(docs)
    dropped = found.where("doc_id <> component_id").select("doc_id", "component_id").distinct()
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    gone = dropped.join(kept, "doc_id", "left_anti").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@stage
def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in passages of 13 words of a benchmark item."""
    own, named = _apart(docs)
    judged = decontaminate.contamination(own, views.table(spark, sf_dir, "benchmark"), window=13, share=1 / 20)
    return _back(judged.where(~F.col("contaminated")), named, docs.columns)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document that is left."""
    return bpe.digests(bpe.encode(docs, tokenizer_json(), TOKEN_CHUNK_BYTES))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", keep_harmless),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("BPE encoding and decoding", tokens),
]

#: Model scores and token ids cannot be said in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, one in STAGES[:-1]:
        docs = cut_lineage(one(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
