"""The pipeline's stages, each against a plain version on what the stage before it kept, and the registered queries."""

import hashlib

import corpus_pipeline
from tallywise.llm import queries
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").where("toxic = 1").collect()}
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination",
                            "BPE encoding and decoding"]

    def stage(name):
        nonlocal docs
        out = stages[name](spark, docs, SF_DIR)
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
        return rows

    rows = stage("toxicity")
    assert docs.columns == columns and all(before[r.doc_id] == r.text for r in rows)
    gone = set(before) - {r.doc_id for r in rows}
    assert len(gone - toxic) <= 0.1 * len(before)

    was = [(r.doc_id, r.text) for r in rows]
    removed = dict(brute.removed_lines(was))
    rows = stage("line dedup")
    assert docs.columns == columns and len(rows) == len(was)
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in removed[d]) for d, t in was}
    assert {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows if removed[r.doc_id])

    was = [(r.doc_id, r.text) for r in rows]
    rows = stage("n-gram Jaccard join")
    assert docs.columns == columns and {r.doc_id for r in rows} == {d for d, _, c in brute.jaccard(was) if d == c}

    was = [(r.doc_id, r.text) for r in rows]
    rows = stage("benchmark decontamination")
    assert docs.columns == columns
    assert {r.doc_id for r in rows} == {d for d, _, _, _, bad in brute.contamination(was, items) if not bad}

    t = Tokenizer.from_str(queries.tokenizer_json())
    want = {r.doc_id: t.encode(r.text, add_special_tokens=False).ids for r in rows}
    rows = stage("BPE encoding and decoding")
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in rows} == {
        d: (len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()) for d, i in want.items()}


def test_stages_with_odd_rows_and_names(spark):
    """Null ids, texts and other columns, repeated rows, shared ids, and columns named as operators name theirs."""
    from pyspark.sql import functions as F

    names = ("score", "removed_lines", "n_words", "hits", "contaminated", "component_id", "row", "words", "_features", "_text",
             "_row", "_lines", "_doc", "_found", "near_hits", "label", "teach")
    some = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(None, "a text without an id, with seven more words", None, None, None), (900_001, None, "en", "s", 0),
                                 (900_002, "", None, "s", 0), (900_003, " \n\t\n", "en", None, None)], some.schema)
    docs = some.union(odd).union(odd).union(some.limit(20)).select("*", *(F.lit(n).alias(n) for n in names))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        was = [(r.doc_id, r.text) for r in docs.collect()]
        out = stages[name](spark, docs, SF_DIR)
        rows = out.collect()
        assert out.columns == docs.columns and all(r[n] == n for r in rows for n in names)
        got = sorted(((r.doc_id, r.text) for r in rows), key=repr)
        if name == "line dedup":
            gone = brute.removed_lines(was)
            want = [(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g))
                    for (d, t), (_, g) in zip(was, gone)]
            assert got == sorted(want, key=repr)
        elif name == "n-gram Jaccard join":
            keep = {(d, c) for d, _, c in brute.jaccard(was)}
            dropped = {d for d, c in keep if d != c} - {d for d, c in keep if d == c}
            assert got == sorted([x for x in was if x[0] not in dropped], key=repr)
        elif name == "benchmark decontamination":
            want = [x for x, (*_, bad) in zip(was, brute.contamination(was, items)) if not bad]
            assert got == sorted(want, key=repr)
        else:
            assert set(got) <= set(was) and {(900_001, None), (900_002, "")} <= set(got)
        docs = spark.createDataFrame(rows, out.schema)


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        assert out.collect() == []
        docs = spark.createDataFrame([], out.schema)


def test_each_operator_has_one_query():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages_clear_up(spark):
    from pathlib import Path

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, SF_DIR)
    out = spark.createDataFrame(out.collect(), out.schema)
    left = list(corpus_pipeline._left)
    dict(corpus_pipeline.STAGES)["BPE encoding and decoding"](spark, out, SF_DIR)
    assert left and not any(Path(p.removeprefix("file:")).exists() for p in left)
