"""Language identification: features and updates against plain versions, and held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.llm import langid
from tallywise.llm.queries import QUERIES
from tests.llm.test_align import odd_texts

MASK = (1 << 64) - 1
SF_DIR = "/root/testdata/sf0.01"


def bucket_of(gram):
    rolled = 0
    for n, c in enumerate(gram, 1):
        rolled = (rolled * 0x9E3779B97F4A7C15 + (0 if c == " " else ord(c)) + n) & MASK
    return (rolled * 0xD6E8FEB86659FD93 & MASK) >> 48


def plain_counts(text):
    """N-grams of one to three characters of each word with its edges as spaces."""
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" "):
        if word:
            padded = f" {word} "
            out.update(word)
            for n in (2, 3):
                out.update(padded[i:i + n] for i in range(len(padded) - n + 1))
    found = Counter()
    for gram, k in out.items():
        found[bucket_of(gram)] += k
    return found


@pytest.mark.parametrize("part", [1 << 20, 50])
def test_counts(monkeypatch, corpus, part):
    monkeypatch.setattr(langid, "PART", part)
    texts = [t for _, t in corpus] + odd_texts(200, 5) + ["", None, "a", "a" * 500, "7", "Straße İstanbul"]
    text, bucket, count = langid.counted(texts)
    got = [Counter() for _ in texts]
    for t, b, n in zip(text.tolist(), bucket.tolist(), count.tolist()):
        assert b not in got[t]
        got[t][b] = n
    assert got == [plain_counts(t) for t in texts]


def test_weights_of_a_text():
    idf = np.linspace(1, 3, langid.BUCKETS)
    text, bucket, value = langid.weighted(["abc ab", None, "z"], idf)
    want = {b: (1 + math.log(n)) * idf[b] for b, n in plain_counts("abc ab").items()}
    norm = math.sqrt(sum(v * v for v in want.values()))
    got = {b: v for t, b, v in zip(text, bucket, value) if t == 0}
    assert got.keys() == want.keys() and all(math.isclose(got[b], want[b] / norm) for b in got)
    assert math.isclose(sum(v * v for t, v in zip(text, value) if t == 2), 1)


def test_one_update():
    rng, rates = random.Random(1), (0.7, 1.0, 0.05, 0.01)
    z, n = (np.array([[rng.uniform(0, 1) for _ in range(6)] for _ in range(3)]) for _ in range(2))
    bucket, value, y = np.array([1, 4, 5]), np.array([0.5, 0.2, 1.0]), 2
    weight = [[0.0 if abs(z[k, b]) <= 0.05 else
               -(z[k, b] - math.copysign(0.05, z[k, b])) / ((1.0 + math.sqrt(n[k, b])) / 0.7 + 0.01) for b in bucket]
              for k in range(3)]
    logit = [sum(w * v for w, v in zip(row, value)) for row in weight]
    total = sum(map(math.exp, logit))
    want_z, want_n = z.copy(), n.copy()
    for k in range(3):
        for w, b, v in zip(weight[k], bucket, value):
            g = (math.exp(logit[k]) / total - (k == y)) * v
            want_z[k, b] += g - (math.sqrt(n[k, b] + g * g) - math.sqrt(n[k, b])) / 0.7 * w
            want_n[k, b] += g * g
    langid.learn_row(z, n, y, bucket, value, rates)
    assert np.allclose(z, want_z) and np.allclose(n, want_n)


def test_frequencies_count_every_text(spark, corpus):
    texts = [t for _, t in corpus]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    want = Counter(b for t in texts for b in plain_counts(t))
    got = langid.document_frequencies(docs)
    assert {b: int(got[b]) for b in np.flatnonzero(got)} == dict(want)


def test_held_out_accuracy(spark):
    rows = QUERIES["op12_language"](spark, SF_DIR).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and len(held) > 200
    right = [r.lang_pred == lang[r.doc_id] for r in held]
    assert np.mean(right) >= 0.97
    # Calibrated: what is said with a mean probability comes true about as often.
    assert abs(np.mean([r.score for r in held]) - np.mean(right)) < 0.03
    assert all(0 <= r.score <= 1 for r in rows)


def test_weights_are_sparse_and_shards_do_not_matter_much(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = langid.fit(docs)
    assert model.langs == ["de", "en", "es", "fr"] and (model.weights == 0).mean() > 0.5
    again = langid.fit(docs.repartition(7))
    assert np.array_equal(model.weights, again.weights) and model.temperature == again.temperature


def test_odd_rows(spark, docs, no_docs):
    labelled = docs.where("lang is not null")
    model = langid.fit(labelled)
    assert model.langs == ["en"]
    out = {r.doc_id: r for r in langid.predict(docs.withColumn("lang_pred", F.lit(1)), model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (102, 103, 104)) and out[0].lang_pred == "en"
    assert langid.fit(no_docs) is None and langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert langid.predict(no_docs, model).collect() == []
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    two = docs.withColumn("lang", F.when(F.length("text") > 300, "long").otherwise("short"))
    assert langid.predict(two.withColumn("doc_id", F.col("doc_id").cast("string")), langid.fit(two)).count() == docs.count()
    # Rows that all share one id and text stay within the bound.
    same = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("le chat").alias("text"),
                                    F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"))
    assert langid.fit(same, most_rows=20).langs == ["a", "b"]


def test_rounds_move_no_texts(spark, monkeypatch):
    """The rows a model learns from are stored by shard once; a round reads them without an exchange."""
    docs = spark.createDataFrame([(i, f"{'ein und der' if i % 2 else 'the of and'} wort {i}", "de" if i % 2 else "en")
                                  for i in range(60)], "doc_id long, text string, lang string")
    seen, one = [], langid._round
    monkeypatch.setattr(langid, "_round", lambda teach, *a: seen.append(teach) or one(teach, *a))
    model = langid.fit(docs, rounds=2)
    assert model.langs == ["de", "en"] and len(seen) == 2
    plan = seen[0].groupBy("shard").count()._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("Physical Plan")[-1]
