"""Language of a text: sparse multinomial logistic regression on TF-IDF of character n-grams.

Words are runs of letters in lower case; the n-grams of one to three characters, of which the first or the last
may be a word's edge, are hashed into a fixed number of buckets. Document frequencies come from all labelled
texts. The weights are learned by the follow-the-regularised-leader update with elastic-net penalties on a
bounded sample of each language, in shards whose states are averaged after each round; a temperature fitted on
rows apart calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywise.llm.common import stored_in_buckets
from tallywise.session import cut_lineage

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Bucket of the constant feature.
CONSTANT = BUCKETS
#: Characters that are split into n-grams at a time.
PART = 1 << 20
#: Languages one model may have; each has a row of weights.
MOST_LANGUAGES = 500
#: Temperatures that calibration chooses from.
TEMPERATURES = tuple(float(2.0 ** (k / 16)) for k in range(-96, 65))


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _parts(text: str) -> Iterator[str]:
    """A text cut after about ``PART`` characters at a space, over which no n-gram goes."""
    at = 0
    while at < len(text):
        to = text.find(" ", at + PART)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to


def _grams(texts: list[str], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``owner * BUCKETS + bucket`` in order, once each, and how often it occurs."""
    lowered = [" " + t.lower() + " " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.array(owners, np.int64), [len(t) for t in lowered])
    points = np.where(_letters()[points], points, np.uint32(0))
    keep = points != 0
    keep[1:] |= keep[:-1]  # the first of what lies between two words; the rest shows nothing
    keep[0] = True
    points, owner = points[keep].astype(np.uint64), owner[keep]
    edge = points == 0
    keys, rolled = [], np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        rolled = rolled[:size] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1:] + np.uint64(n)
        if n in ORDERS:
            # No edge inside; two edges never lie side by side.
            good = ~edge[:size] if n == 1 else np.ones(size, bool)
            for k in range(1, n - 1):
                good &= ~edge[k:k + size]
            # An edge before a word may be the one after another text's last word.
            whose = owner[:size] if n == 1 else np.where(edge[:size], owner[1:size + 1], owner[:size])
            whose = whose[good]
            bucket = (rolled[good] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
            keys.append(whose * BUCKETS + bucket.astype(np.int64))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = np.concatenate(keys)
    key.sort()
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[starts], np.diff(np.append(starts, len(key)))


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``text, bucket, count`` in order of text and bucket; whole texts, a part at a time."""
    found, some, owners, room = [], [], [], PART
    for i, text in enumerate(texts):
        for part in _parts(text or ""):
            some.append(part)
            owners.append(i)
            room -= len(part)
            if room <= 0:
                found.append(_grams(some, owners))
                some, owners, room = [], [], PART
    if some:
        found.append(_grams(some, owners))
    key = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
    count = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
    distinct, where = np.unique(key, return_inverse=True) if len(found) > 1 else (key, None)
    if where is not None and len(distinct) < len(key):
        count = np.bincount(where, weights=count).astype(np.int64)
        key = distinct
    return key // BUCKETS, key % BUCKETS, count


def weighted(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``text, bucket, value``: ``(1 + ln count) * idf``, each text scaled to length one."""
    text, bucket, count = counted(texts)
    value = (1 + np.log(count)) * idf[bucket]
    norm = np.sqrt(np.bincount(text, weights=value * value, minlength=len(texts)))
    return text, bucket, value / np.where(norm > 0, norm, 1)[text]


@dataclass
class LanguageModel:
    langs: list
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores for each text, and which texts have a letter."""
        text, bucket, value = weighted(texts, self.idf)
        out = np.repeat(self.weights[:, CONSTANT][None, :], len(texts), axis=0)
        for k, w in enumerate(self.weights):
            out[:, k] += np.bincount(text, weights=value * w[bucket], minlength=len(texts))
        return out, np.bincount(text, minlength=len(texts)) > 0


def leader_weights(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """The weights that follow from sums of gradients ``z`` and of their squares ``n``."""
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))


def learn_row(z: np.ndarray, n: np.ndarray, y: int, bucket: np.ndarray, value: np.ndarray, rates: tuple) -> None:
    """One update of ``z`` and ``n`` by a row with the label ``y``."""
    zs, ns = z[:, bucket], n[:, bucket]
    w = leader_weights(zs, ns, *rates)
    logit = w @ value
    p = np.exp(logit - logit.max())
    p /= p.sum()
    p[y] -= 1.0
    g = p[:, None] * value[None, :]
    square = ns + g * g
    z[:, bucket] = zs + g - (np.sqrt(square) - np.sqrt(ns)) / rates[0] * w
    n[:, bucket] = square


def document_frequencies(labelled: DataFrame) -> np.ndarray:
    """In how many of all ``labelled`` texts each bucket occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for texts in _portions(batch.column("text")):
                total += np.bincount(counted(texts)[1], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    rows = labelled.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.toLocalIterator():
        out[r.bucket] = r.n
    return out


def _portions(column: pa.Array) -> Iterator[list[str | None]]:
    """Texts of a batch in runs of about ``PART`` characters."""
    some, room = [], PART
    for value in column:
        text = value.as_py()
        some.append(text)
        room -= 64 + len(text or "")
        if room <= 0:
            yield some
            some, room = [], PART
    if some:
        yield some


def fit(labelled: DataFrame, most_rows: int = 2000, rounds: int = 6, shards: int | None = None, alpha: float = 1.0,
        beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, seed: int = 11) -> LanguageModel | None:
    """Fit on ``labelled(doc_id, text, lang)``; None without a labelled row.

    Rows with a null text or lang are left out. Document frequencies count every row; weights and temperature are
    learned from ``most_rows`` rows of each language at most, chosen by a hash of doc_id and text, a fifth of
    them for the temperature. There are four ``shards``, or as many as languages, so that a shard holds about
    ``most_rows`` rows at most. The driver holds one weight a language and bucket.
    """
    labelled = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(sizes)
    docs = sum(sizes.values())
    idf = np.log((1.0 + docs) / (1.0 + document_frequencies(labelled))) + 1.0
    if len(langs) == 1:
        return LanguageModel(langs, idf, np.zeros((1, BUCKETS + 1)))

    spark, shards = labelled.sparkSession, shards or max(4, len(langs))
    known = spark.createDataFrame([(lang, i, min(1.0, 1.5 * most_rows / sizes[lang] + 50 / sizes[lang]))
                                   for i, lang in enumerate(langs)], "lang string, y int, share double")
    mark = F.xxhash64("doc_id", "text", F.lit(seed))
    near = (labelled.withColumn("mark", mark).join(F.broadcast(known), "lang")
            .where(F.pmod("mark", F.lit(1 << 30)) < F.col("share") * (1 << 30)))
    place = F.row_number().over(Window.partitionBy("y").orderBy("mark", "doc_id"))
    near = near.withColumn("place", place).where(F.col("place") <= most_rows)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _portions(batch.column("text")):
                text, bucket, value = weighted(texts, idf)
                ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("y"), part.column("mark"), pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(value))], ["y", "mark", "buckets", "vals"])

    rows = cut_lineage(near.select("y", "mark", "text").mapInArrow(
        featured, "y int, mark long, buckets array<int>, vals array<double>")
        .withColumn("shard", F.pmod(F.shiftright("mark", 8), F.lit(5 * shards)).cast("int")))
    # In buckets: a round reads its shards where they lie and moves states alone.
    teach = stored_in_buckets(rows.where(F.col("shard") < 4 * shards).withColumn("shard", F.pmod("shard", F.lit(shards))), "shard")
    rates = (alpha, beta, l1, l2)
    z, n = (np.zeros((len(langs), BUCKETS + 1)) for _ in range(2))
    for _ in range(rounds):
        z, n = _round(teach, z, n, rates)
    model = LanguageModel(langs, idf, leader_weights(z, n, *rates))
    model.temperature = _temperature(rows.where(F.col("shard") >= 4 * shards), model.weights)
    return model


def _round(teach: DataFrame, z: np.ndarray, n: np.ndarray, rates: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the states that the shards come to from ``z`` and ``n`` by one pass over their rows."""
    width = 1 << 12

    def run(table: pa.Table) -> pa.Table:
        own_z, own_n = z.copy(), n.copy()
        table = table.sort_by([("mark", "ascending"), ("y", "ascending")])
        for y, buckets, vals in zip(*(table.column(c) for c in ("y", "buckets", "vals"))):
            bucket = np.append(buckets.values.to_numpy(), CONSTANT) if len(buckets) else np.array([CONSTANT])
            value = np.append(vals.values.to_numpy(), 1.0) if len(vals) else np.ones(1)
            learn_row(own_z, own_n, y.as_py(), bucket, value, rates)
        at = range(0, z.shape[1], width)
        return pa.table({"block": pa.array([a // width for a in at], pa.int32()),
                         "shard": pa.array([table.column("shard")[0].as_py()] * len(at), pa.int32()),
                         "z": pa.array([own_z[:, a:a + width].tobytes() for a in at], pa.binary()),
                         "n": pa.array([own_n[:, a:a + width].tobytes() for a in at], pa.binary())})

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        sums = [sum(np.frombuffer(x.as_buffer()) for x in table.column(c)) / table.num_rows for c in ("z", "n")]
        return pa.table({"block": table.column("block")[:1], "shard": table.column("shard")[:1], "z": pa.array([sums[0].tobytes()], pa.binary()),
                         "n": pa.array([sums[1].tobytes()], pa.binary())})

    schema = "block int, shard int, z binary, n binary"
    got = teach.groupBy("shard").applyInArrow(run, schema).groupBy("block").applyInArrow(mean, schema)
    rows = sorted(got.collect(), key=lambda r: r.block)
    if not rows:
        return z, n
    return tuple(np.concatenate([np.frombuffer(bytes(r[c])).reshape(len(z), -1) for r in rows], axis=1) for c in ("z", "n"))


def _temperature(rows: DataFrame, weights: np.ndarray) -> float:
    """The temperature with the least log loss over ``rows``; 1 without rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, seen = np.zeros(len(TEMPERATURES)), 0
        for batch in batches:
            for y, buckets, vals in zip(*(batch.column(c) for c in ("y", "buckets", "vals"))):
                logit = weights[:, CONSTANT].copy()
                if len(buckets):
                    logit += weights[:, buckets.values.to_numpy()] @ vals.values.to_numpy()
                scaled = (logit - logit.max())[None, :] / np.array(TEMPERATURES)[:, None]
                loss += np.log(np.exp(scaled).sum(axis=1)) - scaled[:, y.as_py()]
                seen += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(loss)), pa.int32()), pa.array(loss)], ["k", "loss"])

    best = rows.select("y", "buckets", "vals").mapInArrow(run, "k int, loss double").groupBy("k").agg(
        F.sum("loss").alias("loss")).orderBy(F.round("loss", 6), "k").first()
    return TEMPERATURES[best.k] if best else 1.0


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs(doc_id, text, ...)``, from the text alone.

    ``lang_pred`` is a language of the model, the first of equally likely ones, and ``score`` its calibrated
    probability. A text that is null, empty or without a letter is ``und`` with a score of 0; so is every text
    where there was nothing to learn from. Repeated rows score alike; doc_id may have any type; other columns
    are not used. A long text is read whole, a part at a time.
    """
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _portions(batch.column("text")):
                logits, known = model.logits(texts)
                scaled = (logits - logits.max(axis=1, keepdims=True)) / model.temperature
                best = np.argmax(scaled, axis=1)
                score = np.where(known, 1.0 / np.exp(scaled).sum(axis=1), 0.0)
                found = [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(found, pa.string()), pa.array(score)],
                    ["doc_id", "lang_pred", "score"])
                at += len(texts)

    schema = docs.select("doc_id").schema.add("lang_pred", "string").add("score", "double")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
