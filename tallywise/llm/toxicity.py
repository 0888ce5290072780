"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned: of the words and word beginnings of labelled training texts, those that come almost
only with the label. Features are densities of lexicon words, their nearness to words of the second person,
and rates of capitals, punctuation and disguised spelling.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywise.llm.common import own_names, pieces, split_words
from tallywise.session import cut_lineage

SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine deinen euch euer ihr sie tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros u ur".split())
_PLAIN = str.maketrans("013457@$!|", "oieastasil")
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
FEATURES = ("lexicon_share", "lexicon_hits", "lexicon_distinct", "lexicon_weight", "lexicon_most", "near_you",
            "you_share", "capital_rate", "shouted_share", "mark_rate", "repeated_marks", "disguised_share",
            "digit_rate", "wide_rate", "log_words", "word_length", "distinct_share", "longest_run")


def normal_form(word: str) -> str:
    """Lower case without marks at the ends; digits and signs inside a word read as the letters they stand for."""
    core = _EDGE.sub("", word.lower())
    if core and not core.isalpha() and _LETTERS.search(core):
        core = "".join(_LETTERS.findall(core.translate(_PLAIN)))
    return core


def terms_of(word: str, least: int = 4, most: int = 7) -> list[str]:
    """A word's normal form, and its beginnings of ``least`` to ``most`` letters marked by a star."""
    core = normal_form(word)
    if not core.isalpha():
        return []
    return [core] + [core[:n] + "*" for n in range(least, min(most, len(core) - 1) + 1)]


def _disguised(word: str) -> bool:
    core = _EDGE.sub("", word)
    return bool(core) and not core.isalpha() and bool(_LETTERS.search(core)) and not re.fullmatch(r"[\w'’.,-]+", core)


def _per_text(words, marks: np.ndarray) -> np.ndarray:
    """Sums over each text of a value per word."""
    total = np.concatenate(([0], np.cumsum(marks[words.codes].astype(np.float64))))
    return np.diff(total[words.starts])


def features(text: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """A row of ``FEATURES`` for each text; a null text counts as empty, and that row is all zero."""
    words = split_words(text, lower=False)
    vocab = words.vocab.to_pylist()
    count = np.diff(words.starts).astype(np.float64)
    most = np.maximum(count, 1)
    weight, you = np.zeros(len(vocab)), np.zeros(len(vocab), bool)
    cols = {k: np.zeros(len(vocab)) for k in ("len", "upper", "shout", "mark", "again", "odd", "digit", "wide")}
    for i, w in enumerate(vocab):
        weight[i] = max((lexicon[t] for t in terms_of(w) if t in lexicon), default=0.0)
        core = _EDGE.sub("", w)
        you[i] = core.lower() in SECOND_PERSON
        letters = sum(map(str.isalpha, w))
        upper = 0 if w.islower() else sum(map(str.isupper, w))
        cols["len"][i], cols["upper"][i] = len(w), upper
        cols["shout"][i] = letters >= 3 and upper == letters
        cols["mark"][i] = 0 if letters == len(w) else sum(not c.isalnum() for c in w)
        cols["again"][i] = bool(re.search(r"([^\w\s])\1", w))
        cols["odd"][i] = letters < len(core) and _disguised(w)
        cols["digit"][i] = 0 if letters == len(w) else sum(map(str.isdigit, w))
        cols["wide"][i] = 0 if w.isascii() else sum(c > "\x7f" for c in w)
    s = {k: _per_text(words, v) for k, v in cols.items()}
    chars = np.maximum(s["len"], 1)
    hit = weight[words.codes] > 0
    hits, n_you, total = _per_text(words, weight > 0), _per_text(words, you), _per_text(words, weight)
    out = np.zeros((len(count), len(FEATURES)))
    doc = np.repeat(np.arange(len(count)), np.diff(words.starts))
    strongest, distinct, near, run = (np.zeros(len(count)) for _ in range(4))
    np.maximum.at(strongest, doc, weight[words.codes])
    if hit.any():
        pairs = np.unique(doc[hit] * len(vocab) + words.codes[hit])
        np.add.at(distinct, pairs // len(vocab), 1)
        # Distance of each lexicon word to the nearest second-person word of its text.
        at, other = np.flatnonzero(hit), np.flatnonzero(you[words.codes])
        if len(other):
            place = np.searchsorted(other, at)
            for side in (np.clip(place - 1, 0, None), np.clip(place, None, len(other) - 1)):
                same = doc[other[side]] == doc[at]
                np.maximum.at(near, doc[at[same]], 1 / (1.0 + np.abs(other[side] - at)[same]))
        gap = np.diff(at, prepend=-2)
        length = np.ones(len(at))
        for i in np.flatnonzero((gap == 1) & (doc[at] == np.concatenate(([-1], doc[at][:-1])))):
            length[i] = length[i - 1] + 1
        np.maximum.at(run, doc[at], length)
    same_word = np.unique(doc.astype(np.int64) * max(1, len(vocab)) + words.codes)
    different = np.bincount(same_word // max(1, len(vocab)), minlength=len(count))
    values = (hits / most, np.log1p(hits), distinct, total / most, strongest, near, n_you / most, s["upper"] / chars,
              s["shout"] / most, s["mark"] / chars, s["again"] / most, s["odd"] / most, s["digit"] / chars,
              s["wide"] / chars, np.log1p(count), s["len"] / most, different / most, run)
    for i, v in enumerate(values):
        out[:, i] = v
    return out


def learn_lexicon(labelled: DataFrame, least_texts: int = 4, share: float = 0.8, most_terms: int = 2000) -> dict:
    """Term -> log odds, from ``labelled(text, label)``, which is bounded by the sample it was drawn with.

    A term has to be in ``least_texts`` texts and ``share`` of them labelled 1; the ``most_terms`` best ones
    stay, which bounds the model. Terms are counted once a text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, "text"):
            words = split_words(batch.column("text"), lower=False)
            terms = [terms_of(w) for w in words.vocab.to_pylist()]
            label = batch.column("label").to_pylist()
            counts: dict[str, list[int]] = {}
            for i, y in enumerate(label):
                for t in {t for c in np.unique(words.codes[words.starts[i]:words.starts[i + 1]]) for t in terms[c]}:
                    counts.setdefault(t, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()),
                                              pa.array([v[0] for v in counts.values()], pa.int64()),
                                              pa.array([v[1] for v in counts.values()], pa.int64())],
                                             ["term", "n0", "n1"])

    seen = labelled.mapInArrow(run, "term string, n0 long, n1 long")
    odds = F.log((F.col("n1") + 0.5) / (F.col("n0") + 0.5))
    kept = (seen.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
            .where((F.col("n1") >= least_texts) & (F.col("n1") >= share * (F.col("n0") + F.col("n1"))))
            .select("term", odds.alias("odds"), "n1"))
    best = kept.orderBy(F.desc("odds"), F.desc("n1"), "term").limit(most_terms)
    return {r.term: float(r.odds) for r in best.collect()}


@dataclass
class ToxicityModel:
    lexicon: dict
    trees: GBTClassificationModel | None
    bounds: list
    values: list
    prior: float


def _portions(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that their arrays of words stay small."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        for part in pieces(64 + sizes.astype(np.int64), most_bytes):
            yield batch.slice(part.start, part.stop - part.start)


def _featured(docs: DataFrame, lexicon: dict, keep: list[str], name: str) -> DataFrame:
    """The columns ``keep`` of ``docs``, and as ``name`` the features of ``text``."""
    # The text goes to the workers once, even where it is kept.
    (own,) = ["text"] if "text" in keep else own_names("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, own):
            f = features(batch.column(own), lexicon)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * len(FEATURES)),
                                            pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), flat], [*keep, name])

    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    sent = [F.col(c) for c in keep] + [F.col("text").alias(own)] * ("text" not in keep)
    return docs.select(*sent).mapInArrow(run, schema)


def fit(labelled: DataFrame, most_rows: int = 10_000, trees: int = 30, depth: int = 4, seed: int = 7) -> ToxicityModel:
    """Fit on ``labelled(doc_id, text, label)``, of which about ``most_rows`` rows at most are used.

    The rows are chosen by a hash of doc_id. Rows with a null label are left out. Three quarters of them
    teach the lexicon and the trees, the others the calibration. With fewer than two classes among either
    the model is the share of label 1.
    """
    labelled = labelled.where("label in (0, 1)").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    n = labelled.count()
    mark = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    sample = cut_lineage(labelled.where(mark < int(1_000_000 * min(1.0, most_rows / max(n, 1))))
                         .withColumn("teach", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)) > 0))
    counts = {(r.teach, r.label): r["count"] for r in sample.groupBy("teach", "label").count().collect()}
    ones, rows = sum(v for (_, y), v in counts.items() if y), sum(counts.values())
    prior = ones / rows if rows else 0.0
    if len(counts) < 4:
        return ToxicityModel({}, None, [], [], prior)
    lexicon = learn_lexicon(sample.where("teach"))
    made = cut_lineage(_featured(sample, lexicon, ["label", "teach"], "_features").repartition(4))
    made = made.select("*", array_to_vector("_features").alias("_vector"))
    teach = made.where("teach")
    balance = counts[True, 0] / counts[True, 1]
    teach = teach.withColumn("weight", F.when(F.col("label") == 1, F.lit(balance)).otherwise(F.lit(1.0)))
    model = GBTClassifier(featuresCol="_vector", labelCol="label", predictionCol="_label",
                          weightCol="weight", maxIter=trees, maxDepth=depth,
                          stepSize=0.2, subsamplingRate=1.0, seed=seed, minInstancesPerNode=5).fit(teach)
    model = model.setRawPredictionCol("_raw").setProbabilityCol("_probability")
    held = model.transform(made.where("not teach")).select("label", vector_to_array("_probability")[1].alias("p"))
    iso = IsotonicRegression(featuresCol="p", labelCol="label").fit(held)
    return ToxicityModel(lexicon, model, [float(x) for x in iso.boundaries],
                         [float(x) for x in iso.predictions], prior)


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), least: float = 0.01) -> DataFrame:
    """The columns ``keep`` and ``score`` for each row of ``docs(text, ...)``, from the text alone.

    The calibrated probability, of which ``least`` is left to the trees' own so that ties keep their order.
    A null text scores as an empty one; repeated rows score alike; other columns are not used. A column
    ``score`` among ``keep`` is replaced.
    """
    keep = [c for c in keep if c != "score"]
    found, vector, raw, chance, label = own_names("features", "vector", "raw", "probability", "label")
    featured = _featured(docs, model.lexicon, keep, found)
    if model.trees is None:
        return featured.select(*keep, F.lit(float(model.prior)).alias("score"))
    trees = model.trees.copy().setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(chance).setPredictionCol(label)
    scored = trees.transform(featured.withColumn(vector, array_to_vector(found)))
    p = vector_to_array(chance)[1]
    smooth = (1 - least) * _interpolated(p, model.bounds, model.values) + least * p
    return scored.select(*keep, smooth.alias("score"))


def _interpolated(p, bounds: list, values: list):
    """The isotonic steps as one expression: linear between the boundaries, constant outside."""
    at = F.array(*map(F.lit, bounds))
    to = F.array(*map(F.lit, values))
    i = F.size(F.filter(at, lambda b: b <= p))
    low, high = F.get(at, i - 1), F.get(at, i)
    a, b = F.get(to, i - 1), F.get(to, i)
    between = a + (b - a) * F.try_divide(p - low, high - low)
    return F.when(i == 0, F.lit(values[0])).when(i == len(bounds), F.lit(values[-1])).otherwise(F.coalesce(between, a))
