"""Language-model scoring with Brown classes: class transitions and word emissions give smoothed log probabilities.

Words that occur often enough are put into classes by exchange clustering: each word moves to the class under
which its neighbours' classes are likeliest. Moves of a round are worked out against the counts before it, so that
words are spread over all tasks; later rounds move half of the words each, which keeps them from chasing one
another. Rarer words share one class, the end of a text has its own.

The vocabulary is a table in buckets of word hashes, with each word's count and class; it grows with the corpus
and is never gathered. A chunk of texts sends its distinct words to the buckets once; in each round it gets their
classes back, counts which classes stand next to each word, and sends those counts to the buckets, which move
their words. Only the transitions between classes come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.common import (ask, by_chunk, key_message, make_chunks, mix, pack, split_words, stored_in_buckets,
                                  unpack, with_answers)
from tallywise.session import cut_lineage, recorded_scratch, remove_scratch

#: Text of a chunk.
CHUNK_BYTES = 6 << 20
STATE = "bucket long, words binary, counts binary, kinds binary"


@dataclass
class ClassModel:
    """``vocabulary``: per bucket ascending word hashes, training counts and classes (-1: rare), as a stored table."""

    tokens: int = 0                      # N: all training tokens, ends included
    distinct: int = 0                    # V: distinct ones among them
    texts: int = 0                       # training texts, each with an end
    classes: int = 32                    # of frequent words
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))   # counts of class after class
    class_tokens: np.ndarray = field(default_factory=lambda: np.zeros(0))       # of frequent words, by class
    class_words: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vocabulary: DataFrame | None = None

    @property
    def width(self) -> int:
        return self.classes + 2

    def log_transitions(self, weight: float = 5.0) -> np.ndarray:
        """log10 of a class after a class, drawn towards the classes' own shares by ``weight`` tokens."""
        n = self.transitions
        share = (n.sum(axis=0) + 0.5) / (n.sum() + 0.5 * self.width)
        return np.log10((n + weight * share) / (n.sum(axis=1, keepdims=True) + weight))

    def words(self) -> DataFrame:
        """``word, n, class``: the hash of each training word, its count, and its class (-1: rare)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for parts in zip(*(batch.column(c) for c in ("words", "counts", "kinds"))):
                    words, counts, kinds = _state(*parts)
                    yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts),
                                                      pa.array(kinds.astype(np.int32))], ["word", "n", "class"])

        return self.vocabulary.select("words", "counts", "kinds").mapInArrow(run, "word long, n long, class int")


def _state(words, counts, kinds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The arrays of a bucket."""
    return (np.frombuffer(words.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int64),
            np.frombuffer(kinds.as_buffer(), np.int16))


def _with_ends(codes: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """The codes with ``end`` after each text."""
    n = len(starts) - 1
    out = np.full(len(codes) + n, end, np.int64)
    doc = np.repeat(np.arange(n), np.diff(starts))
    out[np.arange(len(codes)) + doc] = codes
    return out


def word_buckets(spark) -> int:
    """Buckets of the vocabulary: as many as shuffle partitions, which the user sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class _Chunk:
    """Texts as codes of words, the frequent ones first; ``by_key`` are the codes in order of their ``keys``."""
    doc_ids: pa.Array
    held_out: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    by_key: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, payload: tuple) -> _Chunk:
        planes, sizes = payload[2:4]
        codes = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()
        return cls(*payload[:2], codes, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), *payload[4:])

    def training(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes and starts of the training texts alone."""
        counts, keep = np.diff(self.starts), ~self.held_out
        return self.codes[np.repeat(keep, counts)], np.concatenate(([0], np.cumsum(counts[keep])))

    def by_code(self, values: np.ndarray) -> np.ndarray:
        """Values that come in order of the keys, in order of the codes."""
        out = np.empty_like(values)
        out[self.by_key] = values
        return out


def chunks_of(docs: DataFrame) -> DataFrame:
    """``(chunk, payload)`` of ``docs(doc_id, text, held_out)``, stored by chunk: every pass reads this and not the texts."""
    def build(batch: pa.RecordBatch):
        words = split_words(batch.column("text"), lower=True)
        order = np.argsort(-np.bincount(words.codes, minlength=len(words.vocab)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        planes = rank[words.codes].astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
        hashes = words.hashes()[order]
        by_key = np.argsort(hashes, kind="stable").astype(np.int32)
        return (batch.column("doc_id"), batch.column("held_out").to_numpy(zero_copy_only=False), planes,
                np.diff(words.starts).astype(np.int32), by_key, hashes[by_key])

    return stored_in_buckets(make_chunks(docs.select("doc_id", "text", "held_out"), build, CHUNK_BYTES), "chunk")


def asked_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """Each chunk's distinct words, and how often each occurs in its training texts; stored."""
    def messages(payload, _):
        chunk = _Chunk.of(payload)
        n = np.bincount(chunk.training()[0], minlength=len(chunk.keys))
        where, columns = key_message(chunk.keys, buckets)
        return where, [*columns, n[chunk.by_key].astype(np.int32)]

    return cut_lineage(ask(chunks, messages, buckets))


def vocabulary(asked: DataFrame, classes: int, least: int) -> DataFrame:
    """``STATE`` of the training words; those that occur ``least`` times start in a class by their hash."""
    def add(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpack(m.as_buffer()) for m in table.column("message")]
        word, inverse = np.unique(np.concatenate([np.cumsum(k) for k, _ in parts]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
        word, n = word[n > 0], n[n > 0]
        start = (mix(word ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(classes)).astype(np.int16)
        return _bucket(key[0], word, n, np.where(n >= least, start, np.int16(-1)))

    return cut_lineage(asked.groupBy("bucket").applyInArrow(add, STATE))


def _bucket(number, words: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> pa.Table:
    return pa.table({"bucket": pa.array([number.as_py()], pa.int64()), "words": pa.array([words.tobytes()], pa.binary()),
                     "counts": pa.array([counts.tobytes()], pa.binary()), "kinds": pa.array([kinds.astype(np.int16).tobytes()], pa.binary())})


def _answered(asked: DataFrame, state: DataFrame, say) -> DataFrame:
    """``say(places, known, bucket's arrays)`` to each chunk about the words it sent to a bucket."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("chunk")
        words, counts, kinds = _state(*(right.column(c)[0] for c in ("words", "counts", "kinds"))) if right.num_rows else (
            np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int16))
        out = []
        for m in left.column("message"):
            keys = np.cumsum(unpack(m.as_buffer())[0])
            at = np.minimum(np.searchsorted(words, keys), max(0, len(words) - 1))
            known = words[at] == keys if len(words) else np.zeros(len(keys), bool)
            out.append(pack(say(at, known, counts, kinds)))
        return pa.table({"chunk": left.column("chunk"), "level": pa.array([0] * left.num_rows, pa.int32()),
                         "bucket": left.column("bucket"), "message": pa.array(out, pa.binary())})

    return asked.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(
        run, "chunk long, level int, bucket long, message binary")


def _say_class(at: np.ndarray, known: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> tuple:
    """Each word's class, and of the frequent ones their numbers among the bucket's frequent words."""
    if not len(kinds):
        return np.full(len(at), -1, np.int16), np.empty(0, np.int32)
    kind = np.where(known, kinds[at], np.int16(-1))
    number = np.cumsum(kinds >= 0, dtype=np.int32) - 1
    return kind, number[at[kind >= 0]]


def _say_count(at: np.ndarray, known: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> tuple:
    if not len(kinds):
        return np.full(len(at), -1, np.int16), np.zeros(len(at), np.int64)
    return np.where(known, kinds[at], np.int16(-1)), np.where(known, counts[at], 0)


def contexts(chunks: DataFrame, answers: DataFrame, buckets: int, width: int) -> DataFrame:
    """``bucket, chunk, message``, stored: per frequent word of a chunk counts of the classes after and before it.

    A message has the words' numbers in the bucket, classes (those before a word from ``width`` on) and counts.
    The chunk's transitions between classes are in a row of bucket -1.
    """
    def use(number: int, payload, got: dict) -> pa.Table:
        chunk = _Chunk.of(unpack(payload))
        parts = got.get(0, [])
        kinds = np.concatenate([p[0] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64)
        codes, starts = chunk.training()
        rare, end = width - 2, width - 1
        kind = np.append(chunk.by_code(np.where(kinds < 0, rare, kinds)), end)
        codes = _with_ends(codes, starts, len(kinds))
        own = kind[codes]
        before = np.concatenate(([end], own[:-1])).astype(np.int64)
        transitions = np.bincount(before * width + own, minlength=width * width)
        # Words by the place of their key, so that what goes to one bucket lies together.
        place = np.append(chunk.by_code(np.arange(len(kinds))), -1)[codes]
        some = own < rare
        left = place[some] * 2 * width + width + before[some]
        right = place[:-1][some[:-1]] * 2 * width + own[1:][some[:-1]]
        cell = np.sort(np.concatenate((left, right)))
        edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
        n, cell = np.diff(np.append(edges, len(cell))), cell[edges]
        at = cell // (2 * width)
        numbers = np.full(len(kinds), -1, np.int64)
        numbers[kinds >= 0] = np.concatenate([p[1] for p in parts]) if parts else 0
        where = key_message(chunk.keys, buckets)[0][at].astype(np.int64)
        used, first = np.unique(where, return_index=True)
        rows = [pack((numbers[at[i:j]].astype(np.int32), (cell[i:j] % (2 * width)).astype(np.uint16), n[i:j].astype(np.int32)))
                for i, j in zip(first, np.append(first[1:], len(where)))]
        return pa.table({"bucket": pa.array([-1, *used.tolist()], pa.int64()), "chunk": pa.array([number] * (len(rows) + 1), pa.int64()),
                         "message": pa.array([pack(transitions), *rows], pa.binary())})

    return cut_lineage(by_chunk(chunks, answers, use, "bucket long, chunk long, message binary"))


def _transitions(counted: DataFrame, width: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            for m in batch.column("message"):
                total += unpack(m.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total)], ["cell", "n"])

    out = np.zeros(width * width)
    for r in counted.where("bucket = -1").select("message").mapInArrow(run, "cell long, n long").groupBy("cell") \
            .agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(width, width)


def best_classes(right: np.ndarray, left: np.ndarray, current: np.ndarray, n: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word under which its contexts are likeliest, its own counts left out of its class."""
    tiny = 0.1
    n = n + tiny
    out_of, into = n.sum(axis=1), n.sum(axis=0)
    total = right.sum(axis=1)
    after = right @ np.log(n[:classes] / out_of[:classes, None]).T
    before = left @ np.log(n[:, :classes] / out_of[:, None] / into[None, :classes])
    score = after + before
    # In its own class a word must not count for itself.
    rows = np.arange(len(current))
    r = np.maximum(n[current] - right, tiny)
    b = np.maximum(n[:, current].T - left, tiny)
    own = (right * np.log(r / np.maximum(out_of[current] - total, tiny * n.shape[0])[:, None])).sum(axis=1)
    own += (left * np.log(b / out_of[None, :] / np.maximum(into[current] - total, tiny)[:, None])).sum(axis=1)
    score[rows, current] = own
    return np.argmax(score, axis=1)


def _moved(state: DataFrame, counted: DataFrame, transitions: np.ndarray, classes: int, turn: int) -> DataFrame:
    """The state after a round of moves; in later rounds every other word stays."""
    width = len(transitions)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words, counts, kinds = _state(*(left.column(c)[0] for c in ("words", "counts", "kinds")))
        frequent = np.flatnonzero(kinds >= 0)
        seen = np.zeros(len(frequent) * 2 * width)
        for m in right.column("message"):
            number, kind, n = unpack(m.as_buffer())
            np.add.at(seen, number.astype(np.int64) * 2 * width + kind, n)
        seen = seen.reshape(len(frequent), 2, width)
        if len(frequent):
            own = kinds[frequent]
            best = best_classes(seen[:, 0], seen[:, 1], own, transitions, classes)
            if turn:
                best = np.where(mix(words[frequent]) % np.uint64(2) == np.uint64(turn % 2), own, best)
            kinds = kinds.copy()
            kinds[frequent] = best
        return _bucket(left.column("bucket")[0], words, counts, kinds)

    # Contexts only ever go to buckets that have frequent words.
    return cut_lineage(state.groupBy("bucket").cogroup(counted.where("bucket >= 0").groupBy("bucket")).applyInArrow(run, STATE))


def _sums(state: DataFrame, classes: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """All words' tokens and number, and by class those of the frequent words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(classes + 1, np.int64), np.zeros(classes + 1, np.int64)
        for batch in batches:
            for parts in zip(*(batch.column(c) for c in ("words", "counts", "kinds"))):
                _, n, kind = _state(*parts)
                np.add.at(tokens, kind, n)  # -1, the rare words, is the last place
                words += np.bincount(np.where(kind < 0, classes, kind), minlength=classes + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes + 1)), pa.array(tokens), pa.array(words)], ["k", "tokens", "words"])

    tokens, words = np.zeros(classes + 1, np.int64), np.zeros(classes + 1, np.int64)
    for r in state.select("words", "counts", "kinds").mapInArrow(run, "k long, tokens long, words long").groupBy("k") \
            .agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():
        tokens[r.k], words[r.k] = r.tokens, r.words
    return int(tokens.sum()), int(words.sum()), tokens[:-1].astype(float), words[:-1]


def fit(chunks: DataFrame, classes: int = 32, least: int = 10, rounds: int = 5, asked: DataFrame | None = None) -> ClassModel:
    """Class model of the training texts in ``chunks``; all counts cover all of them.

    Every word that occurs ``least`` times is clustered, however many those are. Without training texts the
    model is empty. What a round stores is removed by the next one.
    """
    spark = chunks.sparkSession
    buckets = word_buckets(spark)
    texts = chunks.mapInArrow(_count_texts, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    asked = asked_words(chunks, buckets) if asked is None else asked
    before: list[str] = []
    with recorded_scratch() as made:
        state = vocabulary(asked, classes, least)
    for turn in range(rounds + 1):
        with recorded_scratch() as counts:
            counted = contexts(chunks, _answered(asked, state, _say_class), buckets, classes + 2)
        transitions = _transitions(counted, classes + 2)
        if turn < rounds:
            before = list(made)
            with recorded_scratch() as made:
                state = _moved(state, counted, transitions, classes, turn)
            remove_scratch(spark, before)
        remove_scratch(spark, counts)
    tokens, words, class_tokens, class_words = _sums(state, classes)
    return ClassModel(tokens + texts, words + (texts > 0), texts, classes, transitions, class_tokens, class_words, state)


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [int((~unpack(p.as_buffer())[1]).sum()) for p in batch.column("payload")]
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])


def score(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for ``docs(doc_id, text, held_out)``.

    Texts that are not ``held_out`` (null counts as held out) train the model of ``fit``. Tokens are runs of
    anything but ASCII white space with A-Z in lower case, and one end for each text; a null text has only the
    end. ``score`` is the log10 probability of the text under the class model, ``base_score`` under single
    tokens with half a count added. A rare or unknown word gets its share of the rare class likewise.
    Repeated rows score alike; doc_id may have any type; other columns are not used.
    """
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(True)))
    chunks = chunks_of(docs)
    buckets = word_buckets(docs.sparkSession)
    asked = asked_words(chunks, buckets)
    model = fit(chunks, asked=asked, **settings)
    log_next, width, class_tokens = model.log_transitions(), model.width, model.class_tokens
    rare_tokens = model.tokens - model.texts - int(class_tokens.sum())
    rare_words = model.distinct - (model.texts > 0) - int(model.class_words.sum())
    n_texts, n_tokens, n_distinct = model.texts, model.tokens, model.distinct

    def use(payload, got: dict) -> Iterator[pa.Table]:
        chunk = _Chunk.of(payload)
        parts = got.get(0, [])
        kinds = chunk.by_code(np.concatenate([p[0] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64))
        count = np.append(chunk.by_code(np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)), n_texts)
        frequent = kinds >= 0
        kind = np.append(np.where(frequent, kinds, width - 2), width - 1)
        emit = np.zeros(len(count))
        emit[:-1] = np.log10((count[:-1] + 0.5) / (rare_tokens + 0.5 * (rare_words + 1)))
        emit[:-1][frequent] = np.log10(count[:-1][frequent] / class_tokens[kinds[frequent]])
        base = np.log10((count + 0.5) / (n_tokens + 0.5 * (n_distinct + 1)))
        codes = _with_ends(chunk.codes, chunk.starts, len(kinds))
        sizes = np.diff(chunk.starts) + 1
        doc = np.repeat(np.arange(len(sizes)), sizes)
        own = kind[codes]
        before = np.concatenate(([width - 1], own[:-1])).astype(np.int64)
        step = emit[codes] + log_next[before, own]
        total = lambda v: np.bincount(doc, weights=v, minlength=len(sizes))
        yield pa.table({
            "doc_id": chunk.doc_ids, "held_out": pa.array(chunk.held_out),
            "n_tokens": pa.array(sizes.astype(np.int64)),
            "n_known": pa.array(total(count[codes] > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(sizes), n_tokens, np.int64)),
            "base_score": pa.array(total(base[codes])), "score": pa.array(total(step))})

    schema = docs.select("doc_id").schema.add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long") \
        .add("train_tokens", "long").add("base_score", "double").add("score", "double")
    return with_answers(chunks, _answered(asked, model.vocabulary, _say_count), use, schema)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of each row of ``score``'s result, under the classes and under single tokens."""
    return scored.withColumns({
        "perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")),
        "base_perplexity": F.pow(F.lit(10.0), -F.col("base_score") / F.col("n_tokens"))})
