"""BPE encoding and decoding by a table of distinct words.

Texts are split into words and every distinct word of the corpus is encoded once. White space ends a
pre-token of the tokenizer and is dropped by it, so the ids of a text are those of its words in turn;
they are joined back by each word's position. Decoding joins ids with the id-to-piece table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.common import (Words, answer, ask, ask_buckets, bucket_of, make_chunks, pieces, ragged,
                                  split_words, with_answers)

#: Words sent out by one Arrow batch, which bounds what the JVM holds at once.
WORDS_PER_BATCH = 200_000


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16) if not len(x) or x.max() < 1 << 16 else x


def _order(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    where = bucket_of(hashes, buckets)
    order = np.argsort(where, kind="stable")
    return order, where[order]


def encode(docs: DataFrame, tokenizer: str, chunk_bytes: int = 12 << 20) -> DataFrame:
    """``doc_id, ids, decoded`` for each row of ``docs(doc_id, text, ...)``.

    ``tokenizer`` is the JSON text of a tokenizer of the tokenizers library whose pre-tokens end at white
    space and which drops white space. ``ids`` are those of the whole text without added special tokens;
    the strings of special tokens in a text become their ids. ``decoded`` is the pieces joined by one space,
    as a tokenizer without decoder writes them. A null or empty text has no ids and decodes to "". Rows
    that repeat, or share a doc_id, each give their row; other columns are not used. A task holds ``chunk_bytes``
    of text at a time; smaller chunks need less memory and send more words, as each sends its distinct words.
    """
    spark = docs.sparkSession
    buckets = ask_buckets(spark)
    words_of = {}

    def build(batch: pa.RecordBatch):
        return batch.column("doc_id").to_pylist(), split_words(batch.column("text"), lower=False).packed()

    def messages(payload, _):
        words = Words.unpacked(payload[1])
        order, where = _order(words.hashes(), buckets)
        return where, [words.vocab.take(pa.array(order)).to_pylist()]

    def reply(asked: list) -> list:
        from tokenizers import Tokenizer

        if tokenizer not in words_of:
            words_of.clear()
            words_of[tokenizer] = Tokenizer.from_str(tokenizer)
        encoder, known = words_of[tokenizer].encode, {}
        for (words,) in asked:
            for w in words:
                if w not in known:
                    known[w] = np.array(encoder(w, add_special_tokens=False).ids, np.int32)
        out = []
        for (words,) in asked:
            ids = [known[w] for w in words]
            out.append((_narrow(np.array([len(x) for x in ids], np.int32)), _narrow(np.concatenate(ids))))
        return out

    table = pieces_table(tokenizer)

    def use(payload, answers: dict) -> Iterator[pa.Table]:
        doc_ids, words = payload[0], Words.unpacked(payload[1])
        codes, starts = words.codes, words.starts
        got = answers.get(0)
        order, _ = _order(words.hashes(), buckets)
        sizes, first = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        flat = np.concatenate([g[1] for g in got]).astype(np.int32) if got else np.empty(0, np.int32)
        sizes[order] = np.concatenate([g[0] for g in got]) if got else 0
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        # The join of ids with the id-to-piece table, for each distinct word.
        text = [" ".join([table[i] for i in flat[a:a + n]]) for a, n in zip(first.tolist(), sizes.tolist())]
        for part in pieces(1 + np.diff(starts), WORDS_PER_BATCH):
            low, high = starts[part.start], starts[part.stop]
            own = codes[low:high]
            n = sizes[own]
            ends = np.concatenate(([0], np.cumsum(n)))[starts[part.start:part.stop + 1] - low]
            decoded = []
            for i in range(part.start, part.stop):
                c = codes[starts[i]:starts[i + 1]]
                decoded.append(" ".join([text[k] for k in c[sizes[c] > 0].tolist()]))
            ids = flat[ragged(first[own], n)]
            yield pa.table({"doc_id": pa.array(doc_ids[part], pa.int64()),
                            "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                            "decoded": pa.array(decoded, pa.string())})

    chunks = make_chunks(docs.select("doc_id", "text"), build, chunk_bytes).repartition("chunk")
    answers = answer(ask(chunks, messages, buckets), reply)
    return with_answers(chunks, answers, use, "doc_id long, ids array<int>, decoded string")


def pieces_table(tokenizer: str) -> list[str]:
    """The piece of each id; as long as the vocabulary, which is fixed by the tokenizer's file."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer)
    pieces_by_id = {i: p for p, i in t.get_vocab(with_added_tokens=True).items()}
    return [pieces_by_id.get(i, "") for i in range(max(pieces_by_id) + 1)]


def decode(ids: DataFrame, tokenizer: str, separator: str = " ") -> DataFrame:
    """``doc_id, decoded`` of ``ids(doc_id, ids)`` by a join of each id with the id-to-piece table.

    doc_id has to be unique. Null or empty ids decode to "".
    """
    spark = ids.sparkSession
    table = spark.createDataFrame(list(enumerate(pieces_table(tokenizer))), "id int, piece string")
    placed = ids.select("doc_id", F.posexplode("ids").alias("position", "id")).join(table, "id")
    texts = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("p"))
    texts = texts.select("doc_id", F.concat_ws(separator, F.col("p.piece")).alias("decoded"))
    return ids.select("doc_id").join(texts, "doc_id", "left").fillna("", ["decoded"])


def digests(encoded: DataFrame) -> DataFrame:
    """Length and SHA-256 digests of the ids (decimal, joined by one space) and of the decoded text."""
    written = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
