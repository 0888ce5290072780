"""Substring dedup by level-wise doubling: words inside a passage that also starts earlier are removed.

A passage of ``length`` words that occurs twice repeats each of its quarters and halves. Level one looks up
windows of a quarter of the length: of the quarters inside each passage only the one with the least hash,
which equal passages have at the same place, so that about an eighth of all windows is sent and no repeat
is lost. Windows that repeat are extended to twice their length, to the left and to the right, and looked up
again; passages around those that still repeat are looked up at full length, where the first one is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.common import (Words, answer, ask, ask_buckets, bucket_of, key_message, make_chunks, pieces,
                                  read_bits, seen_elsewhere, split_words, window_hashes, with_answers)

WORDS_PER_BATCH = 1_000_000
NULL_ID = -2**63


class _Level:
    """Positions at one length, their keys, and which of them repeat."""

    def __init__(self, positions: np.ndarray, hashes: np.ndarray, buckets: int):
        self.positions = positions
        self.keys, self.inverse, count = np.unique(hashes[positions], return_inverse=True, return_counts=True)
        self.here = count > 1
        self.where, self.columns = key_message(self.keys, buckets)

    def repeated(self, got: list) -> np.ndarray:
        return (self.here | read_bits(got, self.where))[self.inverse]


class _Chunk:
    """The windows of a chunk; every step is worked out again from the words and the answers so far."""

    def __init__(self, payload, length: int, buckets: int):
        self.doc_ids, self.text = payload[0], Words.unpacked(payload[1])
        self.codes, self.starts = self.text.codes, self.text.starts
        self.length, self.buckets = length, buckets
        hashes = self.text.hashes()
        words = hashes[self.codes] if len(self.codes) else np.empty(0, np.uint64)
        self.h = {n: window_hashes(words, n) for n in (length // 4, length // 2, length)}
        sizes = np.diff(self.starts)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        end = self.starts[1:][self.doc]
        at = np.arange(len(self.codes))
        self.windows = at[at + length <= end]
        self.end = end

    def quarters(self) -> _Level:
        """The quarter-length window with the least hash in each passage, the leftmost of equal ones."""
        h, n = self.h[self.length // 4], self.length - self.length // 4 + 1
        p = self.windows
        best, arg = h[p].copy(), p.copy()
        for i in range(1, n):
            other = h[p + i]
            less = other < best
            best[less] = other[less]
            arg[less] = p[less] + i
        self.least = arg
        return _Level(np.unique(arg), h, self.buckets)

    def halves(self, got: list) -> _Level:
        level = self.quarters()
        repeated = np.zeros(len(self.codes), bool)
        repeated[level.positions[level.repeated(got)]] = True
        keep = repeated[self.least]
        self.windows, self.least = self.windows[keep], self.least[keep]
        q = self.length // 4
        offset = self.least - self.windows
        self.right, self.left = offset <= 2 * q, offset >= q
        return _Level(np.unique(np.concatenate((self.least[self.right], self.least[self.left] - q))),
                      self.h[self.length // 2], self.buckets)

    def candidates(self, got: dict) -> None:
        """Leaves the passages all whose halves around their least quarter repeat."""
        level = self.halves(got.get(1, []))
        repeated = np.zeros(len(self.codes) + self.length, bool)
        repeated[level.positions[level.repeated(got.get(2, []))]] = True
        q = self.length // 4
        keep = (~self.right | repeated[self.least]) & (~self.left | repeated[self.least - q])
        self.windows = self.windows[keep]
        # Each distinct passage with its first place here: by document number, then by position.
        ids, place = self.doc_ids[self.doc[self.windows]], self.windows - self.starts[self.doc[self.windows]]
        hashes = self.h[self.length][self.windows]
        order = np.lexsort((place, ids, hashes))
        hashes, self.windows, ids, place = hashes[order], self.windows[order], ids[order], place[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        self.group = np.cumsum(new) - 1
        self.keys, self.ids, self.place = hashes[new], ids[new], place[new]
        self.first_here = (ids == self.ids[self.group]) & (place == self.place[self.group])

    def passages(self, got: dict) -> tuple[np.ndarray, list]:
        self.candidates(got)
        where, columns = key_message(self.keys, self.buckets)
        return where, [*columns, self.ids, self.place.astype(np.int32)]

    def removed(self, got: dict) -> np.ndarray:
        """Which words are in a passage that also starts earlier."""
        self.candidates(got)
        first = read_bits(got.get(3, []), bucket_of(self.keys, self.buckets))
        later = self.windows[~(self.first_here & first[self.group])]
        marks = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(marks, later, 1)
        np.add.at(marks, later + self.length, -1)
        return np.cumsum(marks[:-1]) > 0


def _first(asked: list) -> list:
    """For each message's keys, one bit each: no other message has the passage at an earlier place."""
    keys = np.concatenate([np.cumsum(m[0]) for m in asked])
    ids, place = np.concatenate([m[1] for m in asked]), np.concatenate([m[2] for m in asked])
    order = np.lexsort((place, ids, keys))
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    lead = order[new][np.cumsum(new) - 1]
    first = np.zeros(len(keys), bool)
    first[order] = (ids[order] == ids[lead]) & (place[order] == place[lead])
    return [np.packbits(part) for part in np.split(first, np.cumsum([len(m[0]) for m in asked])[:-1])]


def dedup(docs: DataFrame, length: int = 20) -> DataFrame:
    """``doc_id, n_words, removed, kept`` for each row of ``docs(doc_id, text, ...)``.

    Words are runs of anything but ASCII white space. A word is removed if one of the windows of ``length``
    words (a multiple of 4) that cover it also starts earlier: in a document with a smaller doc_id, or earlier
    in the same one. ``removed`` lists the spans of removed words as ``[start, end)``, ``kept`` is the other
    words joined by one space. A null text has no words. A null doc_id comes before all others. Rows that share
    a doc_id count as one document: a window that starts at the same word in both is earlier in neither.
    Other columns are not used.
    """
    if length % 4:
        raise ValueError("length has to be a multiple of 4")
    buckets = ask_buckets(docs.sparkSession)

    def build(batch: pa.RecordBatch):
        ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        return ids, split_words(batch.column("text"), lower=False).packed()

    def quarters(payload, _):
        level = _Chunk(payload, length, buckets).quarters()
        return level.where, level.columns

    def halves(payload, got: dict):
        level = _Chunk(payload, length, buckets).halves(got.get(1, []))
        return level.where, level.columns

    def passages(payload, got: dict):
        return _Chunk(payload, length, buckets).passages(got)

    def use(payload, got: dict) -> Iterator[pa.Table]:
        chunk = _Chunk(payload, length, buckets)
        gone, starts, vocab = chunk.removed(got), chunk.starts, chunk.text.vocab.to_pylist()
        for part in pieces(1 + np.diff(starts), WORDS_PER_BATCH):
            kept, spans, n = [], [], []
            for i in range(part.start, part.stop):
                low, high = starts[i], starts[i + 1]
                kept.append(" ".join([vocab[c] for c in chunk.codes[low:high][~gone[low:high]].tolist()]))
                own = np.diff(np.concatenate(([0], gone[low:high].view(np.int8), [0])))
                spans.append([{"start": int(a), "end": int(b)}
                              for a, b in zip(np.flatnonzero(own == 1), np.flatnonzero(own == -1))])
                n.append(int(high - low))
            ids = [None if x == NULL_ID else int(x) for x in chunk.doc_ids[part]]
            yield pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()),
                            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()),
                                                                           ("end", pa.int32())]))),
                            "kept": pa.array(kept, pa.string())})

    chunks = make_chunks(docs.select("doc_id", "text"), build).repartition("chunk")
    one = answer(ask(chunks, quarters, buckets), seen_elsewhere, 1)
    two = answer(ask(chunks, halves, buckets, one), seen_elsewhere, 2)
    three = answer(ask(chunks, passages, buckets, one.union(two)), _first, 3)
    return with_answers(chunks, one.union(two).union(three), use,
                        "doc_id long, n_words long, removed array<struct<start:int,end:int>>, kept string")


def digests(cleaned: DataFrame) -> DataFrame:
    """Numbers of words and of removed words, and the SHA-256 of the kept ones."""
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cleaned.select("doc_id", "n_words", n.alias("n_removed"),
                          F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
