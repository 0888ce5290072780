"""N-gram Jaccard join with filters under several global token orders.

A token is a hash of an n-gram. Sets that overlap enough share a token among the first ones of each, whatever
the one order that both are put in. Three orders are used: tokens by hash, by hash from the end, and the
rarest first. First, sets are dropped that have too few of their first tokens in common with any other set;
tokens of the others meet under the third order, at positions that leave room for enough common ones, and a
pair is compared only if it also shares a first token under the two other orders.

Groups of copies are never taken apart into all pairs. The sets of a token's list are first compared with one
of them, then only sets that are not yet in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.llm.common import (CHUNK_SCHEMA, Words, answer, ask, ask_buckets, components, key_message,
                                  make_chunks, mix, pack, pieces, read_bits, seen_elsewhere, split_words,
                                  window_hashes, with_answers)
from tallywise.session import cut_lineage

TOKENS_PER_BATCH = 500_000
#: Text of a chunk; a task's hashes and orders take many times as much.
CHUNK_BYTES = 4 << 20


def _needed(n, percent: int):
    """The least overlap of a set of ``n`` with any set at ``percent`` or more."""
    return -(-n * percent // 100)


def _extra(n):
    """How many first tokens a pair is asked to share: 15 of 100, at least one."""
    return np.maximum(1, n * 15 // 100)


class _Sets:
    """The token sets of a chunk's documents, each in ascending order; equal sets are looked at once."""

    def __init__(self, words: Words, size: int, percent: int):
        hashes = words.hashes()
        flat = hashes[words.codes] if len(words.codes) else np.empty(0, np.uint64)
        starts, counts = words.starts, np.diff(words.starts)
        doc = np.repeat(np.arange(len(counts)), counts)
        at = np.flatnonzero(np.arange(len(flat)) + size <= starts[1:][doc])
        tokens, owner = [window_hashes(flat, size)[at]], [doc[at]]
        for n in range(1, size):  # a text with fewer words is one n-gram
            short = np.flatnonzero(counts == n)
            if len(short):
                tokens.append(mix(window_hashes(flat, n)[starts[short]] + np.uint64(n)))
                owner.append(short)
        token, owner = np.concatenate(tokens), np.concatenate(owner)
        order = np.lexsort((token, owner))
        token, owner = token[order], owner[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        self.token, self.owner = token[new], owner[new]
        self.size = np.bincount(self.owner, minlength=len(counts))
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.node = [xxhash.xxh3_128_digest(self.token[a:b].tobytes()) if b > a else None
                     for a, b in zip(self.start[:-1].tolist(), self.start[1:].tolist())]
        first: dict = {}
        self.lead = np.array([n is not None and first.setdefault(n, i) == i for i, n in enumerate(self.node)], bool)
        place = np.arange(len(self.token)) - self.start[self.owner]
        length = np.minimum(self.size, self.size - _needed(self.size, percent) + _extra(self.size))
        self.prefix = np.flatnonzero((place < length[self.owner]) & self.lead[self.owner])
        self.least = _extra(_needed(self.size, percent))
        self.keys, self.inverse, count = np.unique(self.token[self.prefix], return_inverse=True, return_counts=True)
        self.here = count > 1

    def may_link(self, got: list, where: np.ndarray) -> np.ndarray:
        shared = (self.here | read_bits(got, where))[self.inverse]
        counts = np.bincount(self.owner[self.prefix[shared]], minlength=len(self.size))
        return self.lead & (counts >= self.least)


def token_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, n, node, tokens``: the size and digest of each document's set, null where it is empty.

    ``tokens`` is null for sets that can't link with any different set. Of the first tokens under the hash
    order, 15 of 100 more than the least number for one common token, a set shares that many with each set
    that it links with; a look-up tells which tokens any other set has among its own first ones.
    """
    buckets = ask_buckets(docs.sparkSession)

    def build(batch: pa.RecordBatch):
        return batch.column("doc_id").to_pylist(), split_words(batch.column("text"), lower=True).packed()

    def messages(payload, _):
        return key_message(_Sets(Words.unpacked(payload[1]), size, percent).keys, buckets)

    def use(payload, got: dict) -> Iterator[pa.Table]:
        sets = _Sets(Words.unpacked(payload[1]), size, percent)
        linked = sets.may_link(got.get(0, []), key_message(sets.keys, buckets)[0])
        for part in pieces(1 + sets.size * linked, TOKENS_PER_BATCH):
            tokens = [sets.token[sets.start[i]:sets.start[i + 1]].view(np.int64) if linked[i] else None
                      for i in range(part.start, part.stop)]
            yield pa.table({"doc_id": pa.array(payload[0][part], pa.int64()),
                            "n": pa.array(sets.size[part].astype(np.int64)),
                            "node": pa.array(sets.node[part], pa.binary()),
                            "tokens": pa.array(tokens, pa.list_(pa.int64()))})

    chunks = make_chunks(docs.select("doc_id", "text"), build, CHUNK_BYTES).repartition("chunk")
    answers = answer(ask(chunks, messages, buckets), seen_elsewhere)
    return with_answers(chunks, answers, use, "doc_id long, n long, node binary, tokens array<long>")


def first_tokens(sets: DataFrame, percent: int) -> DataFrame:
    """``token, node, n, position, alone``: each set's first tokens, rarest first; ``alone`` is the share of its
    tokens that no other set has. Those hold a position but are not listed, as nothing meets them."""
    buckets = ask_buckets(sets.sparkSession)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            n = batch.column("n").to_numpy()
            for part in pieces(n, TOKENS_PER_BATCH):
                rows = batch.slice(part.start, part.stop - part.start)
                tokens = rows.column("tokens").flatten().to_numpy().view(np.uint64)
                payload = pack((rows.column("node").to_pylist(), rows.column("n").to_numpy().copy(), tokens))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([payload], pa.binary())],
                                                 ["chunk", "payload"])
                number += 1

    def messages(payload, _):
        keys, count = np.unique(payload[2], return_counts=True)
        where, columns = key_message(keys, buckets)
        return where, [*columns, np.minimum(count, 65535).astype(np.uint16)]

    def reply(asked: list) -> list:
        _, inverse = np.unique(np.concatenate([np.cumsum(k) for k, _ in asked]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([c for _, c in asked]))
        total = np.minimum(total, 65535).astype(np.uint16)[inverse]
        return np.split(total, np.cumsum([len(k) for k, _ in asked])[:-1])

    def use(payload, got: dict) -> Iterator[pa.Table]:
        node, n, tokens = payload
        _, inverse = np.unique(tokens, return_inverse=True)
        times = np.concatenate(got[0])[inverse]
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((tokens, times, owner))
        start = np.cumsum(n) - n
        position = np.arange(len(tokens)) - start[owner] + 1
        alone = np.bincount(owner[times == 1], minlength=len(n)) / n
        length = n - _needed(n, percent) + 1
        keep = (position <= length[owner]) & (times[order] > 1)
        who = owner[keep]
        yield pa.table({"token": pa.array(tokens[order][keep].view(np.int64)),
                        "node": pa.array([node[i] for i in who], pa.binary()), "n": pa.array(n[who]),
                        "position": pa.array(position[keep]), "alone": pa.array(alone[who])})

    chunks = sets.select("node", "n", "tokens").mapInArrow(gathered, CHUNK_SCHEMA).repartition("chunk")
    return with_answers(chunks, answer(ask(chunks, messages, buckets), reply), use,
                        "token long, node binary, n long, position long, alone double")


def _can_link(a: str, b: str, percent: int) -> Column:
    """Sets alike in size that have room for enough common tokens from a first one at these positions."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    left = 1 + F.least(n - F.col(f"{a}position"), m - F.col(f"{b}position"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * left >= percent * (n + m))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets overlap enough; counted only where first tokens meet in all orders."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(a, "a").join(b, "b")

    def first(tokens: str, n: str, last: bool) -> Column:
        length = (F.col(n) - F.ceil(F.col(n) * percent / 100) + 1).cast("int")
        return F.slice(tokens, -length if last else F.lit(1), length)

    for last in (False, True):
        both = both.where(F.arrays_overlap(first("ta", "na", last), first("tb", "nb", last)))
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _other_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of a token's list whose sets are in different components and alike in size.

    Every such pair has a set outside the component that most of the list is in; only those are joined with
    the list, so that a group of copies does not meet itself.
    """
    sizes = lists.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("token").agg(F.max(F.struct("c", "component"))["component"].alias("main"),
                                      F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    own = [F.col(c).alias(f"x{c}") for c in ("node", "n", "position", "component")]
    few = lists.join(main, "token").where("component <> main").select("token", *own)
    met = lists.join(few, "token").where((F.col("component") != F.col("xcomponent")) & _can_link("", "x", percent))
    return met.select(F.least("node", "xnode").alias("a"), F.greatest("node", "xnode").alias("b")).distinct()


def _led_pairs(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each set of a token's list with one set of the list.

    In the first turn with the one that has the fewest tokens alone: what copies were made from is closer to
    them than they are to one another. In later turns with any one.
    """
    rank = F.col("alone") if turn == 0 else F.xxhash64("node", "token", F.lit(turn)).cast("double")
    lead = lists.groupBy("token").agg(F.min(F.struct(rank.alias("r"), "node", "n", "position", "component")).alias("l"))
    met = lists.join(lead, "token").where((F.col("component") != F.col("l.component")) & _can_link("", "l.", percent))
    return met.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, turns: int = 1) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text, ...)``.

    Words are runs of anything but ASCII white space with A-Z in lower case; a document's set holds its
    distinct ``size``-word n-grams, one n-gram if it has fewer words, none without words or text. Documents
    link if ``percent`` of the union of their sets or more is common; empty sets link with nothing.
    ``component_id`` is the smallest doc_id reached by links, itself included; a null doc_id counts for none.
    Rows that repeat, or share a doc_id, each give their row. N-grams are compared by 64-bit hashes, equal sets
    by a 128-bit one. Other columns are not used.
    """
    rows = cut_lineage(token_sets(docs, size, percent))
    sets = cut_lineage(rows.where("tokens is not null").select("node", "n", "tokens").dropDuplicates(["node"]))
    first = cut_lineage(first_tokens(sets, percent))
    lists = first.withColumn("component", F.col("node"))
    links = labels = None
    for turn in range(turns + 1):
        pairs = cut_lineage(_led_pairs(lists, turn, percent) if turn < turns else _other_pairs(lists, percent))
        found = verified(pairs, sets, percent)
        links = cut_lineage(found if links is None else links.union(found))
        labels = components(links)
        lists = first.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    marked = rows.select("doc_id", "n", "node").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = marked.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return marked.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
