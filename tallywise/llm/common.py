"""What the operators of this subpackage share: words, packed look-ups between chunks and buckets, components."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.session import cut_lineage, scratch_path

def own_names(*names: str) -> list[str]:
    """Column names that no table has, for what an operator adds on its way."""
    mark = uuid.uuid4().hex[:12]
    return [f"{n}_{mark}" for n in names]


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK_SCHEMA = "chunk long, payload binary"


# ---------------------------------------------------------------- words

class Words:
    """The words of a batch of texts: ``codes`` into ``vocab``, text ``i`` at ``starts[i]:starts[i + 1]``."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, vocab: pa.Array):
        self.codes, self.starts, self.vocab = codes, starts, vocab

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each entry of ``vocab``."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocab.to_pylist()), np.uint64, len(self.vocab))

    def packed(self) -> tuple:
        """For ``pack``: frequent words have small codes, and the codes' bytes lie in planes, which press well."""
        order = np.argsort(-np.bincount(self.codes, minlength=len(self.vocab)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        planes = rank[self.codes].astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
        vocab = self.vocab.take(pa.array(order)).cast(pa.large_binary())
        sizes = pc.binary_length(vocab).to_numpy(zero_copy_only=False).astype(np.int32)
        return planes, np.diff(self.starts).astype(np.int32), sizes, b"".join(vocab.to_pylist())

    @classmethod
    def unpacked(cls, parts: tuple) -> Words:
        planes, counts, sizes, data = parts
        codes = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()
        offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        vocab = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return cls(codes, np.concatenate(([0], np.cumsum(counts, dtype=np.int64))), vocab)


def split_words(text: pa.Array, lower: bool) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased if asked for; a null text has none."""
    # No cast here: the lower-casing of pyarrow 23 misreads a slice that was cast to large_string.
    text = pc.fill_null(text, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    offsets = parts.offsets.to_numpy()
    coded = parts.values.dictionary_encode()
    codes, vocab = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.index(vocab, pa.scalar("", vocab.type)).as_py()
    if empty >= 0:
        full = codes != empty
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
        codes = codes[full]
    return Words(codes.astype(np.int32), offsets.astype(np.int64), vocab)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive entries; built by doubling, so that 20 takes five steps and not twenty."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, length, have = None, 0, hashes
    step = 1
    while step <= size:
        if size & step:
            part = have[length:length + n]
            out = part if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
            length += step
        step *= 2
        if step <= size:
            half = step // 2
            have = mix(have[:-half] * np.uint64(0xD6E8FEB86659FD93) + have[half:])
    return out


# ---------------------------------------------------------------- chunks and packed look-ups

def pack(value: object, level: int = 1) -> bytes:
    raw = pickle.dumps(value, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unpack(data: bytes) -> object:
    return pickle.loads(pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd"))


def _release() -> None:
    """Hand back what Arrow's pool keeps of freed buffers: a worker lives on, and its next task seldom needs them."""
    pa.default_memory_pool().release_unused()


def make_chunks(docs: DataFrame, build: Callable[[pa.RecordBatch], object], most_bytes: int = 12 << 20) -> DataFrame:
    """``(chunk, payload)``: a row for each run of rows in an Arrow batch of ``docs`` with ``most_bytes`` of text.

    A longer text is a chunk of its own. A chunk's number follows from its place in the input, so a task that
    runs again gives the same chunks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for part in pieces(64 + sizes.astype(np.int64), most_bytes):
                payload = pack(build(batch.slice(part.start, part.stop - part.start)), 3)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([payload], pa.binary())],
                                                 ["chunk", "payload"])
                number += 1
            _release()

    return docs.mapInArrow(run, CHUNK_SCHEMA)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys in order of size go to buckets in order of number."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def ask_buckets(spark: SparkSession) -> int:
    """Buckets of a look-up: four for each shuffle partition, which the user sizes to the data."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def ask(chunks: DataFrame, messages: Callable[[object, dict], tuple[np.ndarray, list]], buckets: int,
        answers: DataFrame | None = None) -> DataFrame:
    """Rows ``(bucket, chunk, message)``: what each chunk sends to the buckets.

    ``messages(payload, earlier answers)`` gives each key's bucket in ascending order and the columns (arrays,
    or lists) that go with the keys. A chunk sends a key once at most, so a bucket holds one entry for each
    chunk and key however often the key occurs: a key that a third of all rows share is as light as any other.
    """
    def sent(chunk: int, payload: bytes, got: dict) -> pa.Table:
        where, columns = messages(unpack(payload), got)
        used, first = np.unique(where, return_index=True)
        ends = np.append(first[1:], len(where))
        return pa.table({
            "bucket": pa.array(used.astype(np.int64)), "chunk": pa.array([chunk] * len(used), pa.int64()),
            "message": pa.array([pack([c[i:j] for c in columns]) for i, j in zip(first, ends)], pa.binary())})

    schema = "bucket long, chunk long, message binary"
    if answers is not None:
        return _cogroup(chunks, answers, lambda chunk, payload, got: sent(chunk, payload, got), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload")):
                yield from sent(chunk, payload.as_buffer(), {}).to_batches(max_chunksize=256)
            _release()

    return chunks.mapInArrow(run, schema)


def answer(asked: DataFrame, reply: Callable[[list], list], level: int = 0) -> DataFrame:
    """Rows ``(chunk, level, bucket, message)``: ``reply`` gets a bucket's messages and answers each of them."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        answers = reply([unpack(m.as_buffer()) for m in table.column("message")])
        _release()
        return pa.table({"chunk": table.column("chunk"), "level": pa.array([level] * table.num_rows, pa.int32()),
                         "bucket": table.column("bucket"),
                         "message": pa.array([pack(a) for a in answers], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "chunk long, level int, bucket long, message binary")


def with_answers(chunks: DataFrame, answers: DataFrame, use: Callable[[object, dict], Iterator[pa.Table]],
                 schema: str) -> DataFrame:
    """``use(payload, {level: answers in order of their buckets})`` for each chunk, in pieces."""
    return _cogroup(chunks, answers, lambda chunk, payload, got: pa.concat_tables(use(unpack(payload), got)), schema)


def by_chunk(chunks: DataFrame, answers: DataFrame, use: Callable[[int, object, dict], pa.Table], schema) -> DataFrame:
    """``use(chunk, packed payload, {level: answers in order of their buckets})`` for each chunk."""
    return _cogroup(chunks, answers, use, schema)


def stored_in_buckets(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` written to the shared folder, dealt by ``key``: what groups or joins by it need not move them again."""
    spark = rows.sparkSession
    name = f"stored_{uuid.uuid4().hex}"
    rows.repartition(key).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option(
        "path", scratch_path(spark, "stored")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files are external, and `table` knows them
    return table


def _cogroup(chunks: DataFrame, answers: DataFrame, fn: Callable, schema: str) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[int, list] = {}
        for level, m in zip(right.sort_by("bucket").column("level").to_pylist(),
                            right.sort_by("bucket").column("message")):
            got.setdefault(level, []).append(unpack(m.as_buffer()))
        (row,) = zip(left.column("chunk").to_pylist(), left.column("payload"))
        made = fn(row[0], row[1].as_buffer(), got)
        _release()
        return made

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def seen_elsewhere(asked: list) -> list:
    """For each message's keys, one bit each: another message has the key too."""
    keys = np.concatenate([np.cumsum(m[0]) for m in asked])
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    ends = np.cumsum([len(m[0]) for m in asked])
    return [np.packbits(part) for part in np.split(shared, ends[:-1])]


def key_message(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list]:
    """Ascending distinct keys, sent as differences within their bucket."""
    where = bucket_of(keys, buckets)
    first = np.ones(len(keys), bool)
    first[1:] = where[1:] != where[:-1]
    return where, [np.where(first, keys, np.diff(keys, prepend=np.uint64(0)))]


def read_bits(got: list, where: np.ndarray) -> np.ndarray:
    """The answers of ``seen_elsewhere`` and the like, in the order of the keys."""
    sizes = np.unique(where, return_counts=True)[1]
    if not len(sizes):
        return np.empty(0, bool)
    return np.concatenate([np.unpackbits(g, count=n) for g, n in zip(got, sizes)]).astype(bool)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + sizes[i] - 1`` one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def pieces(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Cut rows into runs of at most about ``most`` in weight."""
    ends = np.cumsum(weights)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


# ---------------------------------------------------------------- splits, joins, components

def remainder(column, divisor: int):
    """``crc32`` of the value as text, modulo ``divisor``; null counts as the text of length 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of the nodes in ``edges(a, b)``; the component is its smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014), in which no step puts a node's
    neighbours in one task: both only take the least neighbour of each node, an aggregate with map-side
    combine, and join it back. Each round is stored in the shared folder.
    """
    spark = edges.sparkSession
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct())
    state = None
    for _ in range(most_rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut_lineage(small.where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components: not done after {most_rounds} rounds")
    labels = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return spark.createDataFrame([], labels.schema).union(labels.union(roots).groupBy("node")
                                                          .agg(F.min("component").alias("component")))
