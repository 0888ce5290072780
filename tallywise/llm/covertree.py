"""Embedding near-dedup: exact pairs above a cosine by a dual traversal of a cover tree.

Distances are angles, which are a metric. The tree's nodes are nested levels of centres with halving radii,
chosen from a bounded sample; every vector goes to the leaf of its nearest centre, and each node's covering
radius is measured over all vectors below it. Two nodes can hold a pair only if their centres are no farther
apart than both radii and the threshold together: the traversal starts at the root with itself and goes down
only where that holds. Vectors of the leaf pairs that are left are compared by blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywise.llm.common import components
from tallywise.session import cut_lineage

#: Room for rounding when bounds are compared, in radians.
SLACK = 1e-6


def unit_rows(vectors, width: int) -> np.ndarray:
    x = np.array(vectors, np.float64).reshape(-1, width)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


class CoverTree:
    """Nested centres: level ``i`` has the radius pi / 2^i, and each centre a parent on the level above."""

    def __init__(self, points: np.ndarray, levels: int):
        self.points = points
        far = angles(points, points)
        chosen, self.level, self.parent = [0], [0], [-1]
        for i in range(1, levels):
            above = list(range(len(chosen)))
            nearest = far[:, chosen].min(axis=1)
            for p in range(len(points)):
                if nearest[p] > math.pi / 2**i:
                    chosen.append(p)
                    self.level.append(i)
                    self.parent.append(above[int(np.argmin(far[p, [chosen[a] for a in above]]))])
                    nearest = np.minimum(nearest, far[:, p])
        self.centres = points[chosen]
        # Each node goes on, as its own child, down to the leaves: one leaf for each centre.
        self.paths = [self._path(n) for n in range(len(chosen))]

    def _path(self, node: int) -> list[int]:
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out

    def leaf_pairs(self, radius: np.ndarray, leaf_radius: np.ndarray, most: float) -> np.ndarray:
        """Which leaves can hold a pair at ``most`` or less, by the traversal of node pairs from the root.

        ``radius[n]`` covers all vectors below node ``n``, ``leaf_radius[n]`` those of its own leaf.
        """
        n = len(self.centres)
        between = angles(self.centres, self.centres)
        children: list[list[int]] = [[] for _ in range(n)]
        for c, p in enumerate(self.parent):
            if p >= 0:
                children[p].append(c)
        alive = np.zeros((n, n), bool)
        # A node stands for its whole tree; opened, it gives its own leaf and the trees of its children.
        a_tree, b_tree = np.array([0]), np.array([0])
        a_leaf, b_leaf = np.array([False]), np.array([False])
        while len(a_tree):
            ra = np.where(a_leaf, leaf_radius[a_tree], radius[a_tree])
            rb = np.where(b_leaf, leaf_radius[b_tree], radius[b_tree])
            keep = between[a_tree, b_tree] <= ra + rb + most + SLACK
            a_tree, b_tree, a_leaf, b_leaf = a_tree[keep], b_tree[keep], a_leaf[keep], b_leaf[keep]
            done = a_leaf & b_leaf
            alive[a_tree[done], b_tree[done]] = True
            nxt: list[tuple[int, bool, int, bool]] = []
            for a, al, b, bl in zip(*(v[~done].tolist() for v in (a_tree, a_leaf, b_tree, b_leaf))):
                lefts = [(a, True)] if al else [(a, True), *((c, False) for c in children[a])]
                rights = [(b, True)] if bl else [(b, True), *((c, False) for c in children[b])]
                nxt.extend((*x, *y) for x in lefts for y in rights)
            if not nxt:
                break
            a_tree, a_leaf, b_tree, b_leaf = (np.array(v) for v in zip(*nxt))
        return alive | alive.T


def _key(embedding: Column) -> Column:
    """128 bits of the components, of which -0 counts as 0."""
    plain = F.transform(embedding, lambda x: x + F.lit(0.0).cast("float"))
    return F.format_string("%016x%016x", F.xxhash64(plain), F.xxhash64(F.reverse(plain)))


def _links(x: np.ndarray, y: np.ndarray, lx: np.ndarray, ly: np.ndarray, alive: np.ndarray, cosine: float,
           same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs; leaf by leaf of ``x``, against the vectors of the leaves it can meet."""
    rows, cols = [], []
    for leaf in np.unique(lx):
        own, other = np.flatnonzero(lx == leaf), np.flatnonzero(alive[leaf][ly])
        if len(other):
            for at in range(0, len(own), 512):
                i, j = np.nonzero(x[own[at:at + 512]] @ y[other].T >= cosine)
                rows.append(own[at:at + 512][i])
                cols.append(other[j])
    i = np.concatenate(rows) if rows else np.empty(0, np.int64)
    j = np.concatenate(cols) if cols else np.empty(0, np.int64)
    return (i[i < j], j[i < j]) if same else (i, j)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each node's component, by spreading labels until none changes."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, sample: int = 1024, levels: int = 6,
                    block: int = 3000) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding, ...)``.

    Two rows link if the cosine of their vectors is ``cosine`` or more in double precision. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing; so do vectors of different
    lengths with each other. ``n_links`` counts other rows, ``component_id`` is the smallest vec_id reached
    (a null vec_id counts for none), ``kept`` says that it is the row's own. Equal vectors are compared once
    and counted as often as they occur. The tree is fitted on about ``sample`` distinct vectors, which bounds
    it; all vectors are put into it and none is left out of the comparison. Other columns are not used.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    number = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    valid = F.coalesce((F.size(e) > 0) & ~number & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(valid, _key(e)).alias("key"), F.when(valid, e).alias("embedding"))
    classes = cut_lineage(rows.where("key is not null").groupBy("key").agg(
        F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")))
    found = None
    for width, count in ((r.width, r["count"]) for r in classes.groupBy(F.size("embedding").alias("width"))
                         .count().orderBy("width").collect()):
        part = _compare(classes.where(F.size("embedding") == width), width, count, cosine, sample, levels, block)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "a string, b string, n long")
    found = cut_lineage(found)
    own = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    labelled = classes.select("key", "copies", "least").join(own.withColumnRenamed("node", "key"), "key", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "key"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    done = labelled.join(least, "component").join(counts, "key", "left").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(done, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _compare(classes: DataFrame, width: int, count: int, cosine: float, sample: int, levels: int,
             block: int) -> DataFrame:
    """Rows ``(a, null, links)`` and spanning edges ``(a, b, null)`` between the distinct vectors."""
    spark = classes.sparkSession
    # Keys are hashes, so those below a threshold are a fair sample.
    below = format(min((1 << 64) - 1, int((1 << 64) * min(1.0, sample / count))), "016x")
    chosen = classes.where(F.col("key") <= below + "g").orderBy("key").select("embedding").collect()
    if not chosen:
        chosen = classes.orderBy("key").select("embedding").limit(1).collect()
    tree = CoverTree(unit_rows([r.embedding for r in chosen], width), levels)
    centres, paths, most = tree.centres, tree.paths, math.acos(cosine)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit_rows(batch.column("embedding").flatten().to_numpy(zero_copy_only=False), width)
                leaf = np.argmax(x @ centres.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))],
                                                 [*batch.schema.names, "leaf"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius, own, n = (np.zeros(len(centres)) for _ in range(3))
        for batch in batches:
            if batch.num_rows:
                x = unit_rows(batch.column("embedding").flatten().to_numpy(zero_copy_only=False), width)
                leaf = batch.column("leaf").to_numpy()
                far = angles(x, centres)
                for i in np.unique(leaf):
                    members = far[leaf == i]
                    own[i] = max(own[i], members[:, i].max())
                    n[i] += len(members)
                    for node in paths[i]:
                        radius[node] = max(radius[node], members[:, node].max())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres))), pa.array(radius), pa.array(own),
                                          pa.array(n.astype(np.int64))], ["node", "radius", "own", "n"])

    placed = cut_lineage(classes.select("key", "copies", "embedding").mapInArrow(
        place, classes.select("key", "copies", "embedding").schema.add("leaf", T.IntegerType())))
    radius, own, sizes = (np.zeros(len(centres)) for _ in range(3))
    for r in placed.select("embedding", "leaf").mapInArrow(reach, "node long, radius double, own double, n long") \
            .groupBy("node").agg(F.max("radius").alias("radius"), F.max("own").alias("own"),
                                 F.sum("n").alias("n")).collect():
        radius[r.node], own[r.node], sizes[r.node] = r.radius, r.own, r.n
    alive = tree.leaf_pairs(radius, own, most)
    # Blocks of at most about `block` vectors: a large leaf is split by a hash, small ones are put together.
    order = sorted(range(len(centres)), key=lambda i: paths[i][::-1])
    first, parts, number, room = {}, {}, -1, 0
    for leaf in order:
        need = int(sizes[leaf])
        if need > block:
            first[leaf], parts[leaf] = number + 1, -(-need // block)
            number, room = number + parts[leaf], 0
        else:
            if need > room:
                number, room = number + 1, block
            first[leaf], parts[leaf] = number, 1
            room -= need
    leaves = spark.createDataFrame([(i, first[i], parts[i]) for i in order], "leaf int, first int, parts int")
    placed = placed.join(F.broadcast(leaves), "leaf").withColumn(
        "block", F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("first", "parts")
    blocks = leaves.select("leaf", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1))
                           .alias("block"))
    met = [(int(i), int(j)) for i, j in zip(*np.nonzero(alive)) if i <= j]
    pairs = spark.createDataFrame(met, "l int, r int")
    pairs = (pairs.join(blocks.select(F.col("leaf").alias("l"), F.col("block").alias("x")), "l")
             .join(blocks.select(F.col("leaf").alias("r"), F.col("block").alias("y")), "r")
             .select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).distinct())
    pairs = cut_lineage(pairs)
    cols = [F.col(c).alias(c) for c in ("p", "q", "key", "copies", "embedding", "leaf")]
    left = placed.join(pairs, F.col("block") == F.col("p")).select(*cols)
    right = placed.join(pairs.where("p < q"), F.col("block") == F.col("q")).select(*cols)

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        def read(t: pa.Table):
            x = unit_rows(t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), width)
            return x, t.column("leaf").to_numpy(), t.column("copies").to_numpy(), t.column("key").to_pylist()

        same = a.num_rows > 0 and a.column("p")[0] == a.column("q")[0]
        x, lx, cx, kx = read(a) if a.num_rows else (None, None, None, [])
        y, ly, cy, ky = (x, lx, cx, []) if same else read(b) if b.num_rows else (None, None, None, [])
        if x is None or y is None:
            return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()),
                             "n": pa.array([], pa.int64())})
        i, j = _links(x, y, lx, ly, alive, cosine, same)
        n, copies, keys = len(kx) + len(ky), np.concatenate((cx, cy)) if ky else cx, kx + ky
        j = j + len(kx) if ky else j
        links = np.zeros(n, np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        label = _forest(n, i, j)
        counted, joined = np.flatnonzero(links), np.flatnonzero(label != np.arange(n))
        return pa.table({
            "a": pa.array([keys[k] for k in counted] + [keys[k] for k in joined], pa.string()),
            "b": pa.array([None] * len(counted) + [keys[label[k]] for k in joined], pa.string()),
            "n": pa.array(links[counted].tolist() + [None] * len(joined), pa.int64())})

    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(
        compare, "a string, b string, n long")
