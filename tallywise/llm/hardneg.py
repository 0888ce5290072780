"""Hard negatives by angular triangle filtering.

Components become integers, so that scores (inner products) are exact. Each row stores its angles to the nearest
of a set of reference directions. For an anchor at the angle ``s`` from a reference and a row at ``t``, the angle
between them lies in ``[|s - t|, s + t]``; the cosines of these bounds times both norms, widened for rounding,
bound the score. Blocks of rows that no window of a block of anchors can meet are not read for them, and inside
a block only the rows whose bounds meet an anchor's window get an integer score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywise.session import cut_lineage

#: Reference directions at most, and rows of the sample that they are chosen from.
REFERENCES, SAMPLE = 64, 2048
#: Angles that each row stores.
NEAR = 3
#: Rows and anchors of a block at most, about; anchors that are compared at a time.
BLOCK, ANCHORS, TILE = 16_384, 2_048, 64
#: Room for rounding in the bounds, as a share of the product of both norms.
SLACK = 1e-6


def directions(points: np.ndarray, most: int = REFERENCES) -> np.ndarray:
    """Rows of ``points`` as unit vectors, each the farthest from those before it; the first axis where there are none.

    A beginning of the list is a coarser set of references.
    """
    norm = np.linalg.norm(points, axis=1)
    unit = points[norm > 0] / norm[norm > 0, None]
    if not len(unit):
        return np.eye(1, points.shape[1])
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(most, len(unit)):
        i = int(np.argmin(nearest))
        if nearest[i] > 1 - 1e-9:
            break
        chosen.append(i)
        nearest = np.maximum(nearest, unit @ unit[i])
    return unit[chosen]


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def cosines(x: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of integer rows and their cosines to the references; 0 for a zero row, whose score is 0 with any."""
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    return norm, np.clip(x @ references.T / np.where(norm > 0, norm, 1)[:, None], -1, 1)


def inner(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = float(nx.max(initial=0)) * float(ny.max(initial=0))
    if most >= 2.0**62:
        raise ValueError("an inner product may not fit 63 bits")
    if most < 2.0**52:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def score_bounds(norm_a, cos_a, norm_v, near, cos_v) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of each anchor (rows) with each vector (columns), by the vectors' stored angles."""
    sin_a, sin_v = np.sqrt(1 - cos_a * cos_a), np.sqrt(1 - cos_v * cos_v)
    low, high = np.full((len(norm_a), len(norm_v)), -1.0), np.full((len(norm_a), len(norm_v)), 1.0)
    for k in range(near.shape[1]):
        straight, across = cos_a[:, near[:, k]] * cos_v[:, k], sin_a[:, near[:, k]] * sin_v[:, k]
        # cos(s + t) and cos(s - t); the first holds beyond pi too, where the angle is at most 2 pi - (s + t).
        low = np.maximum(low, straight - across)
        high = np.minimum(high, straight + across)
    size = norm_a[:, None] * norm_v[None, :]
    return (low - SLACK) * size - SLACK, (high + SLACK) * size + SLACK


def _numbered(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows that take part, with a number each and integer components."""
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    ints = F.transform(e, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & ~odd)
            .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "label",
                    ints.alias("ints"), F.size(e).alias("width")))


def _placed(rows: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray], dict[int, int]]:
    """Rows with their nearest references, the references, and how many of them make the coarse cells.

    References are fitted on a sample of about ``SAMPLE`` rows at most; vectors of a length that the sample lacks
    have the first axis. The coarse cells are as many as blocks would be, ``REFERENCES`` at most.
    """
    count = rows.count()
    mark = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    some = rows.where(mark < int((1 << 30) * min(1.0, 2 * SAMPLE / max(1, count)))).orderBy(mark, "row").limit(SAMPLE)
    by_width: dict[int, list] = {}
    for r in some.select("ints", "width").collect():
        by_width.setdefault(r.width, []).append(r.ints)
    references = {w: directions(np.array(x, np.float64).reshape(len(x), w)) for w, x in by_width.items()}
    coarse = min(REFERENCES, max(1, count * 4 // BLOCK))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for w in np.unique(widths).tolist():
                own = batch.filter(pa.array(widths == w))
                axes = axes_of(references, w)
                norm, cos = cosines(matrix(own.column("ints"), w), axes)
                order = np.argsort(-cos, axis=1, kind="stable")[:, :NEAR]
                cells = np.argmax(cos[:, :coarse], axis=1)
                ends = np.arange(len(own) + 1, dtype=np.int32) * order.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(norm), pa.ListArray.from_arrays(ends, pa.array(order.astype(np.int32).ravel())),
                     pa.ListArray.from_arrays(ends, pa.array(np.take_along_axis(cos, order, 1).ravel())),
                     pa.array(cells.astype(np.int32)), pa.array(np.arccos(np.take_along_axis(cos, cells[:, None], 1)[:, 0])),
                     ], [*own.schema.names, "norm", "near", "cosine", "cell", "angle"])

    schema = T.StructType([*rows.schema.fields, T.StructField("norm", T.DoubleType()),
                           T.StructField("near", T.ArrayType(T.IntegerType())),
                           T.StructField("cosine", T.ArrayType(T.DoubleType())),
                           T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    return cut_lineage(rows.mapInArrow(place, schema)), references, coarse


def axes_of(references: dict[int, np.ndarray], width: int) -> np.ndarray:
    return references.get(width, np.eye(1, width))


def _dealt(rows: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Rows with their part of the group ``keys``, each part of about ``size`` rows at most, and the number of parts."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{name}s"))
    return rows.join(parts, keys).withColumn(name, F.pmod(F.xxhash64("row"), F.col(f"{name}s")).cast("int"))


def _fresh(rows: DataFrame) -> DataFrame:
    """The same columns under ids of their own, for two sides that come from one table."""
    return rows.select(*(F.col(c).alias(c) for c in rows.columns))


def _best(wanted: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of ``wanted``: higher scores first, then smaller ids."""
    if len(wanted) > 4 * most:
        # Whatever is below the score at this place can't be among the first.
        least = np.partition(score[wanted], len(wanted) - most)[len(wanted) - most]
        wanted = wanted[score[wanted] >= least]
    return wanted[np.lexsort((ids[wanted], -score[wanted]))[:most]]


def _read(table: pa.Table, width: int) -> dict:
    near = matrix(table.column("near"), len(table.column("near")[0])) if table.num_rows else None
    return {"x": matrix(table.column("ints"), width), "norm": table.column("norm").to_numpy(),
            "row": table.column("row").to_numpy(), "id": table.column("vec_id").to_numpy(), "near": near,
            "cos": matrix(table.column("cosine"), near.shape[1])}


def _scored(a: dict, v: dict, wanted: np.ndarray, tile: slice) -> np.ndarray:
    """Scores of a tile of anchors with the vectors that any of them wants; nothing in other columns."""
    used = np.flatnonzero(wanted.any(axis=0))
    out = np.zeros(wanted.shape, np.int64)
    if len(used):
        out[:, used] = inner(a["x"][tile], v["x"][used], a["norm"][tile], v["norm"][used])
    return out


def _positives(placed: DataFrame, references: dict, every: int, most: int) -> DataFrame:
    """``row, positive_id, positive_score``: the first rows of each anchor's label but itself."""
    keys = ["width", "label"]
    anchors = _dealt(placed.where(F.col("vec_id") % every == 0), keys, ANCHORS, "block")
    blocks = anchors.select(*keys, "blocks").distinct()
    others = _dealt(placed, keys, BLOCK, "part").join(blocks, keys)
    parts = others.select(*keys, "parts").distinct()
    whole = F.sequence(F.lit(0), F.col("parts") - 1)
    anchors = anchors.join(parts, keys).withColumn("part", F.explode(whole)).drop("parts", "blocks")
    others = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("parts", "blocks")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            width = left.column("width")[0].as_py()
            a, v, axes = _read(left, width), _read(right, width), axes_of(references, width)
            cos = cosines(a["x"], axes)[1]
            for at in range(0, left.num_rows, TILE):
                tile = slice(at, at + TILE)
                low, high = score_bounds(a["norm"][tile], cos[tile], v["norm"], v["near"], v["cos"])
                own = a["row"][tile, None] == v["row"][None, :]
                low[own] = high[own] = -np.inf
                # At least `most` rows reach the highest of their lower bounds, if there are so many.
                k = len(v["row"]) - most
                least = np.partition(low, k, axis=1)[:, k] if k > 0 else np.full(len(low), -np.inf)
                wanted = (high >= least[:, None]) & ~own
                score = _scored(a, v, wanted, tile)
                for i in range(len(wanted)):
                    best = _best(np.flatnonzero(wanted[i]), score[i], v["id"], most)
                    for o, x in zip(out, (np.repeat(a["row"][at + i], len(best)), v["id"][best], score[i][best])):
                        o.append(x)
        return pa.table([pa.array(np.concatenate(o) if o else np.empty(0, np.int64), pa.int64()) for o in out],
                        ["row", "positive_id", "positive_score"])

    group = [*keys, "block", "part"]
    found = _fresh(anchors).groupBy(*group).cogroup(_fresh(others).groupBy(*group)).applyInArrow(
        run, "row long, positive_id long, positive_score long")
    return _first(found, ["row"], "positive_score", "positive_id", most)


def _first(rows: DataFrame, keys: list[str], score: str, tie: str, most: int, rank: str = "rank") -> DataFrame:
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))
    return rows.withColumn(rank, order).where(F.col(rank) <= most)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors(vec_id, embedding, label)``.

    Each component ``x`` becomes ``floor(scale * x)``. Anchors are the rows whose vec_id ``every`` divides; an
    anchor's positives are the first ``positives`` other rows of its label by score (higher first, then the
    smaller vec_id). For each of them come the first ``negatives`` rows of other labels whose score is at least
    ``low`` and at most ``high`` hundredths of the positive's; all where there are fewer.

    Rows with a null vec_id, label, vector or component, or with a component that is no finite number, take no
    part. Vectors of different lengths do not meet; a zero or empty vector scores 0 with all it meets. Every row
    counts for itself: repeated rows are positives or negatives of each other, and each row that shares an
    anchor's vec_id is an anchor. Labels may have any type that can be compared; other columns are not used. An
    inner product that may not fit 63 bits is an error.
    """
    placed, references, coarse = _placed(_numbered(vectors, scale))
    found = cut_lineage(_positives(placed, references, every, positives))
    # Windows that hold nothing (a positive below zero) are left out here.
    windows = found.where("positive_score >= 0").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"),
        (F.min("positive_score").cast("double") * low / 100).alias("least"),
        (F.max("positive_score").cast("double") * high / 100).alias("most"))
    anchors = cut_lineage(_dealt(placed.where(F.col("vec_id") % every == 0).join(windows, "row"),
                                 ["width", "cell"], ANCHORS, "block").withColumnRenamed("cell", "home")
                          .drop("angle", "blocks"))
    rows = _dealt(placed, ["width", "cell"], BLOCK, "part").drop("parts")
    met = cut_lineage(_met(anchors, rows, references, coarse))
    left = anchors.join(met, ["width", "home", "block"])
    right = rows.join(met, ["width", "cell", "part"])

    def run(a_table: pa.Table, v_table: pa.Table) -> pa.Table:
        out = [[] for _ in range(6)]
        if a_table.num_rows and v_table.num_rows:
            width = a_table.column("width")[0].as_py()
            a, v, axes = _read(a_table, width), _read(v_table, width), axes_of(references, width)
            cos, n = cosines(a["x"], axes)[1], a_table.num_rows
            labels = pa.chunked_array([*a_table.column("label").chunks, *v_table.column("label").chunks]) \
                .combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            least, most = a_table.column("least").to_numpy(), a_table.column("most").to_numpy()
            for at in range(0, n, TILE):
                tile = slice(at, at + TILE)
                bounds = score_bounds(a["norm"][tile], cos[tile], v["norm"], v["near"], v["cos"])
                wanted = ((bounds[1] >= least[tile, None]) & (bounds[0] <= most[tile, None])
                          & (labels[:n][tile, None] != labels[None, n:]))
                score = _scored(a, v, wanted, tile)
                for i, p in enumerate(a_table.column("positives")[at:at + TILE].to_pylist()):
                    some, s = np.flatnonzero(wanted[i]), score[i]
                    for one in p:
                        size = one["positive_score"]
                        good = some[(s[some] >= -(-low * size // 100)) & (s[some] <= high * size // 100)]
                        best = _best(good, s, v["id"], negatives)
                        for o, x in zip(out, (a["row"][at + i], a["id"][at + i], one["rank"], one["positive_id"], size)):
                            o.append(np.repeat(np.int64(x), len(best)))
                        out[5].append(np.stack((v["id"][best], s[best])))
        columns = [np.concatenate(o) if o else np.empty(0, np.int64) for o in out[:5]]
        last = np.concatenate(out[5], axis=1) if out[5] else np.empty((2, 0), np.int64)
        return pa.table([*(pa.array(c, pa.int64()) for c in (*columns, *last))],
                        ["row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    group = ["width", "home", "block", "cell", "part"]
    mined = _fresh(left).groupBy(*group).cogroup(_fresh(right).groupBy(*group)).applyInArrow(run, ", ".join(
        f"{c} long" for c in ("row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")))
    return _first(mined, ["row", "place"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
        "negative_score")


def _met(anchors: DataFrame, rows: DataFrame, references: dict, coarse: int) -> DataFrame:
    """Pairs of blocks, ``width, home, block, cell, part``, of which some window and some score may meet.

    One row a block on either side, joined by the cell: the angles of a block of anchors to the cell's reference
    and of the cell's rows to it bound every score between them.
    """
    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for w in np.unique(widths).tolist():
                own = batch.filter(pa.array(widths == w))
                to = np.arccos(cosines(matrix(own.column("ints"), w), axes_of(references, w)[:coarse])[1])
                ends = np.arange(len(own) + 1, dtype=np.int32) * to.shape[1]
                yield pa.RecordBatch.from_arrays([*own.drop_columns(["ints"]).columns,
                                                  pa.ListArray.from_arrays(ends, pa.array(to.ravel()))],
                                                 [*own.drop_columns(["ints"]).schema.names, "angles"])

    bare = anchors.select("width", "home", "block", "norm", "least", "most", "ints")
    schema = bare.drop("ints").schema.add("angles", T.ArrayType(T.DoubleType()))
    asking = bare.mapInArrow(angles, schema).select("*", F.posexplode("angles").alias("cell", "angle"))
    asking = asking.groupBy("width", "home", "block", "cell").agg(
        *_range("angle", "a"), *_range("norm", "na"), F.min("least").alias("least"), F.max("most").alias("most"))
    blocks = rows.groupBy("width", "cell", "part").agg(*_range("angle", "v"), *_range("norm", "nv"))
    both = asking.join(blocks, ["width", "cell"])
    c = F.col
    nearest = F.greatest(F.lit(0.0), c("a0") - c("v1"), c("v0") - c("a1"))
    farthest = F.least(F.lit(math.pi), c("a1") + c("v1"))
    top, bottom = F.cos(nearest) + SLACK, F.cos(farthest) - SLACK
    small, large = c("na0") * c("nv0"), c("na1") * c("nv1")

    def times(cosine: Column, if_positive: Column, if_negative: Column) -> Column:
        return cosine * F.when(cosine >= 0, if_positive).otherwise(if_negative)

    meets = (times(top, large, small) + SLACK >= c("least")) & (times(bottom, small, large) - SLACK <= c("most"))
    return both.where(meets).select("width", "home", "block", "cell", "part")


def _range(column: str, name: str) -> tuple[Column, Column]:
    return F.min(column).alias(f"{name}0"), F.max(column).alias(f"{name}1")
