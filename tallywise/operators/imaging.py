"""Dominant colours over pixel tables ``(image_id, r, g, b)``.

Pixels are first counted per colour, so an image never weighs more than its distinct colours. K-means goes through
its rounds in tasks that hold many images each; an image of very many colours is the work of all tasks instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallywise.functions.scalars import half_even
from tallywise.session import cut_lineage

RGB = ("r", "g", "b")
#: Rounds after which centres that still move are an error; the original stops there without one.
MOST_ROUNDS = 300
#: Colours of an image that one task goes through all rounds with, at most.
LOCAL_COLORS = 200_000
#: Colours that a task gets at a time, about.
TASK_COLORS = 100_000


def color_counts(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id", *RGB).agg(F.count(F.lit(1)).alias("n"))


def mean_color(pixels: DataFrame) -> DataFrame:
    """Average colour per image, cut to whole numbers."""
    return pixels.groupBy("image_id").agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in RGB])


def mode_color(pixels: DataFrame) -> DataFrame:
    """Most frequent colour per image, ties to the smallest (r, g, b); its count and all pixels."""
    packed = F.col("r").cast("bigint") * 65536 + F.col("g") * 256 + F.col("b")
    # Count first, smallest colour next, in one whole number: it stays in a hash table.
    best = F.max(F.col("n") * (1 << 24) + ((1 << 24) - 1 - packed))
    top = color_counts(pixels).groupBy("image_id").agg(best.alias("m"), F.sum("n").alias("n_pixels"))
    color = F.lit((1 << 24) - 1) - F.pmod(F.col("m"), F.lit(1 << 24))
    return top.select(
        "image_id", *[F.pmod(F.shiftright(color, bits), F.lit(256)).cast("int").alias(c) for c, bits in zip(RGB, (16, 8, 0))],
        F.shiftright("m", 24).alias("n"), "n_pixels")


def _nearest(k: int) -> Column:
    """The number of the nearest one of ``centers``, ties to the lower number."""
    def far(i: int):
        center = F.get("centers", F.lit(i))
        dist = sum((F.col(p) - center[p]) * (F.col(p) - center[p]) for p in RGB)
        return F.when(center.isNotNull(), F.struct(dist.alias("d"), F.lit(i).alias("cluster")))

    return (F.least(*[far(i) for i in range(k)]) if k > 1 else far(0))["cluster"]


def _assign(colors: DataFrame, centers: DataFrame, k: int) -> DataFrame:
    """Colours with the number of their nearest centre."""
    return colors.join(centers, "image_id").withColumn("cluster", _nearest(k))


def _moved(assigned: DataFrame, k: int) -> DataFrame:
    """Centres at the mean of their colours; one that lost all its colours stays where it was."""
    sums = []
    for i in range(k):
        mine = F.col("cluster") == i
        sums.append(F.sum(F.when(mine, F.col("n"))).alias(f"n{i}"))
        sums += [F.sum(F.when(mine, F.col(c).cast("bigint") * F.col("n"))).alias(f"{c}{i}") for c in RGB]
    per_image = assigned.groupBy("image_id").agg(F.any_value("centers").alias("old"), *sums)

    def center(i: int):
        old = F.get("old", F.lit(i))
        means = [F.try_divide(F.col(f"{c}{i}").cast("double"), F.col(f"n{i}").cast("double")) for c in RGB]
        return F.when(old.isNotNull(), F.struct(
            F.lit(i).alias("cluster"), *[F.coalesce(m, old[c]).alias(c) for m, c in zip(means, RGB)]))

    centers = F.filter(F.array(*[center(i) for i in range(k)]), lambda c: c.isNotNull())
    return per_image.select("image_id", centers.alias("centers"))


def _settled(colors: DataFrame, centers: DataFrame, k: int) -> DataFrame:
    """Rounds, each stored, until no centre of any image moves; an image whose centres stand still is left alone."""
    at = cut_lineage(centers.withColumn("moves", F.lit(True)))
    for _ in range(MOST_ROUNDS):
        moving = at.where("moves").drop("moves")
        moved = _moved(_assign(colors, moving, k), k).withColumnRenamed("centers", "new")
        # Centres are compared after a round as they were before it: equal ones stay equal.
        next_ = moving.join(moved, "image_id").select(
            "image_id", F.col("new").alias("centers"), (F.col("new") != F.col("centers")).alias("moves"))
        at = cut_lineage(at.where("NOT moves").unionByName(next_))
        if at.where("moves").isEmpty():
            return at.drop("moves")
    raise RuntimeError(f"centres still move after {MOST_ROUNDS} rounds")


def rest_of_images(image: np.ndarray, rgb: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Centres at rest, ``(images, k, 3)``, for colours ``rgb`` (NaN: null) of the images 0, 1, ... in that order.

    An image of fewer colours than ``k`` has infinite centres for the rest. Rounds go over the images that still move.
    """
    order = np.lexsort((*np.where(np.isnan(rgb), -np.inf, rgb).T[::-1], -n, image))
    image, rgb, n = image[order], rgb[order], n[order].astype(float)
    first = np.flatnonzero(np.append(True, image[1:] != image[:-1])) if len(image) else np.empty(0, int)
    rank = np.arange(len(image)) - np.repeat(first, np.diff(np.append(first, len(image))))
    centers = np.full((len(first), k, 3), np.inf)
    centers[image[rank < k], rank[rank < k]] = rgb[rank < k]
    known = ~np.isnan(rgb)
    for _ in range(MOST_ROUNDS):
        if not len(image):
            return centers
        best, cluster = np.full(len(image), np.inf), np.zeros(len(image), np.int64)
        for i in range(k):
            off = rgb - centers[image, i]
            far = off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1] + off[:, 2] * off[:, 2]
            far[np.isnan(far)] = -np.inf  # a null distance comes before all others
            nearer = far < best
            best[nearer], cluster[nearer] = far[nearer], i
        cell, size = image * k + cluster, len(first) * k
        total = np.bincount(cell, n, size)
        new = centers.reshape(size, 3).copy()
        for c in range(3):
            some = np.bincount(cell[known[:, c]], minlength=size) > 0
            new[some, c] = np.bincount(cell, np.where(known[:, c], rgb[:, c], 0) * n, size)[some] / total[some]
        new = new.reshape(centers.shape)
        moves = ((new != centers) & ~(np.isnan(new) & np.isnan(centers))).any(axis=(1, 2))
        centers, go = new, moves[image]
        image, rgb, n, known = image[go], rgb[go], n[go], known[go]
    if len(image):
        raise RuntimeError(f"centres still move after {MOST_ROUNDS} rounds")
    return centers


def _at_rest(colors: DataFrame, ks: Sequence[int]) -> DataFrame:
    """``image_id, k, centers`` at rest for the stored ``colors(image_id, r, g, b, n)``.

    Images of ``LOCAL_COLORS`` or fewer are dealt to tasks, each with all its colours; larger ones go by stored rounds.
    """
    sizes = cut_lineage(colors.groupBy("image_id").agg(F.count(F.lit(1)).alias("size")))
    total = sizes.agg(F.sum("size").alias("n")).first().n or 0
    large = sizes.where(F.col("size") > LOCAL_COLORS).select(F.col("image_id").alias("large"))
    some_large = not large.isEmpty()
    is_large = F.col("image_id").eqNullSafe(F.col("large"))
    here = colors.join(F.broadcast(large), is_large, "left_anti") if some_large else colors
    ks = list(ks)

    def run(table: pa.Table) -> pa.Table:
        images = table.column("image_id").combine_chunks().dictionary_encode("encode")
        image = images.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rgb = np.stack([table.column(c).cast(pa.float64()).to_numpy() for c in RGB], axis=1)
        parts = []
        for k in ks:
            centers = rest_of_images(image, rgb, table.column("n").to_numpy(), k)
            there = ~np.isinf(centers).any(axis=2)
            flat, numbers = centers[there], np.broadcast_to(np.arange(k), there.shape)[there]
            ends = np.append(0, np.cumsum(there.sum(axis=1)))
            entries = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), *(pa.array(v, mask=np.isnan(v)) for v in flat.T)],
                                                 ["cluster", *RGB])
            parts.append(pa.table({"image_id": images.dictionary, "k": pa.array([k] * len(centers), pa.int32()),
                                   "centers": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)}))
        return pa.concat_tables(parts)

    schema = T.StructType([T.StructField("image_id", colors.schema["image_id"].dataType),
                           *T._parse_datatype_string("k int, centers array<struct<cluster int, r double, g double, b double>>")])
    bucket = F.pmod(F.xxhash64("image_id"), F.lit(total // TASK_COLORS + 1))
    out = cut_lineage(here.groupBy(bucket).applyInArrow(run, schema))
    if some_large:
        each = colors.join(F.broadcast(large), is_large, "left_semi").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
        # An image and a number of colours stand for an image.
        keyed = cut_lineage(each.select(F.struct("image_id", "k").alias("image_id"), *RGB, "n"))
        slow = _settled(keyed, _first_centers(keyed, F.col("image_id.k")), max(ks))
        out = out.unionByName(slow.select("image_id.image_id", "image_id.k", "centers"))
    return out


def _first_centers(colors: DataFrame, k) -> DataFrame:
    """The ``k`` most frequent colours of each image; ``k`` a number or a column."""
    order = Window.partitionBy("image_id").orderBy(F.col("n").desc(), *RGB)
    start = F.struct(
        (F.row_number().over(order) - 1).alias("cluster"), *[F.col(c).cast("double").alias(c) for c in RGB])
    # Ranking keeps only the first k rows of each task; the lists hold k entries.
    return (colors.select("image_id", start.alias("s")).where(F.col("s.cluster") < k)
            .groupBy("image_id").agg(F.sort_array(F.collect_list("s")).alias("centers")))


def _flat(centers: DataFrame) -> DataFrame:
    return centers.select("image_id", F.explode("centers").alias("s")).select(
        "image_id", "s.cluster", *[F.col(f"s.{c}").alias(f"c{c}") for c in RGB])


def kmeans_colors(pixels: DataFrame, k: int = 5, iterations: int | None = None) -> tuple[DataFrame, DataFrame]:
    """K-means per image, all images at once: (centres, colours with their cluster).

    Starts from the ``k`` most frequent colours and goes on until no centre moves, or for ``iterations``
    rounds; a null image has none. Sums of whole numbers make the result the same in every run.
    """
    colors = cut_lineage(color_counts(pixels))
    if iterations is None:
        centers = _at_rest(colors.where("image_id IS NOT NULL"), [k]).drop("k")
    else:
        centers = _first_centers(colors, k)
        for _ in range(iterations):
            centers = _moved(_assign(colors, centers, k), k)
        centers = cut_lineage(centers)
    return _flat(centers), _assign(colors, centers, k).drop("centers")


def kmeans_palettes(pixels: DataFrame, ks: Sequence[int] = (5, 3, 1)) -> tuple[DataFrame, DataFrame]:
    """``kmeans_colors`` at rest for several numbers of colours; both tables have a column ``k``. A null image is one too."""
    colors = cut_lineage(color_counts(pixels))
    centers = _at_rest(colors, ks)
    each = centers.groupBy(F.col("image_id").alias("image")).agg(F.collect_list(F.struct("k", "centers")).alias("each"))
    assigned = colors.join(each, F.col("image_id").eqNullSafe(F.col("image"))).select(
        "image_id", *RGB, "n", F.explode("each").alias("s")).select("image_id", "s.k", *RGB, "n", "s.centers")
    flat = centers.select("image_id", "k", F.explode("centers").alias("s")).select(
        "image_id", "k", "s.cluster", *[F.col(f"s.{c}").alias(f"c{c}") for c in RGB])
    return flat, assigned.withColumn("cluster", _nearest(max(ks))).drop("centers")


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("image_id", "k") if c in df.columns]


def cluster_share(assigned: DataFrame) -> DataFrame:
    """Pixels per image and cluster and their share, rounded half-even to 2 places; per ``k`` too where there is one."""
    keys = _keys(assigned)
    per = assigned.groupBy(*keys, "cluster").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return per.withColumn("share", half_even(F.col("n") / total, 2))


def palette_strip(centers: DataFrame, shares: DataFrame, width: int = 300) -> DataFrame:
    """Strip of colours in cluster order; each is ``int(share * width + 1)`` pixels wide."""
    keys = _keys(shares)
    so_far = Window.partitionBy(*keys).orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    px = F.floor(F.col("share") * width + 1).cast("bigint")
    return (
        centers.join(shares, [*keys, "cluster"]).withColumn("width_px", px)
        .withColumn("start_px", F.coalesce(F.sum("width_px").over(so_far), F.lit(0)))
        .select(*keys, "cluster", *[F.floor(F.col(f"c{c}")).cast("int").alias(c) for c in RGB],
                "share", "start_px", "width_px")
    )


def even_palette(centers: DataFrame, width: int = 300) -> DataFrame:
    """Strip of equally wide colours."""
    k = F.count(F.lit(1)).over(Window.partitionBy("image_id"))
    edge = lambda i: F.floor(i * (F.lit(float(width)) / F.col("_k"))).cast("bigint")
    return centers.withColumn("_k", k).select(
        "image_id", "cluster", *[F.floor(F.col(f"c{c}")).cast("int").alias(c) for c in RGB],
        edge(F.col("cluster")).alias("start_px"), edge(F.col("cluster") + 1).alias("end_px"))
