"""Text boxes from detector cells: decode, suppress overlaps, scale back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.session import cut_lineage

BOX = ("start_x", "start_y", "end_x", "end_y")
#: Boxes of a frame that one task decides alone, at most.
LOCAL_BOXES = 1_500
#: Boxes that a task gets at a time, about.
TASK_BOXES = 100_000


def decode_boxes(cells: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Boxes of the cells that score at least ``min_score``; corners are cut toward 0."""
    off_x, off_y = F.col("col") * 4.0, F.col("row") * 4.0
    cos, sin = F.cos("angle"), F.sin("angle")
    end_x = (off_x + cos * F.col("d1") + sin * F.col("d2")).cast("int")
    end_y = (off_y - sin * F.col("d1") + cos * F.col("d2")).cast("int")
    return cells.filter(F.col("score") >= min_score).withColumns({"end_x": end_x, "end_y": end_y}).select(
        "frame_id", "row", "col", "score",
        (F.col("end_x") - (F.col("d1") + F.col("d3"))).cast("int").alias("start_x"),
        (F.col("end_y") - (F.col("d0") + F.col("d2"))).cast("int").alias("start_y"),
        "end_x", "end_y",
    )


def rescale_boxes(boxes: DataFrame, ratio_x: float, ratio_y: float) -> DataFrame:
    return boxes.withColumns({
        c: (F.col(c) * (ratio_x if c.endswith("x") else ratio_y)).cast("int") for c in BOX})


def _area(prefix: str = "") -> Column:
    side = lambda c: (F.col(f"{prefix}end_{c}") - F.col(f"{prefix}start_{c}") + 1).cast("double")
    return side("x") * side("y")


def _covered(boxes: DataFrame, overlap: float) -> DataFrame:
    """``frame_id, a, b``: places of boxes of which ``a`` comes before ``b`` and covers more than ``overlap`` of it.

    Boxes meet by the cells of grids whose cells are as wide as powers of two. A box lies in the grid of its own
    size, where it touches four cells at most, and looks for larger boxes in the coarser grids that its frame uses.
    """
    size = F.greatest(F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y"), F.lit(0)) + 1
    sized = cut_lineage(boxes.withColumn("level", F.ceil(F.log2(size)).cast("int")))
    used = sized.select("frame_id", F.col("level").alias("grid")).distinct()

    def cells(df: DataFrame, name: str) -> DataFrame:
        out = df
        for c in "xy":
            cell = lambda e: F.floor(F.col(f"{e}_{c}") / F.pow(F.lit(2.0), F.col("grid"))).cast("long")  # noqa: B023, E731
            out = out.withColumn(f"cell_{c}", F.explode(F.sequence(F.least(cell("start"), cell("end")), cell("end"))))
        return out.select("frame_id", "grid", "cell_x", "cell_y", *(F.col(c).alias(f"{name}_{c}") for c in ("level", "place", *BOX)))

    large = cells(sized.withColumn("grid", F.col("level")), "p")
    small = cells(sized.join(used, "frame_id").where("grid >= level"), "q")
    pairs = large.join(small, ["frame_id", "grid", "cell_x", "cell_y"]).where(
        "p_level > q_level OR p_place < q_place")  # boxes of one size find each other twice
    wide, high = (F.least(f"p_end_{c}", f"q_end_{c}") - F.greatest(f"p_start_{c}", f"q_start_{c}") + 1 for c in "xy")
    shared = F.greatest(wide, F.lit(0)).cast("double") * F.greatest(high, F.lit(0)).cast("double")
    first = F.col("p_place") < F.col("q_place")
    covered = shared / F.when(first, _area("q_")).otherwise(_area("p_"))
    return pairs.where(covered > overlap).select(
        "frame_id", F.least("p_place", "q_place").alias("a"), F.greatest("p_place", "q_place").alias("b")).distinct()


def kept_boxes(frame: np.ndarray, box: np.ndarray, score: np.ndarray, known: np.ndarray, overlap: float) -> np.ndarray:
    """The numbers of the boxes that suppression keeps, for ``overlap`` of 0 or more; each round keeps one box a frame.

    ``box`` has NaN for null corners; scores that are not ``known`` are null and come first in order.
    """
    corners = np.where(np.isnan(box), -np.inf, box).T[::-1]
    # Of equal boxes the best score: the greatest, NaN above all, null below all.
    rows = np.lexsort((-score, ~np.isnan(score), ~known, *corners, frame))
    same = (frame[rows[1:]] == frame[rows[:-1]]) & (corners.T[rows[1:]] == corners.T[rows[:-1]]).all(axis=1)
    rows = rows[np.append(True, ~same)[:len(rows)]]
    rows = rows[np.lexsort((*corners[:, rows], -score[rows], known[rows], frame[rows]))]
    frame, box = frame[rows], box[rows]
    area = (box[:, 2] - box[:, 0] + 1) * (box[:, 3] - box[:, 1] + 1)
    top = np.append(True, frame[1:] != frame[:-1])[:len(rows)]
    kept = [rows[np.isnan(area) | (top & (area == 0))]]
    rest = ~np.isnan(area) & (area != 0)
    rows, frame, box, area = rows[rest], frame[rest], box[rest], area[rest]
    while len(rows):
        first = np.flatnonzero(np.append(True, frame[1:] != frame[:-1]))
        kept.append(rows[first])
        best = box[np.repeat(first, np.diff(np.append(first, len(rows))))]
        wide, high = (np.minimum(best[:, c + 2], box[:, c + 2]) - np.maximum(best[:, c], box[:, c]) + 1 for c in (0, 1))
        left = np.maximum(wide, 0) * np.maximum(high, 0) / area <= overlap
        left[first] = False
        rows, frame, box, area = rows[left], frame[left], box[left], area[left]
    return np.concatenate(kept)


def nms_boxes(boxes: DataFrame, overlap: float = 0.3) -> DataFrame:
    """Non-maximum suppression per frame: boxes in order of score, each dropped if a kept one covers it.

    A box goes if an earlier kept one covers more than ``overlap`` of it; earlier has the higher score, or the
    smaller corners. Equal boxes are merged to their best score first. A box without area goes unless it is its
    frame's first; the boxes of a null frame stay. Frames of ``LOCAL_BOXES`` or fewer are dealt to tasks, each with
    all its boxes; a larger one is the work of many tasks.
    """
    stored = cut_lineage(boxes.select("frame_id", *BOX, "score"))
    sizes = cut_lineage(stored.groupBy("frame_id").agg(F.count(F.lit(1)).alias("size")))
    total = sizes.agg(F.sum("size").alias("n")).first().n or 0
    most = LOCAL_BOXES if overlap >= 0 else 0
    # A null frame's boxes cover nothing, as it equals no frame.
    large = sizes.where(F.col("frame_id").isNull() | (F.col("size") > most)).select(F.col("frame_id").alias("large"))
    some_large = not large.isEmpty()
    is_large = F.col("frame_id").eqNullSafe(F.col("large"))

    def run(table: pa.Table) -> pa.Table:
        frame = table.column("frame_id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        box = np.stack([table.column(c).cast(pa.float64()).to_numpy() for c in BOX], axis=1)
        score = table.column("score")
        known = score.is_valid().to_numpy()
        numbers = score.cast(pa.float64()).to_numpy()
        return table.take(pa.array(kept_boxes(frame, box, np.where(known, numbers, 0.0), known, overlap)))

    here = stored.join(F.broadcast(large), is_large, "left_anti") if some_large else stored
    kept = cut_lineage(here.groupBy(F.pmod(F.xxhash64("frame_id"), F.lit(total // TASK_BOXES + 1))).applyInArrow(run, stored.schema))
    if not some_large:
        return kept
    return kept.union(_by_rounds(stored.join(F.broadcast(large), is_large, "left_semi"), overlap))


def _by_rounds(boxes: DataFrame, overlap: float) -> DataFrame:
    """Suppression of frames of any size.

    Boxes that none of their undecided coverers can drop any more are kept, those that a kept one covers go, round
    by round until all is decided.
    """
    spark = boxes.sparkSession
    merged = boxes.groupBy("frame_id", *BOX).agg(F.max("score").alias("score"))
    # Boxes of a frame differ in this, and it puts them in order.
    placed = cut_lineage(merged.withColumn("place", F.struct((-F.col("score")).alias("s"), *BOX)))
    flat = placed.where(_area() == 0)
    top = placed.join(flat.select("frame_id").distinct(), "frame_id").groupBy("frame_id").agg(F.min("place").alias("place"))
    gone = flat.select("frame_id", "place").join(top, ["frame_id", "place"], "left_anti")
    left = cut_lineage(_covered(placed.where(_area() != 0), overlap))
    dropped = [cut_lineage(gone)]
    while not left.isEmpty():
        covered = left.select("frame_id", F.col("b").alias("place")).distinct()
        kept = left.select("frame_id", F.col("a").alias("place")).distinct().join(covered, ["frame_id", "place"], "left_anti")
        new = cut_lineage(left.join(kept.withColumnRenamed("place", "a"), ["frame_id", "a"], "left_semi")
                          .select("frame_id", F.col("b").alias("place")).distinct())
        dropped.append(new)
        for side in ("a", "b"):
            left = left.join(new.withColumnRenamed("place", side), ["frame_id", side], "left_anti")
        left = cut_lineage(left)
    out = spark.createDataFrame([], dropped[0].schema)
    for d in dropped:
        out = out.union(d)
    return placed.join(out, ["frame_id", "place"], "left_anti").select("frame_id", *BOX, "score")
