"""Linear classifiers with hinge loss by averaged stochastic gradient descent, one for each of many labels.

Each shard of the rows takes its own steps from the same weights, row by row, and the shards' weights are averaged
after each pass. Steps get smaller as ``1 / (alpha * t)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywise.session import shared_dir


@dataclass
class HingeModel:
    """Weights by label and feature, and an intercept a label; a label that all or no rows carry is not ``used``."""
    weights: np.ndarray
    intercepts: np.ndarray
    used: np.ndarray
    passes: int

    def margins(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return self.weights[:, index] @ value + self.intercepts


def first_step(alpha: float) -> float:
    """The step number to begin with, so that the first step is of the size of typical weights."""
    typical = math.sqrt(1.0 / math.sqrt(alpha))
    return 1.0 / (typical * alpha)


def learn(weights: np.ndarray, intercepts: np.ndarray, rows, t: float, alpha: float) -> tuple[np.ndarray, np.ndarray, float, int]:
    """One pass over ``rows`` of ``(index, value, labels of -1 and 1)``: new weights, the summed loss and the row count."""
    weights, intercepts = weights.copy(), intercepts.copy()
    scale, loss, n = 1.0, 0.0, 0
    for index, value, y in rows:
        eta = 1.0 / (alpha * t)
        margin = y * (scale * (weights[:, index] @ value) + intercepts)
        loss += np.maximum(0.0, 1.0 - margin).sum()
        scale *= max(0.0, 1.0 - eta * alpha)  # the shrinking of all weights, kept apart from them
        if scale < 1e-9:
            weights *= scale
            scale = 1.0
        wrong = np.flatnonzero(margin < 1.0)
        if len(wrong):
            weights[np.ix_(wrong, index)] += (eta / scale) * y[wrong, None] * value[None, :]
            intercepts[wrong] += eta * y[wrong]
        t += 1
        n += 1
    return weights * scale, intercepts, loss, n


def sparse(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index and value arrays of a column of vectors, sparse or dense."""
    kinds = column.field("type").to_pylist()
    (index, index_at, _), (value, value_at, value_to) = (_lists(column.field(n)) for n in ("indices", "values"))
    for kind, i, a, b in zip(kinds, index_at, value_at, value_to):
        yield index[i:i + b - a] if kind == 0 else np.arange(b - a), value[a:b]


def _lists(column: pa.Array) -> tuple[np.ndarray, list[int], list[int]]:
    """The flat values of a column of lists, and where each list begins and ends; a null list is empty."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    return column.flatten().to_numpy(zero_copy_only=False), [0, *ends[:-1].tolist()], ends.tolist()


def fit_hinge(rows: DataFrame, indicators: str, labels: int, size: int, alpha: float = 1e-4, tolerance: float = 1e-3,
              patience: int = 5, most_passes: int = 1000, shards: int = 4, row_id: str = "row_id", seed: int = 3) -> HingeModel:
    """One model for each of ``labels`` indicators on ``rows(row_id, indicators, features)``; ``size`` features.

    Passes end when the mean loss has not fallen by ``tolerance`` for ``patience`` of them. Rows are dealt to shards
    by a hash of ``row_id`` and seen in its order, so that the models do not depend on partitions. They are stored as
    they are dealt, so that a pass moves and sorts nothing. The driver holds the weights, ``labels`` times ``size`` numbers.
    """
    mark = F.xxhash64(row_id, F.lit(seed))
    dealt = rows.select(F.pmod(mark, F.lit(shards)).cast("int").alias("shard"), mark.alias("mark"),
                        F.col(indicators).alias("y"), F.col("features").alias("x")).repartition(shards, "shard") \
        .sortWithinPartitions("shard", "mark").select("y", "x")
    hits = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get(indicators, F.lit(i))).alias(f"h{i}") for i in range(labels)]).first()
    used = np.array([0 < (hits[f"h{i}"] or 0) < hits["n"] for i in range(labels)], bool)
    weights, intercepts = np.zeros((labels, size)), np.zeros(labels)
    best, waited, t = math.inf, 0, first_step(alpha)
    if used.any():
        shared_dir(rows.sparkSession)
        dealt = dealt.checkpoint()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def seen():
            for batch in batches:
                y = 2.0 * batch.column("y").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, labels) - 1.0
                for (index, value), own in zip(sparse(batch.column("x")), y):
                    yield index, value, own

        w, b, loss, n = learn(weights, intercepts, seen(), t, alpha)
        if n:
            for i in range(labels):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([n], pa.int64()), pa.array([loss if i == 0 else 0.0]),
                     pa.array([np.append(w[i], b[i]).tobytes()], pa.binary())], ["label", "n", "loss", "w"])

    def mean(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy().astype(float)
        order = np.argsort([bytes(x.as_buffer()) for x in table.column("w")], kind="stable")  # sums in one order
        w = sum(n[i] * np.frombuffer(table.column("w")[int(i)].as_buffer()) for i in order) / n.sum()
        return pa.table({"label": table.column("label")[:1], "n": pa.array([int(n.sum())]),
                         "loss": pa.array([float(np.sum(np.sort(table.column("loss").to_numpy())))]), "w": pa.array([w.tobytes()], pa.binary())})

    schema, passes = "label int, n long, loss double, w binary", 0
    while used.any() and passes < most_passes and waited < patience:
        got = sorted(dealt.mapInArrow(run, schema).groupBy("label").applyInArrow(mean, schema).collect(), key=lambda r: r.label)
        both = np.stack([np.frombuffer(bytes(r.w)) for r in got])
        weights, intercepts, passes = both[:, :-1], both[:, -1], passes + 1
        t += got[0].n / shards
        loss = got[0].loss / got[0].n
        waited = waited + 1 if loss > best - tolerance else 0
        best = min(best, loss)
    return HingeModel(weights, intercepts, used, passes)


def predict_labels(model: HingeModel, df: DataFrame, labels: Sequence[str], name: str) -> DataFrame:
    """The rows of ``df(features, ...)`` but for their features, with the labels whose margin is above 0."""
    keep = [c for c in df.columns if c not in ("features", name)]
    known = [labels[i] if u else None for i, u in enumerate(model.used)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[x for x, m in zip(known, model.margins(*row)) if x is not None and m > 0]
                     for row in sparse(batch.column("features"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.list_(pa.string()))], [*keep, name])

    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(name, T.ArrayType(T.StringType()))])
    return df.select(*keep, "features").mapInArrow(run, schema)
