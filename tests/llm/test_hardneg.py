"""Hard negatives against a plain version, and the bounds against the scores they bound."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    """``[(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)]`` of ``[(vec_id, vector, label)]``."""
    used = [(d, [math.floor(scale * float(x)) for x in v], label) for d, v, label in rows
            if d is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (d, v, label) in enumerate(used):
        if d % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), e, k != label) for j, (e, w, k) in enumerate(used)
                  if j != i and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scores if not x[2])[:positives]:
            fit = sorted((n, e) for n, e, other in scores if other and low * -s <= 100 * -n <= high * -s)
            out += [(d, p, r, e, -s, -n) for r, (n, e) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA, **how):
    df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, schema)
    return sorted(map(tuple, hardneg.mine(df, **how).collect()))


def clustered(n, width, seed, labels=3):
    """Vectors about a few centres, with copies and opposite ones."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    made = [centres[rng.integers(5)] * rng.uniform(0.2, 2) + rng.normal(size=width) * rng.choice([0.02, 0.3, 1.0]) for _ in range(n)]
    for i in range(0, n, 9):
        made[i] = made[(i * 7) % n] * (1 if i % 2 else -1)
    return [(i, [float(np.float32(x)) for x in v], int(rng.integers(labels))) for i, v in enumerate(made)]


@pytest.mark.parametrize("block", [16_384, 20])
def test_like_plain(spark, monkeypatch, block):
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "ANCHORS", max(3, block // 8))
    monkeypatch.setattr(hardneg, "TILE", 4)
    rows = clustered(400, 6, 1)
    got = mined(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), every=10)
    assert got == plain(rows, every=10) and len(got) > 500


def test_odd_rows(spark):
    """Nulls, non-finite numbers, other lengths, zero and empty vectors, repeated rows and ids, clashing names."""
    rng = random.Random(2)
    v = lambda n=4: [rng.choice([-1.0, -0.5, 0.25, 1.0, 2.0]) for _ in range(n)]
    rows = [(i, v(), i % 3) for i in range(60)]
    rows += [rows[0], rows[0], rows[20], (20, v(), 2), (None, v(), 1), (100, None, 1), (101, v(), None), (110, [1.0, None], 1),
             (120, [1.0, math.nan], 0), (130, [math.inf, 1.0], 0), (140, [0.0] * 4, 1), (141, [0.0] * 4, 1), (150, [], 2),
             (151, [], 2), (152, [], 0), (160, v(2), 0), (161, v(2), 0), (162, v(2), 1), (-20, v(), 1), (170, v(7), 0)]
    rng.shuffle(rows)
    want = plain(rows, every=10)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("row", "ints", "width", "norm", "near", "cosine", "cell", "angle", "block", "part", "home", "rank", "least"):
        df = df.withColumn(c, F.lit("x"))
    assert mined(spark, df, every=10) == want and want
    text = spark.createDataFrame([(i, x, None if k is None else f"label {k}") for i, x, k in rows], "vec_id long, embedding array<float>, label string")
    assert mined(spark, text, every=10) == want


def test_ties_take_the_smaller_id(spark):
    rows = [(0, [1.0, 0.0], 0), *((i, [2.0, 0.0], 0) for i in range(1, 9)), *((i, [1.0, float(i)], 1) for i in range(20, 40))]
    got = mined(spark, rows)
    assert got == plain(rows)
    assert [p for _, p, r, *_ in got if r == 1] == [1, 2, 3, 4, 5] and [n for _, p, _, n, *_ in got if p == 1] == list(range(20, 30))


def test_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 0), (2, [1.0], 1)]) == []


def test_a_group_of_copies(spark):
    """A third of all rows are one vector; rows of an anchor's own label among them are positives, the others negatives."""
    rows = [(i, [1.0, 2.0, 0.5], i % 2) if i % 3 == 0 else (i, [math.sin(i), math.cos(3 * i), math.sin(7 * i)], i % 2)
            for i in range(900)]
    assert mined(spark, rows) == plain(rows)


def test_large_components(spark):
    rows = [(i, [1e5 * (i + 1), -2e5, 1.5e5 * (i % 5)], i % 2) for i in range(30)]
    assert mined(spark, rows, every=10) == plain(rows, every=10)
    with pytest.raises(Exception, match="63 bits"):
        mined(spark, [(0, [1e10, 1.0], 0), (1, [1e10, 1.0], 0), (2, [1e10, 1.0], 1)])


def test_bounds_hold_and_cut():
    rng = np.random.default_rng(4)
    x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in clustered(800, 8, 5)], np.int64)
    axes = hardneg.directions(x.astype(float))
    assert len(axes) == 64 and np.allclose((axes * axes).sum(axis=1), 1)
    norm, cos = hardneg.cosines(x, axes)
    near = np.argsort(-cos, axis=1)[:, :3]
    a = rng.choice(len(x), 50, replace=False)
    low, high = hardneg.score_bounds(norm[a], cos[a], norm, near, np.take_along_axis(cos, near, 1))
    score = hardneg.inner(x[a], x, norm[a], norm)
    assert (low <= score).all() and (score <= high).all()
    # The bounds leave out most rows of a narrow window.
    window = (high >= 0.8 * score.max(axis=1)[:, None])
    assert window.mean() < 0.6
