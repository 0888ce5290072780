"""Jaccard join, substring dedup, line dedup and cover tree against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.llm import covertree, jaccard, lines, substrings
from tallywise.llm.common import components
from tests.llm import brute


def ordered(rows):
    return sorted(rows, key=repr)


def test_jaccard_links(docs, corpus):
    got = [tuple(r) for r in jaccard.near_duplicates(docs).collect()]
    assert ordered(got) == ordered(brute.jaccard(corpus))


def test_jaccard_of_nothing(no_docs):
    assert jaccard.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("turns", [0, 1])
def test_jaccard_turns_change_nothing(docs, corpus, turns):
    got = [tuple(r) for r in jaccard.near_duplicates(docs, turns=turns).collect()]
    assert ordered(got) == ordered(brute.jaccard(corpus))


def test_jaccard_at_the_threshold(spark):
    """Sets of 7 and 8 with 6 in common are at 2/3, sets of 7 and 7 with 6 at 0.75."""
    w = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(w[:11])), (2, " ".join(w[:10] + ["z"])), (3, " ".join(w[:10] + ["z", "y"])),
            (4, " ".join(w[20:25])), (5, " ".join(w[20:24]))]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered(map(tuple, got)) == ordered(brute.jaccard(rows))
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_jaccard_chains_of_near_copies(spark):
    """Each set is like the next one only; the component still is one."""
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[6 * i:6 * i + 100])) for i in range(40)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_substrings(docs, corpus):
    rows = substrings.dedup(docs).collect()
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), r.kept) for r in rows]
    assert ordered(got) == ordered(brute.substrings(corpus))


@pytest.mark.parametrize("length", [4, 8])
def test_substrings_of_other_lengths(docs, corpus, length):
    rows = substrings.dedup(docs, length).collect()
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), r.kept) for r in rows]
    assert ordered(got) == ordered(brute.substrings(corpus, length))


def test_substrings_of_nothing(no_docs):
    assert substrings.dedup(no_docs).collect() == []
    with pytest.raises(ValueError):
        substrings.dedup(no_docs, 10)


def test_substrings_of_a_periodic_text(spark):
    rows = [(1, "a b " * 60), (2, "b a " * 15), (3, "x " * 50)]
    out = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), r.kept) for r in out]
    assert ordered(got) == ordered(brute.substrings(rows))


def test_lines(docs, corpus):
    out = lines.dedup(docs)
    assert out.columns == [*docs.columns, "removed_lines"]
    rows = out.collect()
    assert ordered((r.doc_id, r.removed_lines) for r in rows) == ordered(brute.removed_lines(corpus))
    before = {(d, len(t or "")): t for d, t in corpus}
    for r in rows:
        t = before[r.doc_id, r.n_chars]
        assert r.text == (None if t is None else "\n".join(
            x for i, x in enumerate(t.split("\n")) if i not in r.removed_lines))


def test_lines_one_edit_apart(spark):
    rng = random.Random(1)
    rows, base = [], [f"w{rng.randrange(9)}" for _ in range(8)]
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(w))
            w[p:p + rng.randrange(2)] = [f"w{rng.randrange(9)}"] * rng.randrange(2)
        rows.append((i // 4, " ".join(w)))
    texts = [(d, "\n".join(t for e, t in rows if e == d)) for d in range(30)]
    out = lines.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert ordered((r.doc_id, r.removed_lines) for r in out) == ordered(brute.removed_lines(texts))


def test_lines_copies_of_any_length(spark, docs, corpus):
    extra = [(70, "Les.\n\n\nLes.\n\u6f22\u5b57\na\tb\tc\n "), (71, "Les\nLes.\n\u6f22\u5b57\na\tb\tc\n "),
             (None, "Les.\nLes."), (71, "one two three four five\none two three four six"),
             (72, "one two three four\none two three five\none two three four")]
    rows = [*corpus, *extra]
    out = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered((r.doc_id, r.removed_lines) for r in out) == ordered(brute.removed_lines(rows))
    for r in out:
        if r.text is not None and r.doc_id == 71:
            assert r.text in ("Les\n", "Les", "one two three four five", "")


def test_lines_of_a_million_words(spark):
    """A line of a million words, its copy, and edits of it at either end and in the middle."""
    w = [f"w{i % 9973}" for i in range(1_000_000)]
    edit = lambda i, *new: " ".join([*w[:i], *new, *w[i + 1:]])
    rows = [(1, " ".join(w)), (2, edit(0, "x")), (3, edit(500_000)), (4, edit(999_999, w[-1], "y")), (5, edit(300_000, "x", "y", "z")),
            (6, "short\n" + " ".join(w))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.removed_lines for r in lines.dedup(df).select("doc_id", "removed_lines").collect()}
    assert got == {1: [], 2: [0], 3: [0], 4: [0], 5: [], 6: [1]}


def test_many_lines_in_one_text(spark):
    text = "\n".join(f"line {i % 20_000} of many" for i in range(60_000))
    out = lines.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert out.text == "\n".join(f"line {i} of many" for i in range(20_000))
    assert out.removed_lines == list(range(20_000, 60_000))


def test_lines_with_names_of_their_own(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    names = ("row", "tie", "line", "lines", "place", "words", "h", "g", "_row", "_lines", "lead", "found", "numbers", "own", "all")
    out = lines.dedup(df.select("*", *(F.lit(n).alias(n) for n in names)))
    assert out.columns == ["doc_id", "text", *names, "removed_lines"]
    rows = out.collect()
    assert ordered((r.doc_id, r.removed_lines) for r in rows) == ordered(brute.removed_lines(corpus))
    assert all(r[n] == n for r in rows for n in names)


def test_lines_of_nothing(no_docs):
    assert lines.dedup(no_docs).collect() == []


def test_lines_run_no_python(docs):
    plan = lines.dedup(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


def vectors(spark, extra=()):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8))
    x = [(i, (centres[i % 30] + rng.normal(scale=0.25, size=8)).tolist(), 0) for i in range(300)]
    x += [(300 + i, x[7][1], i) for i in range(20)] + list(extra)
    return x, spark.createDataFrame(x, "vec_id long, embedding array<float>, n_links int")


@pytest.mark.parametrize("sample,block", [(1024, 3000), (20, 40), (1, 7)])
def test_cover_tree(spark, sample, block):
    odd = [(400, None, 1), (401, [], 1), (402, [0.0] * 8, 1), (403, [1.0] * 7 + [None], 1),
           (404, [float("nan")] + [1.0] * 7, 1), (405, [float("inf")] * 8, 1), (406, [1.0, 2.0], 1),
           (407, [2.0, 4.0], 1), (5, [3e38] * 8, 1), (None, [1e-38] * 8, 1), (408, [-0.0] * 7 + [1.0], 1),
           (409, [0.0] * 7 + [2.0], 1)]
    x, table = vectors(spark, odd)
    got = covertree.near_duplicates(table, sample=sample, block=block).collect()
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(np.float32(c)) for c in v) and any(v)
          for _, v, _ in x]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if o else None
            for (_, v, _), o in zip(x, ok)]
    links = [(i, j) for i in range(len(x)) for j in range(i) if ok[i] and ok[j] and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= 0.9]
    label, n = brute.components(len(x), links), np.zeros(len(x), int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    least = {}
    for (v, _, _), c in zip(x, label):
        least.setdefault(c, []).append(v)
    want = []
    for (v, _, _), c, k in zip(x, label, n):
        m = min((y for y in least[c] if y is not None), default=None)
        want.append((v, int(k), m, v == m))
    assert ordered(map(tuple, got)) == ordered(want)


def test_cover_tree_of_nothing(spark):
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_traversal_prunes_and_loses_nothing(spark):
    rng = np.random.default_rng(0)
    points = covertree.unit_rows(np.concatenate([c + rng.normal(scale=0.05, size=(40, 6))
                                                 for c in rng.normal(size=(12, 6))]), 6)
    tree = covertree.CoverTree(points, 6)
    far = covertree.angles(points, tree.centres)
    leaf = far.argmin(axis=1)
    n = len(tree.centres)
    radius, own = np.zeros(n), np.zeros(n)
    for p, c in enumerate(leaf):
        own[c] = max(own[c], far[p, c])
        for node in tree.paths[c]:
            radius[node] = max(radius[node], far[p, node])
    alive = tree.leaf_pairs(radius, own, np.arccos(0.9))
    near = covertree.angles(points, points) <= np.arccos(0.9)
    assert alive[leaf[np.nonzero(near)[0]], leaf[np.nonzero(near)[1]]].all() and alive.mean() < 0.5


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = brute.components(400, links)
    assert got == {x: label[x] for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_equal_vectors_count_as_often_as_they_occur(spark):
    _, table = vectors(spark)
    rows = covertree.near_duplicates(table).where(F.col("vec_id") >= 300).collect()
    assert len({r.n_links for r in rows}) == 1 and rows[0].n_links >= 20


def test_plain_edit_check():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ([rng.choice("ab") for _ in range(rng.randrange(6))] for _ in range(2))
        assert brute.within_one(a, b) == (brute.edit_distance(a, b) <= 1)
