import random

import pytest

NAMES = "doc_id long, text string, lang string, source string, n_chars long, component_id string, n_words double"


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, empty and long texts, repeated rows and ids."""
    rng = random.Random(5)
    vocabulary = [a + b for a in "the of and to in on re st le der la".split() for b in
                  ["", "x", "ing", "Er", ",", ".", "é", "&&&", "s"]]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    lines = lambda n, m: "\n".join(text(m) for _ in range(n))
    passage, line = text(45), text(9)
    rows = []
    for i in range(60):
        t = lines(rng.randint(1, 6), rng.randint(3, 40))
        if i % 4 == 0:
            t += "\n" + passage
        if i % 3 == 0:
            t += "\n" + line
        if i % 5 == 0:
            w = line.split(" ")
            w[i % 9] = "changed"
            t = " ".join(w) + "\n" + t
        rows.append((i, t))
    base = text(120).split(" ")
    for i in range(60, 100):  # near copies, of which some are farther from each other than from the first
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"edit{i}{rng.random():.3f}"
        rows.append((i, " ".join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "  \n\t "), (105, "one two"),
             (106, "one two"), (107, "ONE two"), (108, lines(40, 200)), (None, passage), (None, None),
             (109, "a\x00b \x1c c d İ é <|endoftext|>x don't it's 12345"), (3, rows[3][1]),
             (5, "another text with an id that is taken already and a few more words to fill it"),
             (110, (text(30) + " ") * 4)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as a table with more columns, some named like results, some null."""
    made = [(d, t, None if (d or 0) % 2 else "en", "s", len(t or ""), "x", None) for d, t in corpus]
    return spark.createDataFrame(made, NAMES).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], NAMES)
