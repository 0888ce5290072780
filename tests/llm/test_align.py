"""Alignment of two tokenizers against a plain version: whole texts by the libraries, links by comparing ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.llm import align

TOKENIZERS = align.tokenizers()


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens_of(text, libraries):
    """``(ids and byte lengths of both)``, or none where the bytes differ."""
    a, b = libraries
    raw, shown = (" " + text).encode(), align._shown_bytes()
    x = [(i, bytes(shown[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
         for i in b.encode(text)]
    if not text or b"".join(t for _, t in x) != raw or b"".join(t for _, t in y) != raw:
        return [], []
    return [(i, len(t)) for i, t in x], [(i, len(t)) for i, t in y]


def plain(texts, libraries):
    """``[(n_a, n_b, n_groups, n_links, n_best, count_sum, groups)]``."""
    found, holds = [], Counter()
    for text in texts:
        x, y = tokens_of(text or "", libraries)
        ranges = []
        for t in (x, y):
            ends = np.cumsum([n for _, n in t]).tolist()
            ranges.append([(i, e - n, e) for (i, n), e in zip(t, ends)])
        links, j0 = [], 0
        for i, s, e in ranges[0]:
            while j0 < len(ranges[1]) and ranges[1][j0][2] <= s:
                j0 += 1
            j = j0
            while j < len(ranges[1]) and ranges[1][j][1] < e:
                links.append((i, ranges[1][j][0]))
                j += 1
        common = sorted({e for _, _, e in ranges[0]} & {e for _, _, e in ranges[1]})
        groups, start = [], 0
        by_end = [defaultdict(list), defaultdict(list)]
        for k in (0, 1):
            at = 0
            for i, _, e in ranges[k]:
                by_end[k][common[at]].append(str(i))
                at += e == common[at]
        groups = ";".join(",".join(by_end[0][e]) + "|" + ",".join(by_end[1][e]) for e in common)
        found.append((len(x), len(y), len(common), links, groups))
        holds.update(set(links))
    most = defaultdict(int)
    for (a, _), n in holds.items():
        most[a] = max(most[a], n)
    return [(a, b, g, len(links), sum(holds[p] == most[p[0]] for p in links), sum(holds[p] for p in links), text)
            for a, b, g, links, text in found]


def odd_texts(n, seed):
    rng = random.Random(seed)
    bits = ["the", " ", "  ", "\n", "\n\n", "\t", " \n", "don't", "'s", "été", "12345", "?!", "…", "中文字", "🙂🙂", " ",
            "　", " ", "\x00", "\x1c", "<|endoftext|>", "<s>", "▁", "​", "á", "ﬁ", "İ", "__", "\r\n",
            "\u0085", " ", "ation", "Überraschung", "᠎", "x" * 40, "=" * 9, "﻿", "½", "²"]
    return ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(n)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_like_the_libraries(spark, corpus, libraries):
    texts = [t for _, t in corpus] + odd_texts(300, 1)
    want = plain(texts, libraries)
    assert sum(w[0] == 0 for w in want) > 5 and sum(w[0] > 0 for w in want) > 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for piece in (1 << 16, 40, 7):
        got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.align(docs, *TOKENIZERS, piece=piece).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_fragments_are_a_monoid():
    """Any cut of the two token streams and any order of composition give the fragment of all tokens."""
    rng = random.Random(3)
    written = align.Written(50, 50)

    def same(x, y):
        return (x.bounded == y.bounded and b"".join(x.text) == b"".join(y.text)
                and all((p == q).all() for f in ("head", "tail") for p, q in zip(getattr(x, f).parts(), getattr(y, f).parts()))
                and (x.codes == y.codes).all() and (x.times == y.times).all()
                and (x.n_a, x.n_b, x.n_groups) == (y.n_a, y.n_b, y.n_groups))

    for _ in range(300):
        a_end = np.cumsum([rng.randint(1, 4) for _ in range(rng.randint(0, 12))]).astype(np.int64)
        b_end = np.cumsum([rng.randint(1, 5) for _ in range(rng.randint(0, 12))]).astype(np.int64)
        t = align.Tokens(np.array([rng.randrange(50) for _ in a_end], np.int32), a_end,
                         np.array([rng.randrange(50) for _ in b_end], np.int32), b_end)
        n = rng.randint(1, 5)
        a_cut = [0, *sorted(rng.randint(0, len(a_end)) for _ in range(n - 1)), len(a_end)]
        # The second stream is cut near the first one's cuts, not at them.
        b_cut = [0, *sorted(min(len(b_end), max(0, int(np.searchsorted(b_end, a_end[c - 1] if c else 0)) + rng.randint(-1, 1)))
                            for c in a_cut[1:-1]), len(b_end)]
        parts = [align.Fragment.of(t.cut(a_cut[i], a_cut[i + 1], b_cut[i], b_cut[i + 1]), written) for i in range(n)]
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i:i + 2] = [parts[i].then(parts[i + 1], written)]
        assert same(parts[0], align.Fragment.of(t, written))


def test_one_long_text(spark, libraries):
    """Hundreds of pieces, some without any cut."""
    rng = random.Random(4)
    text = " ".join(rng.choice(["alpha", "Beta,", "x" * 300, "été", "line\nbreak"]) for _ in range(4000)) + "\n" * 50
    docs = spark.createDataFrame([(7, text)], "doc_id int, text string")
    got = align.align(docs, *TOKENIZERS, piece=1000).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == plain([text], libraries) and got[0].doc_id == 7


def test_pair_counts(spark, corpus, libraries):
    texts = [t for _, t in corpus]
    docs = spark.createDataFrame([("x", t) for t in texts], "doc_id string, text string")
    holds = Counter()
    for text in texts:
        x, y = tokens_of(text or "", libraries)
        a, b = np.cumsum([n for _, n in x]), np.cumsum([n for _, n in y])
        holds.update({(x[int(np.searchsorted(a, e))][0], y[int(np.searchsorted(b, e))][0]) for e in {*a.tolist(), *b.tolist()}})
    got = align.pair_counts(docs, *TOKENIZERS).collect()
    assert {(r.a, r.b): r.n_docs for r in got} == dict(holds) and len(got) == len(holds)
    most = defaultdict(int)
    for (a, _), n in holds.items():
        most[a] = max(most[a], n)
    assert all(r.best == (r.n_docs == most[r.a]) for r in got)


def test_digest_and_other_columns(docs, no_docs, corpus, libraries):
    out = align.digests(align.align(docs.withColumn("groups", F.lit(1)).withColumn("chunk", F.lit("x")), *TOKENIZERS))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(d, *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "")
            for (d, _), w in zip(corpus, plain([t for _, t in corpus], libraries))]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert align.align(no_docs, *TOKENIZERS).collect() == []
