"""Tokens, language model, decontamination, licenses, personal data and toxicity against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.llm import bpe, brown, decontaminate, licenses, pii, queries, toxicity
from tallywise.llm.common import remainder
from tests.llm import brute

TOKENIZER = queries.tokenizer_json()


def ordered(rows):
    return sorted(rows, key=repr)


# ---------------------------------------------------------------- BPE

def test_bpe_as_the_library(docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(TOKENIZER)
    want = []
    for d, x in corpus:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, ids, t.decode(ids, skip_special_tokens=False)))
    encoded = bpe.encode(docs, TOKENIZER)
    assert ordered(map(tuple, encoded.collect())) == ordered(want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert ordered(map(tuple, bpe.digests(encoded).collect())) == ordered(
        (d, len(i), sha(" ".join(map(str, i))), sha(x)) for d, i, x in want)


def test_bpe_in_small_chunks(docs, monkeypatch):
    """The pipeline's last stage takes less text at a time than the operator by itself; the rows are the same."""
    import corpus_pipeline

    sizes, make_chunks = [], bpe.make_chunks
    monkeypatch.setattr(bpe, "make_chunks", lambda d, build, most: sizes.append(most) or make_chunks(d, build, most))
    few = bpe.encode(docs, TOKENIZER, 2000).collect()
    assert ordered((r.doc_id, r.ids, r.decoded) for r in few) == ordered((r.doc_id, r.ids, r.decoded) for r in bpe.encode(docs, TOKENIZER).collect())
    corpus_pipeline.tokens(docs.sparkSession, docs, "")
    assert sizes == [2000, 12 << 20, corpus_pipeline.TOKEN_CHUNK_BYTES] and sizes[2] < sizes[1]


def test_lookups_hand_freed_memory_back(monkeypatch):
    import pyarrow as pa
    from tallywise.llm import common

    class Asked:
        def groupBy(self, _):
            return self

        def applyInArrow(self, run, _):
            return run

    given = []
    monkeypatch.setattr(common, "_release", lambda: given.append(1))
    table = pa.table({"bucket": [0, 0], "chunk": [2, 1], "message": pa.array([common.pack([2]), common.pack([1])], pa.binary())})
    out = common.answer(Asked(), lambda asked: asked)(table)
    assert [common.unpack(m.as_buffer()) for m in out.column("message")] == [[1], [2]] and given == [1]


def test_bpe_decodes_by_join(spark):
    ids = spark.createDataFrame([(1, [320, 444, 320]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(ids, TOKENIZER).collect()} == {
        1: "a</w> b</w> a</w>".replace("b</w>", bpe.pieces_table(TOKENIZER)[444]), 2: "", 3: ""}


def test_bpe_of_nothing(no_docs):
    assert bpe.encode(no_docs, TOKENIZER).collect() == []


# ---------------------------------------------------------------- language model

def with_split(docs):
    return docs.withColumn("held_out", remainder("doc_id", 5) == 1)


def test_brown_counts_and_base(docs, corpus):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = brute.counted(t for d, t in corpus if not held(d))
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in corpus:
        tokens = [*brute.words(t, True), "\n"]
        want.append((d, held(d), len(tokens), sum(c[w] > 0 for w in tokens), n,
                     round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), 6)))
    rows = brown.score(with_split(docs), classes=8, least=3).collect()
    assert ordered((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                   for r in rows) == ordered(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_brown_probabilities_sum_to_one(docs):
    """Over all next tokens: clustered words, rare ones with one unknown, and the end."""
    model = brown.fit(brown.chunks_of(with_split(docs)), classes=6, least=3, rounds=2)
    p = 10 ** model.log_transitions()
    assert np.allclose(p.sum(axis=1), 1)
    words = model.words().collect()
    total = np.bincount([w["class"] for w in words if w["class"] >= 0], weights=[w.n for w in words if w["class"] >= 0], minlength=model.classes)
    assert model.transitions.sum() == model.tokens
    assert np.allclose(total, model.transitions.sum(axis=0)[:-2]) and np.allclose(total, model.class_tokens)
    assert all((w["class"] >= 0) == (w.n >= 3) for w in words) and len(words) == model.distinct - 1


def test_brown_exchange_finds_classes(spark):
    """Words of two kinds that alternate: the classes make the next word likelier than its share."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{rng.integers(20)}" for k in range(200))) for i in range(60)]
    table = with_split(spark.createDataFrame(rows, "doc_id long, text string"))
    some = brown.perplexity(brown.score(table, classes=4, rounds=6)).where("held_out")
    got = some.agg(F.avg("perplexity"), F.avg("base_perplexity")).first()
    assert got[0] < 0.6 * got[1]


def test_brown_score_like_plain(docs, corpus):
    """The class score of each text from the classes of the fitted model, token by token."""
    import xxhash

    table = with_split(docs)
    model = brown.fit(brown.chunks_of(table), classes=6, least=3, rounds=2)
    kind = {w.word % (1 << 64): (w["class"], w.n) for w in model.words().collect()}
    rare = [n for k, n in kind.values() if k < 0]
    log_next, end = model.log_transitions(), model.width - 1
    want = []
    for d, t in corpus:
        before, total = end, 0.0
        for w in [*brute.words(t, True), None]:
            if w is None:
                k, emit = end, 0.0
            else:
                k, n = kind.get(xxhash.xxh3_64_intdigest(w), (-1, 0))
                emit = math.log10(n / model.class_tokens[k]) if k >= 0 else math.log10((n + 0.5) / (sum(rare) + 0.5 * (len(rare) + 1)))
                k = k if k >= 0 else end - 1
            total += emit + log_next[before, k]
            before = k
        want.append((d, round(total, 5)))
    got = brown.score(table, classes=6, least=3, rounds=2)
    assert ordered((r.doc_id, round(r.score, 5)) for r in got.collect()) == ordered(want)


def test_brown_clusters_more_words_of_more_text(spark, docs):
    """A word with enough occurrences is clustered however much text there is beside it."""
    few = docs.select("doc_id", "text")
    other = spark.range(3000).select((F.col("id") + 1000).alias("doc_id"),
                                     F.concat_ws(" ", *[F.concat(F.lit(f"n{i}x"), F.col("id") % 700) for i in range(20)]).alias("text"))
    clustered = []
    for table in (few, few.union(other), few.union(other).union(other)):
        model = brown.fit(brown.chunks_of(table.withColumn("held_out", F.lit(False))), classes=4, least=3, rounds=1)
        clustered.append({w.word for w in model.words().where("class >= 0").collect()})
    assert clustered[0] < clustered[1] <= clustered[2] and len(clustered[1]) > 10_000


def test_brown_of_nothing(no_docs, docs):
    assert brown.score(with_split(no_docs)).collect() == []
    rows = brown.score(docs.withColumn("held_out", F.lit(True)).limit(3)).collect()
    assert [r.train_tokens for r in rows] == [0, 0, 0] and all(math.isfinite(r.score) for r in rows)


# ---------------------------------------------------------------- decontamination

def items(spark, corpus):
    long = next(t for d, t in corpus if d == 0).split("\n")[-1]
    w = brute.bench_words(long)
    rows = [(1, " ".join(w)), (2, " ".join(w[5:25])), (3, "one TWO"), (4, None), (5, "... "), (2, "never seen here"),
            (None, " ".join(w[:13])), (30, " ".join(w[:12]) + " other " + " ".join(w[12:])), (7, "c c d İ"),
            (8, " ".join([w[0]] * 15))]
    return rows, spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, n_words int")


def test_contamination(spark, docs, corpus):
    rows, table = items(spark, corpus)
    out = decontaminate.contamination(docs, table)
    assert set(docs.columns) <= set(out.columns)
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in out.collect()]
    assert ordered(got) == ordered(brute.contamination(corpus, rows))


def test_contamination_of_nothing(spark, docs, no_docs, corpus):
    assert decontaminate.contamination(no_docs, items(spark, corpus)[1]).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated or r.n_hit for r in decontaminate.contamination(docs, none).collect())


def test_contamination_runs_no_python(spark, docs, corpus):
    plan = decontaminate.contamination(docs, items(spark, corpus)[1])._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "x a b c d e y a b z"), (2, "e d c b a"), (3, "a q q b q c q d q e")],
                                 "doc long, text string")
    item = decontaminate.item_words(spark.createDataFrame([(9, "a b c d e")], "item_id long, text string"))
    assert [tuple(r) for r in decontaminate.phrase_matches(docs, item, 4).collect()] == [(1, "9", 1, 6)]
    near = decontaminate.proximity_matches(docs, item, within=20, share=1.0).collect()
    assert {r.doc for r in near} == {1, 2, 3}
    near = decontaminate.proximity_matches(docs, item, within=5, share=1.0).collect()
    assert {r.doc for r in near} <= {1, 2}


def test_proximity_with_missing_terms(spark):
    """Any fifth of the terms may be missing, the rarest and those no document has among them."""
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(5, 40)))) for i in range(80)]
    texts += [(100, "x a b c d y"), (101, "a c d e"), (102, None)]
    wanted = [(1, "a b c d rare"), (2, "a b c d e f g h i j"), (3, "k l m n absent"), (4, "a a b b c never1 never2"),
              (5, "p o n m l k j i h g")]
    docs = spark.createDataFrame([*texts, (103, "rare")], "doc long, text string")
    items_ = decontaminate.item_words(spark.createDataFrame(wanted, "item_id long, text string"))
    want = set()
    for d, t in texts:
        w = (t or "").split()
        for item, x in wanted:
            terms, size = set(x.split()), max(12, len(x.split()))
            for i in range(len(w)):
                n = len(terms & set(w[i:i + size]))
                if w[i] in terms and n >= 0.8 * len(terms):
                    want.add((d, str(item), i, n))
    got = [tuple(r) for r in decontaminate.proximity_matches(docs, items_, within=12, share=0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # The same places beside the phrase matches, whatever columns the documents have.
    names = ("words", "doc", "found", "close", "item", "terms", "near", "_words", "_doc", "_found", "near_hits", "hits")
    named = docs.withColumnRenamed("doc", "doc_id").select("*", *(F.lit(n).alias(n) for n in names))
    table = spark.createDataFrame(wanted, "item_id long, text string")
    out = decontaminate.contamination(named, table, near=(12, 0.8))
    rows = out.collect()
    assert {(r.doc_id, *p) for r in rows for p in r.near_hits} == want and all(list(r.near_hits) == sorted(r.near_hits) for r in rows)
    assert all(r[n] == n for r in rows for n in names[:-2]) and set(named.columns) < set(out.columns)
    plain = {r.doc_id: r.n_hit for r in decontaminate.contamination(named, table).collect()}
    assert plain == {r.doc_id: r.n_hit for r in rows}
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Pandas", "MapInArrow"))
    assert {i for _, i, _, _ in want} >= {"1", "2", "3"} and (100, "1") in {x[:2] for x in want}


# ---------------------------------------------------------------- licenses

def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"].split()
    edited = mit[:20] + ["so", "called"] + mit[20:60] + mit[61:]
    rows = [(1, "a b c Licensed under the Apache License, Version 2.0. d"), (2, None), (3, ""),
            (4, "x " * 300 + " ".join(mit) + " y" * 50), (5, " ".join(edited)), (6, " ".join(mit[:30])),
            (7, "RELEASED&&& under*** the%%% MIT!! license"), (8, "under the Apache License Version 2.0"),
            (9, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."), (1, "Released under the MIT License.")]
    table = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, licenses string")
    out = licenses.scan(table, licenses.template_table(spark)).collect()
    got = ordered((r.doc_id, [(m.license_id, m.start, m.end) for m in r.licenses]) for r in out)
    assert got == ordered([
        (1, [("Apache-2.0-short", 3, 10)]), (1, [("MIT-short", 0, 5)]), (2, []), (3, []),
        (4, [("MIT", 300, 300 + len(mit))]), (5, [("MIT", 0, len(edited))]), (6, []), (7, [("MIT-short", 0, 5)]),
        (8, []), (9, [("CC-BY-NC-4.0-short", 0, 5), ("CC-BY-NC-4.0-short", 5, 10)])])


def test_licenses_find_all_that_hold_enough_shingles(spark, docs, corpus):
    plain = lambda t: [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x) for x in brute.words((t or "").lower())) if w]
    texts = {"p": next(t for d, t in corpus if d is None and t), "n": next(t for d, t in corpus if d == 60)}
    fives = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    cut = lambda t: fives(plain(t))
    want = [(d, sorted(k for k, v in texts.items() if len(cut(v) & cut(t)) >= 0.75 * len(cut(v)))) for d, t in corpus]
    out = licenses.scan(docs, licenses.template_table(spark, texts)).collect()
    assert ordered((r.doc_id, sorted({m.license_id for m in r.licenses})) for r in out) == ordered(want)


def test_licenses_do_not_depend_on_neighbours(spark):
    """Long templates whole, cut, with passages inserted and in the middle of texts, among any other rows."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    some = lambda n: [word() for _ in range(n)]
    long, wide = some(400), some(900)
    mit = licenses.TEMPLATES["MIT"].split()
    into = lambda t, n, *at: [x for i, w in enumerate(t) for x in ([*some(n), w] if i in at else [w])]
    cases = {
        "whole": (long, "long"), "cut": (long[:330], "long"), "end": (long[70:], "long"), "too short": (long[:290], None),
        "inside": (some(300) + long + some(300), "long"), "one insert": (into(long, 50, 200), "long"),
        "long insert": (into(long, 380, 200), "long"), "three inserts": (into(long, 120, 100, 200, 300), "long"),
        "every tenth": ([word() if i % 10 == 0 else w for i, w in enumerate(long)], None),
        "every thirtieth": ([word() if i % 30 == 0 else w for i, w in enumerate(long)], "long"),
        "mit": (mit, "MIT"), "mit 40": (into(mit, 40, 40), "MIT"), "mit 50": (into(mit, 50, 40), "MIT"), "wide": (wide[100:850], "wide"),
        "both": (long + some(5) + wide, "long,wide"), "half": (some(20) + wide[:450] + some(20), None), "other": (some(500), None),
        "tiny": (licenses.TEMPLATES["MIT-short"].split(), "MIT-short"), "tail": (some(3) + long[60:], "long")}
    rows = [(k, " ".join(t)) for k, (t, _) in cases.items()] + [(f"fill {i}", " ".join(some(rng.randrange(12)))) for i in range(40)]
    rng.shuffle(rows)
    templates = licenses.template_table(spark, {"long": " ".join(long), "wide": " ".join(wide), "MIT": " ".join(mit),
                                                "MIT-short": licenses.TEMPLATES["MIT-short"]})
    seen = []
    for parts in (1, 3, 50):
        got = {r.doc_id: [tuple(m) for m in r.licenses] for r in licenses.scan(
            spark.createDataFrame(rows, "doc_id string, text string").repartition(parts), templates).collect()}
        seen.append(got)
        for k, (_, want) in cases.items():
            assert ",".join(m[0] for m in got[k]) == (want or ""), (k, got[k])
    assert seen[0] == seen[1] == seen[2]
    assert seen[0]["inside"][0][1:3] == (300, 700) and seen[0]["one insert"][0][1:3] == (0, 450)


def test_full_licenses(spark):
    full = [k for k in licenses.TEMPLATES if k.endswith("-full")]
    docs = spark.createDataFrame([(k, "x y\n" + licenses.TEMPLATES[k].replace(", ", ",\n")) for k in full], "doc_id string, text string")
    for r in licenses.scan(docs, licenses.template_table(spark)).collect():
        assert (r.doc_id, 2, 1.0) in {(m.license_id, m.start, m.containment) for m in r.licenses}


def test_licenses_of_nothing(spark, no_docs, docs):
    assert licenses.scan(no_docs, licenses.template_table(spark)).collect() == []
    none = spark.createDataFrame([], "license_id string, text string")
    assert all(r.licenses == [] for r in licenses.scan(docs, none).collect())


# ---------------------------------------------------------------- personal data

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


PERSONAL = [
    (1, "card 4845168114407329, 4111 1111 1111 1111 and 4111-1111-1111-1111 but 4845168114407328."),
    (2, "2020-02-29 2021-02-29 31.12.1999 12/31/1999 1899-12-31 2100-05-01"), (3, None), (4, ""),
    (5, "97.51.17.173 97.51.17.173!! 300.1.1.1 1.2.3.4.5"), (6, "123-45-6789 000-45-6789 666-12-1234"),
    (7, "+1 (017) 555-7713 and +49 30 1234567; mail a.b@mail1.example.com, A.B@mail1.example.com"),
    (8, "no numbers"), (9, "97.51.17.173"), (1, "4845168114407329"), (None, "4845168114407329\n\n"),
]


@pytest.fixture(scope="module")
def personal(spark):
    return spark.createDataFrame([(d, t, "x") for d, t in PERSONAL], "doc_id long, text string, pii_kinds string")


def test_pii_keeps_formats_and_links(personal):
    rows = pii.pseudonymize(personal, "key").collect()
    text = [r.text for r in rows]
    kinds = [sorted(r.pii_kinds) for r in rows]
    assert kinds == [["card"] * 3, ["date"] * 4, [], [], ["ip", "ip"], ["ssn"], ["email"] * 2 + ["phone"] * 2, [],
                     ["ip"], ["card"], ["card"]]
    assert text[2] is None and text[3] == "" and text[7] == "no numbers"
    for (_, before), after in zip(PERSONAL, text):
        if before and "@" not in before:
            assert re.sub(r"\d", "9", re.sub(r"[\d.]{7,}", "IP", before)) == re.sub(
                r"\d", "9", re.sub(r"[\d.]{7,}", "IP", after))
    cards = re.findall(r"\d{16}", text[0])
    assert luhn(cards[0]) and cards[0] != "4845168114407329" and cards[1] == "4845168114407328"
    assert text[9] == cards[0] and text[10].strip() == cards[0]
    grouped = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", text[0])
    assert grouped[0].replace(" ", "") == grouped[1].replace("-", "") and luhn(grouped[0].replace(" ", ""))
    assert text[4].split("!!")[0].split()[0] == text[8] and "300.1.1.1" in text[4]
    assert all(int(x) < 256 for x in text[8].split("."))
    masked = re.findall(r"\S+@mail1.example.com", text[6])
    assert len(set(masked)) == 1 and "a.b" not in text[6]


def test_pii_turns_back_with_its_key_only(personal):
    there = pii.pseudonymize(personal, "key")
    plain = [t for _, t in PERSONAL]
    back = [r.text for r in pii.pseudonymize(there, "key", back=True).collect()]
    other = [r.text for r in pii.pseudonymize(there, "other", back=True).collect()]
    for i, t in enumerate(plain):
        if not t or "@" not in t:
            assert back[i] == t
    assert other[0] != plain[0] and other[8] != plain[8]


def test_feistel_is_one_to_one(spark):
    network = pii.Feistel("k")
    n = spark.range(271 * 27)
    made = n.select(network.permute(F.col("id"), 271, 27, "t").alias("x"))
    assert made.agg(F.count_distinct("x"), F.min("x"), F.max("x")).first()[:] == (271 * 27, 0, 271 * 27 - 1)
    two = spark.range(100).select(network.digits(F.lpad(F.col("id").cast("string"), 2, "0"), "t").alias("x"))
    assert two.distinct().count() == 100


def test_pii_of_nothing(no_docs):
    assert pii.pseudonymize(no_docs, "key").collect() == []


def test_pii_runs_no_python(personal):
    plan = pii.pseudonymize(personal, "key")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


# ---------------------------------------------------------------- toxicity

@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        w = [f"w{rng.integers(80)}" for _ in range(rng.integers(5, 60))]
        bad = i % 5 == 0
        for _ in range(rng.integers(1, 4) if bad else 0):
            w.insert(rng.integers(len(w)), ["grobian", "grobians!!", "you oaf", "OAF", "0af"][rng.integers(5)])
        rows.append((i, " ".join(w), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_toxicity_on_held_out_rows(labelled):
    model = toxicity.fit(labelled.where("doc_id % 3 > 0"), trees=10)
    held = labelled.where("doc_id % 3 = 0")
    scored = {r.doc_id: r.score for r in toxicity.score(held, model).collect()}
    label = {r.doc_id: r.label for r in held.collect()}
    assert set(scored) == set(label) and all(0 <= s <= 1 for s in scored.values())
    right = sum((s >= 0.5) == (label[d] == 1) for d, s in scored.items())
    assert right / len(scored) > 0.95


def test_toxicity_scores_any_text(spark, docs, corpus, no_docs, labelled):
    model = toxicity.fit(labelled, trees=3)
    scored = toxicity.score(docs, model, keep=tuple(docs.columns))
    rows = scored.collect()
    assert len(rows) == len(corpus) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.text is None} == {r.score for r in rows if r.text == ""}
    assert toxicity.score(no_docs, model).collect() == []


def test_toxicity_without_two_classes(docs, no_docs):
    model = toxicity.fit(docs.select("doc_id", "text", F.lit(0).alias("label")))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.fit(no_docs.select("doc_id", "text", F.lit(1).alias("label"))).prior == 0.0


def test_toxicity_features():
    import pyarrow as pa

    f = toxicity.features(pa.array(["You are an oaf oaf", None, "OAF!! b4d", ""]), {"oaf": 2.0})
    row = dict(zip(toxicity.FEATURES, f[0]))
    assert row["lexicon_hits"] == pytest.approx(math.log1p(2)) and row["near_you"] == pytest.approx(1 / 4)
    assert row["longest_run"] == 2 and row["lexicon_distinct"] == 1 and row["you_share"] == pytest.approx(0.2)
    assert not f[1].any() and not f[3].any()
    row = dict(zip(toxicity.FEATURES, f[2]))
    assert row["shouted_share"] == 0.5 and row["repeated_marks"] == 0.5 and row["digit_rate"] > 0
    assert toxicity.normal_form("0af") == "oaf" and toxicity.terms_of("grobian!!")[0] == "grobian"
