"""Text, regions, colours, boxes, timelines, sources, models and streams on small fixtures."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywise.functions.text import KEPT_NEGATIONS, english_stop_words
from tallywise.operators import detection, geo, imaging, models, risk, summary, text, timeline
from tallywise.plans import studies
from tallywise.sources import readers
from tallywise.streaming import monitors

# ---------------------------------------------------------------- text


def test_tokens_keep_negations_and_accents(spark):
    stops = english_stop_words()
    assert not set(KEPT_NEGATIONS) & set(stops) and "the" in stops
    df = spark.createDataFrame([(1, "The café is NOT good, isn't it?"), (2, "")], "id int, t string")
    rows = {r["id"]: r["tokens"] for r in text.clean_tokens(df, "t", stops).collect()}
    assert rows[1][:3] == ["café", "not", "good"] and rows[2] == []
    lookup = spark.createDataFrame([("good", "well")], "token string, lemma string")
    lemmas = text.lemmatize(text.clean_tokens(df, "t", stops), "id", "tokens", lookup)
    assert {r["id"]: r["lemmas"] for r in lemmas.collect()}[1][:3] == ["café", "not", "well"]


def test_tags_round_trip_and_jaccard(spark):
    df = spark.createDataFrame([(1, "['b','a']"), (2, "[]"), (3, "['c']")], "id int, lit string")
    tagged = text.with_tags(df, "lit")
    labels = text.label_list(tagged, "tags")
    assert labels == ["a", "b", "c"]
    with pytest.raises(ValueError):
        text.label_list(tagged, "tags", limit=2)
    back = text.tags_from_indicators(text.tag_indicators(tagged, "tags", labels), "indicators", labels, "back")
    assert {r["id"]: (r["indicators"], r["back"]) for r in back.collect()} == {
        1: ([1, 1, 0], ["a", "b"]), 2: ([0, 0, 0], []), 3: ([0, 0, 1], ["c"])}
    pairs = spark.createDataFrame([(["a"], ["a", "b"]), ([], []), (["c"], ["d"])], "x array<string>, y array<string>")
    assert text.jaccard_mean(pairs, "x", "y").first()["jaccard"] == 25.0


def test_terms_like_plain(spark):
    """Totals and counts of one- and two-word terms; shared ids, nulls and texts without words; no row for an occurrence."""
    rng = np.random.default_rng(16)
    vocabulary = ["aa", "bb", "the", "é1", "_x", "dd", "q"]
    rows = [(None if i % 11 == 0 else i // 2, " ".join(rng.choice(vocabulary, int(rng.integers(0, 30))))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "q !"), (73, "Aa-bb")]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    total, per = {}, {}
    for i, t in rows:
        w = [x for x in (t or "").lower().replace("-", " ").split() if len(x) > 1 and x != "the"]
        for term in [*w, *map(" ".join, zip(w, w[1:]))]:
            total[term] = total.get(term, 0) + 1
            per[i, term] = per.get((i, term), 0) + 1
    want = sorted(total, key=lambda x: (-total[x], x))[:20]
    counts, terms = text.term_counts(df, "id", "t", ["the"], 20)
    assert {(r["id"], r["term"]): r["tf"] for r in counts.collect()} == {k: v for k, v in per.items() if k[1] in want}
    assert {r["term"]: (r["total"], r["df"]) for r in terms.collect()} == {
        x: (total[x], sum(k[1] == x for k in per)) for x in want}
    assert text.term_counts(df.limit(0), "id", "t", ["the"])[1].collect() == []
    assert "Generate" not in text.term_totals(df, "t", ["the"])._jdf.queryExecution().toString()


def test_vocabulary_stores_no_counts_per_text(spark, monkeypatch):
    """Rows that share an id, also a null one, are one text."""
    rows = [(1, "red red car"), (1, "red car"), (2, "blue car"), (None, "red"), (None, "red blue"), (3, None)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(3)
    want = sorted(text.term_counts(df, "id", "t", ["the"], 4)[1].collect())
    stored, cut = [], text.cut_lineage
    monkeypatch.setattr(text, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    got = text.vocabulary(df, "id", "t", ["the"], 4)
    assert got.columns == ["term", "total", "df"] and sorted(got.collect()) == want
    assert stored == [["term", "total"]] and ("red", 5, 2) in want
    assert text.vocabulary(df.limit(0), "id", "t", ["the"]).collect() == []


def test_grams_split_a_text_once(spark):
    df = spark.createDataFrame([(1, "Red the red car"), (2, "car"), (3, ""), (4, None)], "id int, t string")
    space = models.TermSpace(["red", "red red", "car", "red car"], [1.0] * 4, ["the"])
    out = space.transform(df, "t")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = {r["id"]: r["features"].toArray() * 6 ** 0.5 for r in out.where("id < 4").collect()}
    assert np.allclose(got[1], [2, 1, 1, 1] * np.sqrt([6 / 7])) and np.allclose(got[2], [0, 0, 6 ** 0.5, 0]) and not got[3].any()


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "red red car"), (2, "blue car"), (3, "the")], "id int, t string")
    got = {(r["id"], r["term"]): r["weight"] for r in text.tfidf(df, "id", "t", ["the"]).collect()}
    idf = {"red": np.log(4 / 2) + 1, "car": np.log(4 / 3) + 1, "red red": np.log(4 / 2) + 1, "red car": np.log(4 / 2) + 1}
    raw = np.array([2 * idf["red"], idf["car"], idf["red red"], idf["red car"]])
    for term, w in zip(("red", "car", "red red", "red car"), raw / np.linalg.norm(raw)):
        assert got[1, term] == pytest.approx(w)
    space = models.fit_terms(df, "id", "t", ["the"])
    vec = space.transform(df, "t").where("id = 1").first()["features"]
    assert dict(zip(space.terms, vec.toArray()))["red"] == pytest.approx(got[1, "red"])


def test_lexicon_rules(spark):
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    texts = ["good", "not good", "very good", "good!!!", "bad", "plain words", "", "so bad and not good"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for limit in (text.LEXICON_LIMIT, 0):
        keep, text.LEXICON_LIMIT = text.LEXICON_LIMIT, limit
        rows = {r["id"]: r for r in text.lexicon_sentiment(df, "id", "t", lexicon, ["not"], {"very": 0.293, "so": 0.293}).collect()}
        text.LEXICON_LIMIT = keep
        comp = lambda s: s / np.sqrt(s * s + 15)
        want = [1.9, -0.74 * 1.9, 1.9 + 0.293, 1.9 + 3 * 0.292, -2.5, 0, 0, -2.5 - 0.293 - 0.74 * 1.9]
        for i, s in enumerate(want):
            assert rows[i]["compound"] == pytest.approx(comp(s)), texts[i]
        assert (rows[0]["pos"], rows[0]["neu"]) == (1.0, 0.0) and rows[5]["neu"] == 1.0 and rows[6]["neu"] == 0.0


def test_model_sentiment_scores_each_text(spark):
    df = spark.createDataFrame([(1, "aaa"), (2, "b"), (3, None)], "id long, t string")

    def load():
        return lambda batch: [[float(len(t)), 0.0, 0.0] for t in batch]

    rows = {r["id"]: r["neg"] for r in text.model_sentiment(df, "id", "t", load).collect()}
    assert rows[1] == pytest.approx(np.exp(3) / (np.exp(3) + 2)) and rows[3] == pytest.approx(1 / 3)
    assert rows[1] != rows[2]


# ---------------------------------------------------------------- regions

SQUARE = [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]]
NOTCHED = [[(20, 0), (30, 0), (30, 10), (25, 3), (20, 10), (20, 0)]]
HOLED = [[(40, 0), (50, 0), (50, 10), (40, 10), (40, 0)], [(44, 4), (46, 4), (46, 6), (44, 6), (44, 4)]]
OVERLAP = [[(5, 5), (15, 5), (15, 15), (5, 15), (5, 5)]]


@pytest.mark.parametrize("cell", [1.0, 5.0, 90.0])
def test_point_in_polygon(spark, cell):
    polygons = spark.createDataFrame(
        [(n, i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in p])
         for i, (n, p) in enumerate([("square", SQUARE), ("notched", NOTCHED), ("holed", HOLED), ("overlap", OVERLAP)])],
        readers.POLYGON_SCHEMA)
    points = {"in": (2, 2, "square"), "edge": (0, 5, ""), "corner": (10, 10, "overlap"), "notch": (25, 6, ""), "low": (25, 2, "notched"),
              "hole": (45, 5, ""), "ring": (42, 5, "holed"), "both": (7, 7, "overlap"), "far": (-80, 60, ""), "slope": (22.5, 6.5, "")}
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y, _) in points.items()], "id string, lon double, lat double")
    got = {r["id"]: r["region"] for r in geo.tag_points(df, polygons, "id", cell=cell).collect()}
    assert got == {k: want for k, (_, _, want) in points.items()}


def test_region_join_keeps_unmatched(spark):
    a = spark.createDataFrame([("Bali",), ("Nusa Tenggara Barat",)], "NAME_1 string")
    b = spark.createDataFrame([("Bali", 4), ("Nusatenggara Barat", 5)], "province string, cities int")
    got = {r["NAME_1"]: (r["province"], r["cities"]) for r in geo.region_enrich(a, b, "NAME_1", "province", ["cities"]).collect()}
    assert got == {"Bali": ("Bali", 4), "Nusa Tenggara Barat": (None, None)}


# ---------------------------------------------------------------- colours and boxes

@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.integers(0, 6, (600, 3)) * 50, columns=list("rgb")).assign(image_id=1)
    tie = pd.DataFrame({"r": [9, 9, 1, 1], "g": [0, 0, 5, 5], "b": [0, 0, 7, 7], "image_id": 2})
    return spark.createDataFrame(pd.concat([pdf, tie])).selectExpr(
        "cast(image_id as long) image_id", *[f"cast({c} as int) {c}" for c in "rgb"])


def test_dominant_colors(spark, pixels):
    mode = {r["image_id"]: tuple(r) for r in imaging.mode_color(pixels).collect()}
    assert mode[2] == (2, 1, 5, 7, 2, 4)
    mean = {r["image_id"]: (r["r"], r["g"], r["b"]) for r in imaging.mean_color(pixels).collect()}
    centers, _ = imaging.kmeans_colors(pixels, 1, 2)
    one = {r["image_id"]: tuple(int(r[c]) for c in ("cr", "cg", "cb")) for r in centers.collect()}
    assert one == mean
    centers, assigned = imaging.kmeans_colors(pixels, 3, 4)
    pdf, c = assigned.where("image_id = 1").toPandas(), centers.where("image_id = 1").orderBy("cluster").toPandas()
    far = ((pdf[list("rgb")].to_numpy()[:, None] - c[["cr", "cg", "cb"]].to_numpy()) ** 2).sum(2)
    assert (far.argmin(1) == pdf["cluster"]).all() and pdf["n"].sum() == 600
    strip = imaging.palette_strip(centers, imaging.cluster_share(assigned)).where("image_id = 1").orderBy("cluster").collect()
    assert abs(sum(r["share"] for r in strip) - 1) < 0.03
    assert [r["start_px"] for r in strip] == [0, *np.cumsum([r["width_px"] for r in strip])[:-1]]
    assert [r["end_px"] for r in imaging.even_palette(centers).where("image_id = 1").orderBy("cluster").collect()] == [100, 200, 300]


def test_kmeans_settles(spark):
    """A row of greys whose centres need more than ten rounds, beside an image of one colour."""
    greys = [(1, v, v, v) for v in range(0, 250, 2) for _ in range(3 if v < 8 else 1)]
    pixels = spark.createDataFrame([*greys, (2, 9, 9, 9)], "image_id long, r int, g int, b int")
    colors = np.array([[r, g, b] for i, r, g, b in greys if i == 1], float)
    settled, assigned = imaging.kmeans_colors(pixels, 3)
    c = np.array([r[2:] for r in settled.where("image_id = 1").orderBy("cluster").collect()])
    nearest = ((colors[:, None] - c) ** 2).sum(2).argmin(1)
    assert np.allclose(c, [colors[nearest == j].mean(0) for j in range(3)], atol=1e-9)
    early, _ = imaging.kmeans_colors(pixels, 3, 10)
    e = np.array([r[2:] for r in early.where("image_id = 1").orderBy("cluster").collect()])
    assert not np.allclose(c, e)
    assert [tuple(r) for r in settled.where("image_id = 2").collect()] == [(2, 0, 9.0, 9.0, 9.0)]
    assert assigned.agg({"n": "sum"}).first()[0] == len(greys) + 1


def brute_nms(boxes, overlap):
    left, kept = sorted(boxes, key=lambda b: (-b[4], b[:4])), []
    while left:
        a, left = left[0], left[1:]
        kept.append(a)

        def cover(b):
            w = max(0, min(a[2], b[2]) - max(a[0], b[0]) + 1)
            h = max(0, min(a[3], b[3]) - max(a[1], b[1]) + 1)
            return w * h / ((b[2] - b[0] + 1) * (b[3] - b[1] + 1))

        left = [b for b in left if cover(b) <= overlap]
    return sorted(kept)


def test_boxes_decode_and_suppress(spark):
    cells = spark.createDataFrame(
        [(1, 2, 3, 0.5, 4.0, 5.0, 6.0, 7.0, 0.0), (1, 2, 3, 0.49, 4.0, 5.0, 6.0, 7.0, 0.0)],
        "frame_id long, row int, col int, score double, d0 double, d1 double, d2 double, d3 double, angle double")
    row = detection.decode_boxes(cells).collect()
    assert [(r["start_x"], r["start_y"], r["end_x"], r["end_y"]) for r in row] == [(5, 4, 17, 14)]
    rng = np.random.default_rng(6)
    frames = {}
    for f in range(3):
        xy = rng.integers(0, 60, (40, 2))
        frames[f] = [(int(x), int(y), int(x + w), int(y + h), float(s)) for (x, y), (w, h), s in
                     zip(xy, rng.integers(5, 25, (40, 2)), rng.permutation(40) / 40)]
    rows = [(f, *b) for f, bs in frames.items() for b in bs + bs[:3]]
    df = spark.createDataFrame(rows, "frame_id long, start_x int, start_y int, end_x int, end_y int, score double")
    got = detection.nms_boxes(df).toPandas()
    for f, bs in frames.items():
        mine = sorted(tuple(r) for r in got[got["frame_id"] == f][[*detection.BOX, "score"]].itertuples(index=False))
        assert mine == brute_nms(bs, 0.3)
    scaled = studies.text_boxes(cells, 2.0, 3.0).first()
    assert (scaled["start_x"], scaled["start_y"], scaled["end_x"], scaled["end_y"]) == (10, 12, 34, 42)


def test_one_crowded_frame(spark):
    """Boxes of all sizes, chains of overlaps, ties of score; no task gets the frame as one group."""
    rng = np.random.default_rng(7)
    boxes = [(int(x), int(y), int(x + w), int(y + h), float(s)) for x, y, w, h, s in zip(
        rng.integers(-50, 900, 1500), rng.integers(-50, 900, 1500), 2.0 ** rng.uniform(0, 9, 1500), 2.0 ** rng.uniform(0, 9, 1500),
        rng.integers(0, 40, 1500) / 40)]
    boxes += [(x, 2000, x + 20, 2020, 1 - x / 1000) for x in range(0, 400, 8)]  # each covers most of the next
    df = spark.createDataFrame([(1, *b) for b in boxes], "frame_id long, start_x int, start_y int, end_x int, end_y int, score double")
    for overlap in (0.3, 0.0, 0.9):
        got = detection.nms_boxes(df, overlap)
        assert not any(x in got._jdf.queryExecution().toString() for x in ("Python", "Pandas"))
        merged = {}
        for b in boxes:
            merged[b[:4]] = max(b[4], merged.get(b[:4], 0.0))
        want = brute_nms([(*k, v) for k, v in merged.items()], overlap)
        assert sorted(tuple(r)[1:] for r in got.collect()) == want
    assert detection.nms_boxes(df.limit(0)).collect() == []


def test_colors_in_tasks_like_rounds(spark, monkeypatch):
    """Images dealt to tasks and images that go by stored rounds have the same centres; null colours and images too."""
    rng = np.random.default_rng(14)
    rows = [(None if i == 5 else i, *(None if rng.random() < 0.03 else int(v) for v in rng.integers(0, 40, 3) * 6))
            for i in range(8) for _ in range(int(rng.integers(2, 120)))] + [(9, None, 1, 2), (9, None, 1, 2), (10, 7, 7, 7)]
    pixels = spark.createDataFrame(rows, "image_id long, r int, g int, b int")
    found, rounds, settled = [], [], imaging._settled
    monkeypatch.setattr(imaging, "_settled", lambda *a: rounds.append(1) or settled(*a))
    for most in (200_000, 40, 0):
        monkeypatch.setattr(imaging, "LOCAL_COLORS", most)
        tables = [*imaging.kmeans_palettes(pixels, (4, 2, 1)), *imaging.kmeans_colors(pixels, 3)]
        found.append([sorted(map(repr, t.collect())) for t in tables])
        assert len(rounds) == (0 if most > 40 else 2 if most else 4)
    assert found[0] == found[1] == found[2] and len(found[0][1]) == 3 * len({repr(r) for r in rows})


def test_boxes_in_tasks_like_rounds(spark, monkeypatch):
    """Frames dealt to tasks and frames that go by rounds keep the same boxes; nulls, odd scores and empty boxes too."""
    rng = np.random.default_rng(15)
    odd = [None, float("nan"), float("inf"), -0.0]
    rows = []
    for _ in range(700):
        x, y, w, h = (int(v) for v in (*rng.integers(0, 60, 2), *rng.integers(-3, 25, 2)))
        box = [None if rng.random() < 0.01 else v for v in (x, y, x + w, y + h)]
        score = odd[int(rng.integers(4))] if rng.random() < 0.06 else float(rng.integers(0, 9)) / 8
        frame = int(rng.integers(0, 12))
        rows += [(None if frame == 3 else frame, *box, score)] * int(rng.integers(1, 3))
    df = spark.createDataFrame(rows, "frame_id long, start_x int, start_y int, end_x int, end_y int, score double")
    slow, by_rounds = [], detection._by_rounds
    monkeypatch.setattr(detection, "_by_rounds", lambda b, o: slow.append(b.count()) or by_rounds(b, o))
    for overlap in (0.0, 0.3):
        found = []
        for most in (1_500, 110, 0):
            monkeypatch.setattr(detection, "LOCAL_BOXES", most)
            found.append(sorted(map(repr, detection.nms_boxes(df, overlap).collect())))
        assert found[0] == found[1] == found[2]
    alone = df.where("frame_id is not null")
    slow.clear()
    monkeypatch.setattr(detection, "LOCAL_BOXES", 1_500)
    detection.nms_boxes(alone).collect()
    assert not slow


# ---------------------------------------------------------------- timelines and sources

def test_segments(spark):
    cuts = spark.createDataFrame(
        [("a", 1, "00:14:36", 1500.0), ("a", 2, "00:23:42", 1500.0), ("b", 1, "00:01:00", 60.0), ("c", 1, "bad", 60.0),
         ("d", 1, "00:02:00", 60.0)], "video_id string, seq int, cut string, duration double")
    got = sorted(tuple(r) for r in timeline.segments(cuts, bucket_size=1).collect())
    assert got == [("a", 1, 0.0, 876.0), ("a", 2, 876.0, 1422.0), ("a", 3, 1422.0, 1500.0), ("b", 1, 0.0, 60.0), ("d", 1, 0.0, 120.0)]
    assert [r["video_id"] for r in timeline.rejected_cuts(cuts).collect()] == ["c"]


def test_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("﻿province;population_2015;area_km2;population_density_per_km2;cities_regencies;cities;regencies\r\nX Y;100; 48 ; 8 ; 3 ; - ; 2 \r\n".encode())
    row = readers.read_padded_csv(spark, str(tmp_path / "r.csv"), readers.REGION_SCHEMA).first()
    assert tuple(row) == ("X Y", 100, 48, 8, 3, None, 2)
    (tmp_path / "t.csv").write_text(",".join(readers.CARD_COLUMNS) + "\n201307,1000,AG,Mason,C,GENERAL,-5.25,NACAS,07/30/2013 12:00:00 AM,07/31/2013 12:00:00 AM,BOOKS\n201307,x,AG,M,C,G,bad,N,?,?,B\n")
    good, bad = readers.read_card_transactions(spark, str(tmp_path / "t.csv")).collect()
    assert (good["ym"], float(good["amount"]), good["posted_ts"]) == (dt.date(2013, 7, 1), -5.25, dt.datetime(2013, 7, 31))
    assert (bad["agency_number"], bad["amount"], bad["txn_ts"]) == (None, None, None)
    (tmp_path / "i.csv").write_text(",Text,Tags\n0,\"a, b\",\"['x']\"\n")
    assert tuple(readers.read_without_row_index(spark, str(tmp_path / "i.csv"), "i long, Text string, Tags string").first()) == ("a, b", "['x']")
    (tmp_path / "g.csv").write_text("title\n\nnote\nNo,Var,description,x\n1,A1,Age,z\n2,B2,Amount,z\n")
    names = {r["Var"]: r["description"] for r in readers.read_glossary(spark, str(tmp_path / "g.csv")).collect()}
    assert readers.rename_by_lookup(spark.range(1).selectExpr("id as A1", "id as other"), names).columns == ["Age", "other"]
    (tmp_path / "q.csv").write_text('a\nb\nc\n"Var",No,description\nv1,1,"loan amount, ""gross"""\nv2,2,\n')
    got = [tuple(r) for r in readers.read_glossary(spark, str(tmp_path / "q.csv")).collect()]
    assert got == [("v1", 'loan amount, "gross"'), ("v2", None)]
    (tmp_path / "l.txt").write_text(" 00:14:36 \n00:23:42\n")
    assert [r["line"] for r in readers.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["00:14:36", "00:23:42"]
    (tmp_path / "p.json").write_text(json.dumps({"name": "a", "ord": 1, "rings": [[{"x": 0, "y": 1}]]}))
    assert readers.read_polygons(spark, str(tmp_path / "p.json")).first()["rings"][0][0]["y"] == 1.0
    out = str(tmp_path / "out")
    readers.write_result(spark.range(3), out)
    assert spark.read.parquet(out).count() == 3


def test_image_pixels(spark, tmp_path):
    # A 2 x 2 bitmap: rows are stored bottom up, colours as blue, green, red.
    body = bytes([255, 0, 0, 0, 255, 0, 0, 0]) + bytes([0, 0, 255, 10, 20, 30, 0, 0])
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + (2).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "x.bmp").write_bytes(head + info + body)
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in readers.read_image_pixels(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (255, 0, 0), (1, 0): (30, 20, 10), (0, 1): (0, 0, 255), (1, 1): (0, 255, 0)}


# ---------------------------------------------------------------- models

def test_credit_models_learn_and_report(spark):
    df = spark.range(600).select(
        F.concat(F.lit("r"), "id").alias("row_id"), F.when(F.col("id") % 11 > 0, F.col("id") % 10).cast("double").alias("a"),
        F.when(F.col("id") % 10 > 6, "hi").otherwise("lo").alias("c"), (F.col("id") % 10 > 6).cast("int").alias("label"))
    small = models.Search("boosted", 1, "areaUnderROC", {"maxIter": models.choice(3), "maxDepth": models.choice(2)})
    scored = studies.credit_scores(spark, df, ["a"], ["c"], folds=2, candidates=1, searches=[models.TREE, models.LOGISTIC, small])
    assert {r["model"] for r in scored.select("model").distinct().collect()} == {"tree", "logistic", "boosted"}
    report = studies.model_report(scored.where("model = 'tree'"))
    assert report["metrics"].first()["accuracy"] == 1.0 and report["auc"].first()["auc"] == 1.0


def test_tag_models(spark):
    rows = [(i, "red apple sweet" if i % 2 else "fast car engine", ["fruit"] if i % 2 else ["auto"]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string, tags array<string>")
    scores = studies.tag_study(df, "id", "t", "tags", ["the"], kinds=("svc", "logistic"))
    assert [r["jaccard"] for r in scores.collect()] == [100.0, 100.0]


# ---------------------------------------------------------------- streams

def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), i % 3) for i in range(200)]
    schema = "event_id long, ts timestamp, user_id long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = monitors.read_event_stream(spark, str(tmp_path / "in"), schema, "*.parquet")
    got = {(r["user_id"], r["window_start"]): r["txns"] for r in
           monitors.run_to_table(monitors.stream_velocity(stream, "user_id", period="week"), "w").collect()}
    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "user_id"])
    pdf["w"] = pdf["ts"].dt.to_period("W").apply(lambda p: p.start_time)
    want = pdf.groupby(["user_id", "w"]).size()
    closed = {k: n for k, n in want.items() if k[1] + pd.Timedelta(days=7) <= pdf["ts"].max() - pd.Timedelta(days=1)}
    assert got == closed


@pytest.mark.parametrize("by_batch", [True, False])
def test_stream_gaps_mark_late_rows(spark, tmp_path, by_batch):
    day = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, user_id long"
    first = [(1, day, 7), (3, day + dt.timedelta(days=3), 7)]
    late = [(2, day + dt.timedelta(days=2, hours=12), 7), (4, day + dt.timedelta(days=5), 7)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    assert len(files) == 2
    stream = monitors.read_event_stream(spark, str(tmp_path / "in"), schema, "*.parquet", files_per_trigger=1)
    if by_batch:
        out = monitors.gaps_by_batch(stream, "user_id", "event_id")
    else:
        out = monitors.run_to_table(monitors.stream_gaps(stream, "user_id", "event_id"), "g")
    got = {r["event_id"]: (r["days_since_last"], r["late"]) for r in out.collect()}
    assert got == {1: (None, False), 3: (3, False), 2: (None, True), 4: (2, False)}


def test_worker_functions_travel_by_value(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from tallywise.operators import trees

    blob = cloudpickle.dumps((trees.grow, trees.SampleRows))
    done = subprocess.run([sys.executable, "-c", "import sys, pickle; pickle.loads(sys.stdin.buffer.read())"],
                          input=blob, cwd=tmp_path, capture_output=True, timeout=60)
    assert done.returncode == 0, done.stderr


def test_stream_gaps_of_any_batch_layout(spark, tmp_path):
    """Shuffled rows in small Arrow batches give the gaps of the ordered table."""
    import random

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), 7) for i in range(120)]
    random.Random(1).shuffle(rows)
    schema = "event_id long, ts timestamp, user_id long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        stream = monitors.read_event_stream(spark, str(tmp_path / "in"), schema, "*.parquet")
        out = monitors.run_to_table(monitors.stream_gaps(stream, "user_id", "event_id"), "g").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {r["event_id"]: (r["days_since_last"], r["late"]) for r in out} == {
        i: (None if i == 0 else 0, False) for i in range(120)}


@pytest.mark.parametrize("by_batch", [True, False])
def test_streams_go_on_where_they_ended(spark, tmp_path, by_batch):
    day, schema = dt.datetime(2024, 1, 1), "event_id long, ts timestamp, user_id long"
    for i in range(2):
        spark.createDataFrame([(i, day + dt.timedelta(days=3 * i), 7)], schema).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
        stream = monitors.read_event_stream(spark, str(tmp_path / "in"), schema, "*.parquet")
        path = str(tmp_path / "job")
        out = monitors.gaps_by_batch(stream, "user_id", "event_id", path=path) if by_batch else monitors.run_to_table(
            monitors.stream_gaps(stream, "user_id", "event_id"), "g", path=path)
    assert sorted((r["event_id"], r["days_since_last"]) for r in out.collect()) == [(0, None), (1, 3)]


@pytest.mark.parametrize("kind", ["date", "timestamp", "decimal(9,2)", "string", "double", "int"])
def test_deciles_with_any_tie_break_and_missing_scores(spark, kind):
    n = 500
    tie = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 97).cast("int"))
    tie = tie.cast(kind) if kind in ("date", "timestamp") else (F.col("id") % 97).cast(kind)
    df = spark.range(n).select("id", F.when(F.col("id") % 10 > 0, F.lit(1.0)).alias("s"),
                               F.when(F.col("id") % 50 != 3, tie).alias("t"))
    out = risk.with_decile(df, "s", "t")
    assert out.columns == ["id", "s", "t", "decile"] and out.count() == n
    last = {r["decile"] for r in out.where("s is null").collect()}
    assert last == {9}
    sizes = {r["decile"]: r["count"] for r in out.where("s is not null").groupBy("decile").count().collect()}
    assert max(sizes.values()) - min(sizes.values()) <= 16


def test_months_outside_the_list_stop_the_matrix(spark):
    df = spark.createDataFrame([(dt.date(2024, m, 1), float(m)) for m in (1, 2)], "ym date, v double")
    box = summary.boxplot(df, "ym", "v")
    assert summary.boxplot_matrix(box, "ym", ["2024-01", "2024-02"]).count() == 10
    with pytest.raises(Exception, match="month not in the list"):
        summary.boxplot_matrix(box, "ym", ["2024-01"]).collect()
