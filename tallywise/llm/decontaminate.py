"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

For every window of an item the two rarest terms are its anchors. The index holds the postings
``(term, document, position)`` of the anchors; the list of the rarest is intersected with that of the second,
moved by their distance. What is left says at which offset an item may lie in a document; there the words are
compared, and runs of equal words as long as a window are exact phrase matches. Proximity matches take as anchors
an item's rarest terms, one more than may be missing, and ask for a number of the item's terms close by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.llm.common import LOWER, UPPER, own_names
from tallywise.session import cut_lineage

#: Words are runs of anything but ASCII signs, blanks and controls.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words with A-Z in lower case; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, GAP), "")


def item_words(items: DataFrame) -> DataFrame:
    """``item, item_id, n, words`` of ``items(item_id, text)`` that have words; ``item`` tells rows apart."""
    made = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    made = made.select(F.xxhash64("item_id", "words").alias("item"), "item_id", F.size("words").alias("n"), "words")
    return made.dropDuplicates(["item"])


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, frequency``: how often each of ``terms(term)`` occurs in ``docs``; terms that do not are left out."""
    all_words = docs.select(F.explode(words(F.col("text"))).alias("term"))
    return all_words.join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))


def anchors(items: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """``item, first, second, term, term2``: positions and terms of the anchors of each item's windows.

    A window with a term that no document has can't occur and has no anchors.
    """
    placed = items.select("item", "n", F.posexplode("words").alias("position", "term"))
    placed = placed.join(frequency, "term")
    size = F.least(F.col("n"), F.lit(window))
    starts = placed.withColumn("start", F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("position") - size + 1), F.least(F.col("position"), F.col("n") - size))))
    ranked = starts.groupBy("item", "start", size.alias("size")).agg(
        F.array_sort(F.collect_list(F.struct("frequency", "term", "position"))).alias("a"))
    rare = ranked.where(F.size("a") == F.col("size"))
    other = F.coalesce(F.get("a", F.lit(1)), F.get("a", F.lit(0)))
    return rare.select("item", F.col("a")[0]["position"].alias("first"), F.col("a")[0]["term"].alias("term"),
                       other["position"].alias("second"), other["term"].alias("term2")).distinct()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: ``term, doc, position`` of each occurrence of ``terms(term)``."""
    return (docs.select("doc", F.posexplode(words(F.col("text"))).alias("position", "term"))
            .join(terms, "term").select("term", "doc", "position"))


def candidates(docs: DataFrame, items: DataFrame, window: int, frequency: DataFrame | None = None) -> DataFrame:
    """``item, doc, offset``: where both anchors of a window lie as far apart as in the item."""
    frequency = item_frequencies(docs, items) if frequency is None else frequency
    anchor = cut_lineage(anchors(items, frequency, window))
    terms = anchor.select("term").union(anchor.select(F.col("term2").alias("term"))).distinct()
    index = cut_lineage(postings(docs, cut_lineage(terms)))
    rarest = anchor.join(index, "term").select("item", "doc", "term2", "first", "second",
                                               (F.col("position") - F.col("first")).alias("offset"))
    rarest = rarest.withColumn("position", F.col("offset") + F.col("second"))
    second = index.withColumnRenamed("term", "term2")
    return rarest.join(second, ["term2", "doc", "position"], "left_semi").select("item", "doc", "offset").distinct()


def item_frequencies(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``term, frequency`` of the items' terms, stored."""
    # Stored, so that the join over all words knows the size of the terms before it runs.
    terms = cut_lineage(items.select(F.explode("words").alias("term")).distinct())
    return cut_lineage(frequencies(docs, terms))


def _spans(words_: Column, found: Column, window: int) -> Column:
    """The runs of equal words, as long as a window, of each ``(item_id, offset, n, w)`` in ``found``."""
    def runs(c: Column) -> Column:
        same = F.transform(F.sequence(F.lit(0), c["n"] - 1), lambda j: F.when(
            (j + c["offset"] >= 0) & (F.get(words_, j + c["offset"]) == F.get(c["w"], j)), "1").otherwise("0"))
        parts = F.split(F.array_join(same, ""), "0")
        size = F.least(c["n"], F.lit(window))
        # A run starts where the runs before it, each with the zero that ended it, add up to.
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
        return F.transform(F.aggregate(parts, start, lambda a, r: F.struct(
            (a["at"] + F.length(r) + 1).alias("at"),
            F.when(F.length(r) >= size, F.array_append(a["spans"], F.struct(
                a["at"].alias("start"), (a["at"] + F.length(r)).alias("end")))).otherwise(a["spans"]).alias("spans"),
        ))["spans"], lambda x: F.struct(c["item_id"].alias("item_id"), (x["start"] + c["offset"]).alias("start"),
                                        (x["end"] + c["offset"]).alias("end")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, runs))))


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """``doc, item_id, start, end``: spans of document words that hold a window of the item, word for word.

    ``docs(doc, text)`` with ``doc`` unique, ``items`` from ``item_words``. Spans are as long as the words agree.
    """
    placed = candidates(docs, items, window).join(items, "item").groupBy("doc").agg(F.collect_list(
        F.struct("item_id", "offset", "n", F.col("words").alias("w"))).alias("found"))
    found = docs.join(placed, "doc").select("doc", words(F.col("text")).alias("words"), "found")
    spans = found.select("doc", F.explode(_spans(F.col("words"), F.col("found"), window)).alias("s"))
    return spans.select("doc", "s.item_id", "s.start", "s.end")


def proximity_anchors(items: DataFrame, frequency: DataFrame, share: float) -> DataFrame:
    """``item, term``: of each item's terms the rarest, one more than may be missing. Terms no document has come first."""
    terms = items.select("item", F.explode(F.array_distinct("words")).alias("term")).join(frequency, "term", "left")
    ranked = terms.groupBy("item").agg(F.array_sort(F.collect_list(
        F.struct(F.coalesce("frequency", F.lit(0)).alias("frequency"), "term"))).alias("a"))
    enough = F.size("a") - _least_terms(F.size("a"), share) + 1
    return ranked.select("item", F.explode(F.slice("a", F.lit(1), enough)).alias("a")).where(
        "a.frequency > 0").select("item", "a.term")


def _least_terms(n: Column, share: float) -> Column:
    return F.greatest(F.ceil(F.lit(share) * n), F.lit(1)).cast("int")


def proximity_candidates(docs: DataFrame, items: DataFrame, share: float, frequency: DataFrame | None = None) -> DataFrame:
    """``item, doc``: documents that hold one of an item's rarest terms, one more than may be missing."""
    frequency = item_frequencies(docs, items) if frequency is None else frequency
    anchor = cut_lineage(proximity_anchors(items, frequency, share))
    holds = docs.select("doc", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    holds = holds.join(cut_lineage(anchor.select("term").distinct()), "term")
    return anchor.join(cut_lineage(holds), "term").select("item", "doc").distinct()


def _places(words_: Column, near: Column, within: int, share: float) -> Column:
    """The places ``(item_id, position, terms)`` of each ``(item_id, n, terms_of)`` in ``near``, in order."""
    def of(c: Column) -> Column:
        least = _least_terms(F.size(c["terms_of"]), share)
        size = F.greatest(F.lit(within), c["n"])
        starts = F.filter(F.sequence(F.lit(0), F.size(words_) - 1), lambda i: F.array_contains(c["terms_of"], F.get(words_, i)))
        found = F.filter(F.transform(starts, lambda i: F.struct(
            c["item_id"].alias("item_id"), i.alias("position"),
            F.size(F.array_intersect(F.slice(words_, i + 1, size), c["terms_of"])).alias("terms"))), lambda x: x["terms"] >= least)
        # A document without enough of the terms anywhere goes before its places are looked at.
        return F.when(F.size(F.array_intersect(words_, c["terms_of"])) >= least, found).otherwise(
            F.array().cast("array<struct<item_id:string,position:int,terms:int>>"))

    return F.array_sort(F.flatten(F.transform(near, of)))


def proximity_matches(docs: DataFrame, items: DataFrame, within: int = 30, share: float = 0.8) -> DataFrame:
    """``doc, item_id, position, terms``: places from which on ``share`` of an item's terms stand within ``within`` words.

    Places are those of a term of the item; ``terms`` counts the item's distinct terms among the ``within`` words
    from there on, or among as many as the item has if those are more. ``docs(doc, text)`` with ``doc`` unique.
    """
    per_doc = _near_items(proximity_candidates(docs, items, share), items)
    found = docs.join(per_doc, "doc").select("doc", words(F.col("text")).alias("words"), "near")
    return found.select("doc", F.explode(_places(F.col("words"), F.col("near"), within, share)).alias("p")).select("doc", "p.*")


def _near_items(pairs: DataFrame, items: DataFrame) -> DataFrame:
    terms_of = items.select("item", "item_id", "n", F.array_distinct("words").alias("terms_of"))
    return pairs.join(terms_of, "item").groupBy("doc").agg(F.collect_list(F.struct("item_id", "n", "terms_of")).alias("near"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: float = 0.05,
                  near: tuple[int, float] | None = None) -> DataFrame:
    """Each row of ``docs(doc_id, text, ...)`` with what it shares with ``items(item_id, text, ...)``.

    Adds ``n_words``, ``hits`` (spans of words ``item_id, start, end`` that hold a window of the item word for
    word), ``n_hit`` (words in any of them), ``item_ids`` (of the items in ``hits``, as sorted strings) and
    ``contaminated``: at least one of its words is hit and at least ``share`` of them. A window is ``window``
    consecutive words of an item, or the whole of a shorter one. With ``near``, words and a share, ``near_hits``
    are the places of ``proximity_matches``, ``(item_id, position, terms)`` in order. A null text has no words, an
    item without words no window; an item with a null item_id hits words but is in no list. Repeated rows give
    equal results. Columns of ``docs`` with the added names are replaced.
    """
    docs = docs.drop("n_words", "n_hit", "hits", "item_ids", "contaminated", *["near_hits"] * (near is not None))
    doc, split, found, close = own_names("doc", "words", "found", "close")
    # Rows that share this hash share their candidates; the words are compared in each row.
    keyed = docs.withColumn(doc, F.xxhash64("doc_id", "text"))
    texts, rows = keyed.select(F.col(doc).alias("doc"), "text"), item_words(items)
    frequency = item_frequencies(texts, rows)
    per_doc = candidates(texts, rows, window, frequency).join(rows, "item").groupBy("doc").agg(
        F.collect_list(F.struct("item_id", "offset", "n", F.col("words").alias("w"))).alias(found))
    if near is not None:
        close_to = _near_items(proximity_candidates(texts, rows, near[1], frequency), rows)
        per_doc = per_doc.join(close_to.withColumnRenamed("near", close), "doc", "full_outer")
    out = keyed.join(per_doc.withColumnRenamed("doc", doc), doc, "left").withColumn(split, words(F.col("text")))
    none = F.array().cast("array<struct<item_id:string,start:int,end:int>>")
    hits = F.coalesce(_spans(F.col(split), F.col(found), window), none)
    out = out.withColumn("n_words", F.size(split).cast("long")).withColumn("hits", hits)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["end"] - 1))))
    out = out.withColumn("n_hit", F.size(covered).cast("long"))
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    out = out.withColumn("item_ids", F.filter(ids, lambda i: i.isNotNull()))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(share) * F.col("n_words")))
    if near is not None:
        places = _places(F.col(split), F.col(close), *near)
        out = out.withColumn("near_hits", F.coalesce(places, F.array().cast("array<struct<item_id:string,position:int,terms:int>>")))
    return out.drop(doc, split, found, close)


def digests(docs: DataFrame) -> DataFrame:
    """Counts, the SHA-256 of the comma-joined item ids, and number and SHA-256 of the places of ``near_hits``."""
    written = F.transform("near_hits", lambda p: F.concat_ws(":", p["item_id"], p["position"].cast("string"), p["terms"].cast("string")))
    return docs.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated",
                       F.size("near_hits").cast("long").alias("n_near"),
                       F.sha2(F.concat_ws(",", F.array_sort(written)).cast("binary"), 256).alias("near_sha256"))
