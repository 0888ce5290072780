"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

The edit distance counts words. Lines one edit apart have a variant in common: both without the word that was
changed, or the longer one without the word that was added. Equal variants join lines, and of each variant's
lines only the earliest is joined with the others, so that a group of alike lines is never paired with itself.
Lines one edit apart also have the words of their first or of their last half in common; variants are made
only of lines that share such a half with a different line.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.llm.common import own_names
from tallywise.session import cut_lineage, scratch_path

#: A line's place: doc_id, then line number, as one number; a null doc_id comes first.
LOWEST = -2**63
PLACE = "decimal(38,0)"
#: Words that running values are worked out for at a time.
BLOCK = 256


def _place(doc_id: Column, line: Column) -> Column:
    return (F.coalesce(doc_id, F.lit(LOWEST)).cast("decimal(20,0)") * F.lit(10**10).cast("decimal(11,0)")
            + line.cast("decimal(11,0)")).cast(PLACE)


def _halves(words: Column) -> Column:
    """Hashes of the first and of the last half, as they are with a line as long or shorter, and with a longer one."""
    n = F.size(words)
    lengths = [F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")]
    made = [F.xxhash64(k, F.lit(0), F.slice(words, 1, k)) for k in lengths]
    made += [F.xxhash64(k, F.lit(1), F.slice(words, -k, k)) for k in lengths]
    return F.array_distinct(F.array(*made))


def _running(values: Column) -> Column:
    """Running exclusive-or of some values: entry ``i`` covers those before ``i``, one entry more than values."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")),
                       lambda a, x: F.array_append(a, F.element_at(a, -1).bitwiseXOR(x)))


def _with_running(lines: DataFrame, name: str, shift: int) -> DataFrame:
    """``lines(words, ...)`` with the running exclusive-or of the words' hashes at their places plus ``shift``.

    Blocks are added up for themselves and moved by what comes before them, as appending copies an array: a line
    of a million words takes some four thousand blocks.
    """
    blocks, before = own_names("blocks", "before")
    hashed = F.transform("words", lambda w, i: F.xxhash64(w, i + shift))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("words") / BLOCK).cast("int") - 1))
    made = lines.withColumn(name, hashed)
    # Two references keep the hashes from being worked out again for each block.
    made = made.withColumn(blocks, F.when(F.size(name) > 0, F.transform(
        starts, lambda b: _running(F.slice(F.col(name), b * BLOCK + 1, BLOCK)))).otherwise(F.array(F.array(F.lit(0).cast("long")))))
    made = made.withColumn(before, _running(F.transform(blocks, lambda s: F.element_at(s, -1))))
    parts = F.transform(F.filter(F.arrays_zip(F.col(blocks).alias("s"), F.col(before).alias("o")), lambda z: z["s"].isNotNull()),
                        lambda z: F.transform(F.slice(z["s"], F.lit(1), F.size(z["s"]) - 1), lambda x: x.bitwiseXOR(z["o"])))
    whole = F.concat(F.flatten(parts), F.array(F.element_at(before, -1)))
    return made.withColumn(name, whole).drop(blocks, before)


def variants(lines: DataFrame) -> DataFrame:
    """``place, v, p`` of ``lines(place, words)``: without word ``p``, or for ``p`` = -1 whole; a hash of the words."""
    n = F.size("words")
    made = _with_running(_with_running(lines.select("place", "words"), "before", 0), "moved", -1)
    without = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.struct(
        F.get("before", p).bitwiseXOR(F.get("moved", n)).bitwiseXOR(F.get("moved", p + 1)).alias("v"), p.alias("p")))
    whole = F.array(F.struct(F.get("before", n).alias("v"), F.lit(-1).alias("p")))
    return made.select("place", F.explode(F.concat(whole, without)).alias("x")).select("place", "x.*")


def within_one_edit(a: Column, b: Column) -> Column:
    """Word arrays at an edit distance of one or none: what they share at both ends leaves one word at most."""
    short = F.least(F.size(a), F.size(b))
    differs = lambda i: F.get(a, i) != F.get(b, i)
    differs_back = lambda i: F.element_at(a, -i - 1) != F.element_at(b, -i - 1)
    places = F.sequence(F.lit(0), short - 1)
    front = F.coalesce(F.get(F.filter(places, differs), F.lit(0)), short)
    back = F.coalesce(F.get(F.filter(places, differs_back), F.lit(0)), short)
    return front + back >= F.greatest(F.size(a), F.size(b)) - 1


def repeated_lines(texts: DataFrame, least_words: int = 5) -> DataFrame:
    """``row, lines``: per ``row`` the ``(tie, line)`` to remove from ``texts(row, tie, doc_id, text)``.

    ``row`` and ``tie`` are hashes of a row, and ``texts`` is partitioned by the first; rows that share both have
    the same doc_id and text.
    """
    split = texts.select("row", "tie", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    split = split.where(F.col("content") != "").withColumn("words", F.split("content", " "))
    lines = cut_lineage(split.select("row", "tie", _place(F.col("doc_id"), F.col("line")).alias("place"), "line",
                                     F.xxhash64("words").alias("h"), F.hash("words").alias("g"),
                                     # Of short lines only exact copies count: they have no halves to share.
                                     F.when(F.size("words") >= least_words, _halves(F.col("words"))).alias("halves")))
    first = lines.groupBy("h", "g").agg(F.min("place").alias("first"))
    copies = lines.select("row", "tie", "line", "place", "h", "g").join(first, ["h", "g"]).where("place > first")
    halves = lines.select("h", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high")
    near = halves.join(shared.select("half"), "half", "left_semi").select("h").distinct()
    some = cut_lineage(lines.select("row", "tie", "line", "place", "h", "g").join(near, "h", "left_semi")
                       .join(first, ["h", "g"]).where("place = first").select("row", "tie", "line", "place", "h", "g"))
    wanted = some.groupBy("row").agg(F.collect_set(F.struct("tie", "line", "place", "h")).alias("wanted"))
    # The lines are split below the join, so that each wanted one is taken from the array by its number.
    own = texts.select("row", F.col("tie").alias("own"), F.split("text", "\n", -1).alias("all")).join(wanted, "row")
    candidates = cut_lineage(own.select("row", F.explode(F.transform(
        F.filter("wanted", lambda w: w["tie"] == F.col("own")), lambda w: F.struct(
            w["tie"].alias("tie"), w["line"].alias("line"), w["place"].alias("place"), w["h"].alias("h"),
            F.split(F.get("all", w["line"]), " ").alias("words")))).alias("w")).select("row", "w.*"))
    made = cut_lineage(variants(candidates.select("place", "words")))
    # Changed words: lines without the same place are alike. Added words: a whole line equals another's variant.
    lead = made.groupBy("v", "p").agg(F.min("place").alias("lead"), F.count(F.lit(1)).alias("k"))
    changed = made.join(lead.where("k > 1 and p >= 0").drop("k"), ["v", "p"]).where("lead < place")
    whole = made.where("p = -1").select("v", F.col("place").alias("whole"))
    pairs = made.where("p >= 0").select("v", "place").join(whole, "v")
    added = pairs.select(F.greatest("place", "whole").alias("place"), F.least("place", "whole").alias("lead"))
    found = changed.select("place", "lead").union(added).where("lead < place")
    earliest = found.groupBy("place").agg(F.min("lead").alias("lead"))
    mine = candidates.select("row", "tie", "line", "place", "words")
    other = candidates.select(F.col("place").alias("lead"), F.col("words").alias("others"))
    alike = earliest.join(mine, "place").join(other, "lead").where(within_one_edit(F.col("words"), F.col("others")))
    # All copies of a line go if an earlier line is like it; those of its own are in `copies` already.
    removed = copies.select("row", "tie", "line").union(alike.select("row", "tie", "line"))
    return removed.groupBy("row").agg(F.collect_set(F.struct("tie", "line")).alias("lines"))


def _without(lines: Column, numbers: Column) -> Column:
    """An array without the entries at some numbers, in order; in one pass over each."""
    gaps = F.transform(numbers, lambda x, k: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get(numbers, k - 1), F.lit(-1)) - 1),
                                                      F.lit("1")))
    marks = F.split(F.array_join(gaps, ""), "")
    both = F.arrays_zip(lines.alias("x"), marks.alias("m"))
    kept = F.filter(both, lambda z: z["x"].isNotNull() & F.coalesce(z["m"] != "1", F.lit(True)))
    return F.transform(kept, lambda z: z["x"])


def dedup(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` with ``text`` less its repeated lines, and ``removed_lines``.

    Lines end at a line feed, words at a blank. A line that is not empty is removed if an earlier line, removed
    or not, equals it, or if both have ``least_words`` words or more and differ by one added, missing or changed
    word; earlier is in a document with a smaller doc_id (null first), or further up in the same one. Empty lines
    stay. ``removed_lines`` are the numbers of the removed lines, from 0. The other lines keep their order; a
    text without removed lines is unchanged, a null one stays null. Rows that share a doc_id count as one
    document: equal lines with the same number in both are earlier in neither. Repeated rows give equal results;
    doc_id is a whole number; other columns are kept, a column named removed_lines is replaced.
    """
    spark = docs.sparkSession
    row, tie, found, numbers = own_names("row", "tie", "found", "numbers")
    names = [c for c in docs.columns if c != "removed_lines"]
    made = docs.select(*names, F.xxhash64("doc_id", "text").alias(row), F.xxhash64("text", F.lit(7), "doc_id").alias(tie))
    # Written in buckets by row, so that the two joins below move no text.
    name = f"lines_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.bucketBy(buckets, row).option("path", scratch_path(spark, "lines")).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files are external, and `stored` knows them
    lines = repeated_lines(stored.select(F.col(row).alias("row"), F.col(tie).alias("tie"), "doc_id", "text"), least_words)
    joined = stored.join(lines.withColumnRenamed("row", row).withColumnRenamed("lines", found), row, "left")
    own = F.transform(F.filter(F.coalesce(found, F.array().cast("array<struct<tie:bigint,line:int>>")),
                               lambda x: x["tie"] == F.col(tie)), lambda x: x["line"])
    joined = joined.withColumn(numbers, F.array_sort(own))
    kept = F.array_join(_without(F.split("text", "\n", -1), F.col(numbers)), "\n")
    text = F.when(F.size(numbers) == 0, F.col("text")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in names], F.col(numbers).alias("removed_lines"))
