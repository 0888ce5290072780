"""Text expressions over one row: tokens are arrays, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Negations that stay in the text although stop-word lists hold them.
KEPT_NEGATIONS = (
    "don't", "not", "no", "cannot", "won't", "haven't", "can't", "wasn't", "weren't",
    "dont", "wont", "havent", "cant", "wasnt", "werent", "wouldnt",
)


def english_stop_words(keep: Sequence[str] = KEPT_NEGATIONS) -> list[str]:
    """Spark's English stop words without the ones to keep."""
    from pyspark.ml.feature import StopWordsRemover

    kept = set(keep)
    return [w for w in StopWordsRemover.loadDefaultStopWords("english") if w not in kept]


def strip_punctuation(text: Column) -> Column:
    """Drop all but letters, digits, underscore and white space, accented letters included."""
    return F.regexp_replace(text, r"(?U)[^\p{L}\p{N}_\s]", "")


def words(text: Column) -> Column:
    """Lower-case tokens of the text without punctuation, in order."""
    return F.filter(F.split(F.lower(strip_punctuation(text)), r"(?U)\s+"), lambda w: w != "")


def drop_stop_words(tokens: Column, stop_words: Sequence[str]) -> Column:
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda w: ~w.isin(*stop_words))


def term_tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def one_and_two_grams(tokens: Column) -> Column:
    """The tokens, then each pair of neighbours joined by a space."""
    def grams(own: Column) -> Column:
        pairs = F.zip_with(
            F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))),
            F.slice(own, 2, F.greatest(F.size(own), F.lit(1))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        return F.concat(own, pairs)

    # The tokens are bound to a variable: written out, their expression would be worked out five times a row.
    return F.get(F.transform(F.array(tokens), grams), F.lit(0))
