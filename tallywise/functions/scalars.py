"""Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def safe_ratio(num: Column, den: Column) -> Column:
    """0 where the denominator is 0, NULL where either side is missing, else the quotient."""
    return F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(num.cast("double"), den.cast("double")))


def safe_flag(condition: Column) -> Column:
    """A two-valued flag: a comparison with a missing value counts as false."""
    return F.coalesce(condition, F.lit(False))


def exact_mean(amount: Column) -> Column:
    """Mean as (exact sum) / count, so that the result does not depend on the order of rows."""
    return F.try_divide(F.sum(amount).cast("double"), F.count(amount).cast("double"))


def half_even(x: Column, places: int) -> Column:
    """Round half to even on the scaled double, the way the original's tables are rounded."""
    scale = F.lit(float(10 ** places))
    return F.rint(x.cast("double") * scale) / scale


def number_label(number: Column, name: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(" – "), name)


def to_number(text: Column, kind: str = "double") -> Column:
    """Text to number; what is not a number becomes NULL."""
    return F.trim(text.cast("string")).try_cast(kind)


def fill_unknown(value: Column, marker: str = "UNK") -> Column:
    return F.coalesce(value.cast("string"), F.lit(marker))


def month_from_yyyymm(value: Column) -> Column:
    return F.to_date(value.cast("string"), "yyyyMM")


def parse_us_timestamp(text: Column) -> Column:
    """``MM/dd/yyyy hh:mm:ss AM``; NULL where the text does not fit."""
    return F.try_to_timestamp(text, F.lit("M/d/yyyy h:mm:ss a"))


def month_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "month")


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def calendar_day(ts: Column) -> Column:
    return F.to_date(ts)


def week_start(ts: Column) -> Column:
    """Monday of the week."""
    return F.trunc(F.to_date(ts), "week")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def whole_days(later: Column, earlier: Column) -> Column:
    """Difference floored to whole 24-hour days (-2 hours gives -1)."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(MICROS_PER_DAY))


def hms_is_valid(text: Column) -> Column:
    """Two colons, eight characters, digits between."""
    return safe_flag((F.length(text) == 8) & text.rlike(r"^\d+:\d+:\d+$"))


def hms_seconds(text: Column) -> Column:
    """``hh:mm:ss`` to seconds; NULL where the text is malformed."""
    parts = F.split(text, ":")
    hours, minutes, seconds = (F.get(parts, i).try_cast("bigint") for i in range(3))
    return F.when(hms_is_valid(text), hours * 3600 + minutes * 60 + seconds)


def now_text() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def softmax(scores: Sequence[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    powers = [F.exp(s - top) for s in scores]
    total = reduce(lambda a, b: a + b, powers)
    return [p / total for p in powers]


def probability_label(low: Column, high: Column) -> Column:
    return F.format_string("%.4f–%.4f%%", low * 100, high * 100)


def count_true(conditions: Sequence[Column]) -> Column:
    """How many of the conditions hold."""
    return reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in conditions])


def parse_list_literal(text: Column) -> Column:
    """``"['a','b']"`` to an array of strings."""
    return F.from_json(text, "array<string>")
