"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions only.

A validated value is turned into a number below ``left * right``, permuted by a keyed Feistel network over
these two parts, and written in the form it was found in. The same value with the same key gives the same
pseudonym in every document, two values never share one, and who has the key can turn them back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.llm.common import own_names

ROUNDS = 8

# The written forms that are looked for, and what may not stand next to them.
DIGITS_BEFORE, DIGITS_AFTER = r"(?<![\d.+\-])", r"(?![\d\-]|\.\d)"
EMAIL = r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
ISO_DATE = r"\d{4}-\d{2}-\d{2}"
DOT_DATE = r"\d{2}\.\d{2}\.\d{4}"
SLASH_DATE = r"\d{2}/\d{2}/\d{4}"
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"
SSN = r"\d{3}-\d{2}-\d{4}"
CARD = r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}"
PATTERN = (f"{EMAIL}|{PHONE}|{DIGITS_BEFORE}(?:{ISO_DATE}|{DOT_DATE}|{SLASH_DATE}|{SSN}|{IPV4}|{CARD})"
           f"{DIGITS_AFTER}")
#: Dates from 1900-01-01 are permuted among 271 x 270 days, to 2100-05-01.
FIRST_DAY, DAYS = "1900-01-01", (271, 270)


@dataclass(frozen=True)
class Feistel:
    """Alternating rounds on ``(left, right)`` parts; ``back`` runs them the other way round."""

    key: str
    back: bool = False

    def _round(self, kind: str, i: Column, part: Column, most: Column) -> Column:
        text = F.concat_ws("|", F.lit(self.key), F.lit(kind), most.cast("string"), i.cast("string"),
                           part.cast("string"))
        digest = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")
        return F.pmod(digest, most)

    def permute(self, value: Column, left, right, kind: str) -> Column:
        """``value`` in ``0 .. left * right - 1`` to another one, one to one."""
        left, right = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (left, right))
        sign = F.lit(-1 if self.back else 1).cast("long")
        start = F.struct(F.call_function("div", value, right).alias("l"), (value % right).alias("r"))
        order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if self.back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

        def step(s: Column, i: Column) -> Column:
            return F.when(i % 2 == 0, F.struct(
                F.pmod(s["l"] + sign * self._round(kind, i, s["r"], left), left).alias("l"), s["r"].alias("r"))
            ).otherwise(F.struct(
                s["l"].alias("l"), F.pmod(s["r"] + sign * self._round(kind, i, s["l"], right), right).alias("r")))

        return F.aggregate(order, start, step, lambda s: s["l"] * right + s["r"])

    def digits(self, digits: Column, kind: str) -> Column:
        """A string of 2 to 18 digits to another of its length."""
        n = F.length(digits)
        half = F.call_function("div", n, F.lit(2)).cast("int")
        left = F.pow(F.lit(10.0), half).cast("long")
        right = F.pow(F.lit(10.0), n - half).cast("long")
        number = self.permute(digits.cast("long"), left, right, kind)
        return F.lpad(number.cast("string"), n, "0")


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column, odd: int) -> Column:
    """Sum with every second digit doubled, from the right; ``odd`` = 1 doubles the last one."""
    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(F.transform(places, lambda i: F.when(
        i % 2 == odd, F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))),
                            F.substr(digits, -i, F.lit(1)).cast("int")))
        .otherwise(F.substr(digits, -i, F.lit(1)).cast("int"))), F.lit(0), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, 0) % 10 == 0


def refill(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced by ``digits`` in turn; what stands between them stays."""
    chars = F.split(pattern, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(chars, start, lambda s, c: F.when(c.rlike("[0-9]"), F.struct(
        F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))), lambda s: s["out"])


def _date(token: Column, form: str, network: Feistel) -> tuple[Column, Column]:
    day = F.to_date(F.try_to_timestamp(token, F.lit(form)))
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    valid = F.coalesce((number >= 0) & (number < DAYS[0] * DAYS[1]), F.lit(False))
    other = F.date_add(F.lit(FIRST_DAY).cast("date"), network.permute(number, *DAYS, "date").cast("int"))
    return valid, F.date_format(other, form)


def _judged(token: Column, network: Feistel) -> Column:
    """``struct(kind, value)``: the kind of a valid value and its pseudonym; kind is null for any other text."""
    digits = only_digits(token)
    whole = lambda p: token.rlike(f"^(?:{p})$")
    cases: list[tuple[str, Column, Column]] = []

    at = F.instr(token, "@")
    local, domain = F.lower(F.substr(token, F.lit(1), at - 1)), F.substr(token, at)
    masked = F.concat(F.lit("user"), F.substring(F.sha2(F.concat_ws(
        "|", F.lit(network.key), F.lit("email"), local, F.lower(domain)).cast("binary"), 256), 1, 12), domain)
    cases.append(("email", whole(EMAIL), token if network.back else masked))

    n = F.length(digits)
    country = F.length(F.regexp_extract(token, r"^\+(\d{1,3})", 1))
    country = F.least(country, n - 6)
    rest = F.substr(digits, country + 1)
    cases.append(("phone", whole(PHONE) & n.between(8, 15), refill(token, F.concat(
        F.substr(digits, F.lit(1), country), network.digits(rest, "phone")))))

    for form, written in (("yyyy-MM-dd", ISO_DATE), ("dd.MM.yyyy", DOT_DATE), ("MM/dd/yyyy", SLASH_DATE)):
        valid, other = _date(token, form, network)
        cases.append(("date", whole(written) & valid, other))

    area, group, serial = (F.substr(digits, F.lit(a), F.lit(b)).cast("long") for a, b in ((1, 3), (4, 2), (6, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    number = network.permute((index * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
    high = F.call_function("div", number, F.lit(9999))
    index = F.call_function("div", high, F.lit(99))
    area = F.when(index >= 665, index + 2).otherwise(index + 1)
    cases.append(("ssn", whole(SSN) & valid, F.format_string("%03d-%02d-%04d", area, high % 99 + 1, number % 9999 + 1)))

    octets = F.split(token, r"\.")
    o = [F.get(octets, F.lit(i)).try_cast("long") for i in range(4)]
    valid = F.coalesce((o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256), F.lit(False))
    number = network.permute(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65536, 65536, "ip")
    part = [F.shiftright(number, s).bitwiseAND(F.lit(255).cast("long")) for s in (24, 16, 8, 0)]
    cases.append(("ip", whole(IPV4) & valid, F.concat_ws(".", *[p.cast("string") for p in part])))

    body = network.digits(F.substr(digits, F.lit(1), n - 1), "card")
    check = F.pmod(F.lit(10) - _luhn_sum(body, 1) % 10, F.lit(10)).cast("string")
    cases.append(("card", whole(CARD) & luhn_valid(digits), refill(token, F.concat(body, check))))

    out = F.struct(F.lit(None).cast("string").alias("kind"), token.alias("value"))
    for kind, valid, value in reversed(cases):
        out = F.when(valid, F.struct(F.lit(kind).alias("kind"), value.alias("value"))).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """The rows of ``docs(text, ...)`` with personal values in ``text`` replaced, and their kinds in ``pii_kinds``.

    Replaced are: card numbers of 13 to 19 digits with a right check digit (the pseudonym has one too), dates
    that exist between 1900-01-01 and 2100-05-01 as yyyy-MM-dd, dd.MM.yyyy or MM/dd/yyyy, IPv4 addresses,
    US social security numbers that can have been given out, and phone numbers of 8 to 15 digits that start
    with a plus sign (the country code stays). Blanks, dots, brackets and hyphens stay where they are. Values
    written differently but with equal digits get equal digits. E-mail addresses get a keyed local part; only
    these can't be turned back. Other text, and values that are not valid, stay as they are. ``back`` undoes
    the replacement made with the same key. A null text stays null and has no kinds. Repeated rows give equal
    results; other columns are kept, a column named pii_kinds is replaced.
    """
    network = Feistel(key, back)
    names = [c for c in docs.columns if c != "pii_kinds"]
    text = F.when(F.col("text").rlike("[0-9@]"), F.col("text"))
    found, gaps, judged = own_names("found", "gaps", "judged")
    parts = docs.select(*names, F.regexp_extract_all(text, F.lit(PATTERN), 0).alias(found),
                        F.split(text, PATTERN, -1).alias(gaps))
    parts = parts.withColumn(judged, F.transform(found, lambda t: _judged(t, network)))
    joined = F.array_join(F.zip_with(gaps, judged, lambda g, v: F.concat(g, F.coalesce(v["value"], F.lit("")))), "")
    new = F.when(F.size(found) > 0, joined).otherwise(F.col("text"))
    kinds = F.filter(F.coalesce(F.transform(judged, lambda v: v["kind"]), F.array().cast("array<string>")),
                     lambda k: k.isNotNull())
    return parts.select(*[new.alias(c) if c == "text" else F.col(c) for c in names], kinds.alias("pii_kinds"))
