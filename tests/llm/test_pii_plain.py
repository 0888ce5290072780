"""Pseudonyms against a plain finder and a plain Feistel network, on the documents and on odd texts."""

import hashlib
import random
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from tallywise.llm import pii

KEY = "a key"


def permute(value, left, right, kind):
    l, r = divmod(value, right)  # noqa: E741
    for i in range(8):
        most, part = (left, r) if i % 2 == 0 else (right, l)
        text = "|".join(map(str, (KEY, kind, most, i, part)))
        step = int(hashlib.sha256(text.encode()).hexdigest()[:15], 16) % most
        l, r = ((l + step) % left, r) if i % 2 == 0 else (l, (r + step) % right)  # noqa: E741
    return l * right + r


def digits(d, kind):
    half = len(d) // 2
    return str(permute(int(d), 10**half, 10 ** (len(d) - half), kind)).zfill(len(d))


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10


def refill(pattern, new):
    left = iter(new)
    return "".join(next(left) if c.isdigit() else c for c in pattern)


def judged(token):
    whole = lambda p: re.fullmatch(p, token, re.A)
    d = re.sub("[^0-9]", "", token)
    if whole(pii.EMAIL):
        local, _, domain = token.partition("@")
        name = hashlib.sha256(f"{KEY}|email|{local.lower()}|@{domain.lower()}".encode()).hexdigest()[:12]
        return "email", f"user{name}@{domain}"
    if whole(pii.PHONE) and 8 <= len(d) <= 15:
        country = min(len(re.match(r"\+(\d{1,3})", token).group(1)), len(d) - 6)
        return "phone", refill(token, d[:country] + digits(d[country:], "phone"))
    for form, order in ((pii.ISO_DATE, (0, 1, 2)), (pii.DOT_DATE, (2, 1, 0)), (pii.SLASH_DATE, (2, 0, 1))):
        if whole(form):
            parts, sign = re.split(r"([-./])", token)[::2], re.sub(r"\d", "", token)[0]
            try:
                n = (date(*(int(parts[i]) for i in order)) - date(1900, 1, 1)).days
            except ValueError:
                n = -1
            if 0 <= n < 271 * 270:
                new = date(1900, 1, 1) + timedelta(permute(n, 271, 270, "date"))
                named = (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}")
                return "date", sign.join(named[order.index(place)] for place in range(3))
    if whole(pii.SSN):
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        if 0 < area < 900 and area != 666 and group and serial:
            n = permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
            area, group = divmod(n // 9999, 99)
            return "ssn", f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{n % 9999 + 1:04d}"
    if whole(pii.IPV4) and all(int(x) < 256 for x in token.split(".")):
        n = permute(int.from_bytes(bytes(map(int, token.split("."))), "big"), 65536, 65536, "ip")
        return "ip", ".".join(map(str, n.to_bytes(4, "big")))
    if whole(pii.CARD) and luhn(d) == 0:
        body = digits(d[:-1], "card")
        return "card", refill(token, body + next(c for c in "0123456789" if luhn(body + c) == 0))
    return None, token


def plain(text):
    kinds = []

    def put(m):
        kind, new = judged(m.group())
        kinds.extend([kind] * (kind is not None))
        return new

    return (None, []) if text is None else (re.sub(pii.PATTERN, put, text, flags=re.A), kinds)


def odd_texts():
    rng = random.Random(12)
    card = lambda n: (lambda b: b + next(c for c in "0123456789" if luhn(b + c) == 0))("".join(rng.choice("0123456789") for _ in range(n - 1)))
    bits = ["2024-02-29", "2023-02-29", "31.12.1999", "12/31/1999", "31/12/1999", "1899-12-31", "2100-05-01", "2100-05-02",
            "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "123-45-6789", "666-12-1234", "900-12-1234", "000-11-2222", "+49 30 1234567",
            "+1 (555) 123 4567", "+1234567", "A.b+c@Mail.example.org", "x@y", "@", "é1", "-1", "1.5", card(16), card(13), card(19), "4111 1111 1111 1111",
            "4111-1111-1111-1112", "word", ",", "\n", "３"]
    return ["".join(rng.choice(bits) + rng.choice([" ", " ", "", "x", "."]) for _ in range(rng.randint(1, 25))) for _ in range(300)]


def test_like_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in docs.collect()] + odd_texts() + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.pii_kinds) for r in pii.pseudonymize(df, KEY).collect()}
    want = {i: plain(t) for i, t in enumerate(texts)}
    assert got == want
    kinds = {k for _, ks in want.values() for k in ks}
    assert kinds == {"email", "phone", "date", "ssn", "ip", "card"}


def test_any_column_names(spark):
    names = ("found", "gaps", "judged", "_found", "_gaps", "_new", "kind", "value", "l", "r")
    df = spark.createDataFrame([(1, "at 10.0.0.1", 5)], "doc_id long, text string, n int").select("*", *(F.lit(n).alias(n) for n in names))
    row = pii.pseudonymize(df, KEY).first()
    assert row.text == plain("at 10.0.0.1")[0] and row.n == 5 and all(row[n] == n for n in names)
