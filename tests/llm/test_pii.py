"""Pseudonyms against plain Python, permutations on whole small ranges, formats."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sunloom.llm import pii
from sunloom.llm.queries import PLANS

KEY = "k1"


def mask(tweak, step, other):
    return hashlib.sha256(f"{KEY}|{tweak}|{step}|{other}".encode()).hexdigest()


def move_text(half, other, step, kind):
    m, out = mask(f"{kind}|{len(half)}", step, other), ""
    for i, c in enumerate(half):
        by = int(m[i % 16 * 4:i % 16 * 4 + 4], 16)
        first, size = (48, 10) if c in "0123456789" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (0, 0)
        out += chr((ord(c) - first + by) % size + first) if size else c
    return out


def text(value, kind):
    cut = len(value) // 2
    a, b = value[:cut], value[cut:]
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            a = move_text(a, b, i, kind)
        else:
            b = move_text(b, a, i, kind)
    return a + b


def number(value, kind, left, right):
    a, b = divmod(value, right)
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            a = (a + int(mask(kind, i, b)[:15], 16)) % left
        else:
            b = (b + int(mask(kind, i, a)[:15], 16)) % right
    return a * right + b


def luhn(payload):
    total = sum(sum(divmod(int(c) * 2, 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(payload)))
    return str(-total % 10)


def refill(shape, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isdigit() else c for c in shape)


def plain(value):
    """(kind, pseudonym) of a match, or None."""
    digits = re.sub(r"\D", "", value)
    if "@" in value:
        local, domain = value.split("@", 1)
        return "email", text(local, "email") + "@" + domain
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", value):
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255:
            return None
        x = number(int.from_bytes(bytes(octets), "big"), "ip", 1 << 16, 1 << 16)
        return "ip", ".".join(map(str, x.to_bytes(4, "big")))
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)|(\d\d)([./])(\d\d)[./](\d{4})", value):
        y, mo, d = (m[1], m[2], m[3]) if m[1] else (m[7], m[6], m[4])
        try:
            day = (datetime.date(int(y), int(mo), int(d)) - datetime.date(1900, 1, 1)).days
        except ValueError:
            return None
        if not 0 <= day < 270 * 271:
            return None
        new = datetime.date(1900, 1, 1) + datetime.timedelta(number(day, "date", 270, 271))
        return "date", new.strftime("%Y-%m-%d" if m[1] else f"%d{m[5]}%m{m[5]}%Y")
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", value):
        a, g, s = int(value[:3]), int(value[4:6]), int(value[7:])
        if a in (0, 666) or a > 899 or not g or not s:
            return None
        x = number((a - (2 if a > 666 else 1)) * 989901 + (g - 1) * 9999 + s - 1, "ssn", 898, 989901)
        a = x // 989901 + 1
        return "ssn", f"{a + (a >= 666):03d}-{x % 989901 // 9999 + 1:02d}-{x % 989901 % 9999 + 1:04d}"
    if value[0] in "+(":
        if not 10 <= len(digits) <= 15:
            return None
        m = re.match(r"\+\d{1,3}(?=[ .(-])", value)
        country = m[0] if m else ""
        local = value[len(country):]
        return "phone", country + refill(local, text(re.sub(r"\D", "", local), "phone"))
    if luhn(digits[:-1]) == digits[-1]:
        payload = text(digits[:-1], "card")
        return "card", refill(value, payload + luhn(payload))
    return None


VALUES = ["und.34@mail7.example.com", "A.b-C_9+x@a-b.co.uk", "é.ñ12@x.org", "97.51.17.173", "0.0.0.0", "255.255.255.255", "256.1.1.1", "1900-01-01",
          "2100-05-01", "2100-05-02", "2024-02-29", "2023-02-29", "31.12.1999", "05/06/2020", "123-45-6789", "666-45-6789", "000-12-3456",
          "899-99-9999", "665-01-0001", "667-01-0001", "+1 (017) 555-7713", "(030) 1234 5678", "+49 170 1234567", "+491701234567",
          "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "6011000990139424"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, f"Say {v}, then {v}. End", "x") for i, v in enumerate(VALUES)]
    rows += [(100, None, "x"), (101, "", None), (102, "no data, only 3.14 and 12:30 and v1.2.3.4.5", "x"), (None, " and ".join(VALUES), "x"),
             (103, "x" * 5000 + "@" + "y" * 5000 + " 1" * 4000 + "@", "x"), (103, "a1234567890123456f 12345678901234567890123", "x"),
             (0, "Say und.34@mail7.example.com, then und.34@mail7.example.com. End", "x"), (104, VALUES[0], "x")]
    return rows, pii.pseudonymised(spark.createDataFrame(rows, "doc_id bigint, text string, kind string"), KEY).collect()


def test_against_plain(table):
    rows, got = table
    pattern = re.compile(pii.PATTERN.replace(r"\p{L}\p{N}", r"\w").replace(r"\p{L}", "A-Za-z").replace("{1,64}+", "{1,64}"))
    by_text = {}
    for i, source, _ in rows:
        if source:
            found = [m.group() for m in pattern.finditer(source)]
            want = pattern.sub(lambda m: (plain(m.group()) or (0, m.group()))[1], source)
            by_text.setdefault(i, []).append((want, [p for v in found if (p := plain(v))]))
        else:
            by_text.setdefault(i, []).append((source, []))
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, [tuple(x) for x in r.replaced]) in by_text[r.doc_id]


def test_linked_and_valid(table):
    _, got = table
    rows = {r.doc_id: r for r in got}
    kinds = {VALUES[k]: {x.kind for x in rows[k].replaced} for k in range(len(VALUES))}
    assert not any(kinds[v] for v in ("256.1.1.1", "2100-05-02", "2023-02-29", "666-45-6789", "000-12-3456", "4111-1111-1111-1112"))
    assert all(kinds[v] for v in VALUES if v not in ("256.1.1.1", "2100-05-02", "2023-02-29", "666-45-6789", "000-12-3456", "4111-1111-1111-1112"))
    plain_card, spaced = (rows[VALUES.index(v)].replaced[0].pseudonym for v in ("4111111111111111", "4111 1111 1111 1111"))
    assert plain_card == spaced.replace(" ", "") != "4111111111111111"
    assert rows[104].text == rows[0].replaced[0].pseudonym


def test_permutations(spark):
    for left, right in ((7, 11), (5, 5), (1, 9)):
        got = [r.p for r in spark.range(left * right).select(pii.permuted_number(F.col("id"), KEY, "t", left, right).alias("p")).collect()]
        assert sorted(got) == list(range(left * right))
    three = spark.range(1000).select(pii.permuted_text(F.lpad(F.col("id").cast("string"), 3, "0"), KEY, "t").alias("p"))
    assert three.select(F.countDistinct("p")).first()[0] == 1000


def test_query(spark, small):
    rows = {r.doc_id: r for r in PLANS["op5_pii"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    hits = 0

    def valid(p):
        return not p.isdigit() or luhn(p[:-1]) == p[-1]
    for d in docs:
        private = re.findall(r"\w+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)", d.text)
        private = [p for p in private if valid(p)]
        hits += len(private)
        # a short value can by chance be permuted to itself, a long one hardly
        assert not [p for p in private if p in rows[d.doc_id].text and len(p) > 8]
        if not re.search(r"\d", d.text):
            assert rows[d.doc_id].text == d.text and rows[d.doc_id].n_found == 0
    assert hits


def test_empty(spark):
    assert pii.pseudonymised(spark.createDataFrame([], "doc_id bigint, text string"), KEY).count() == 0
    odd = spark.createDataFrame([("a 4111111111111111", 1, 2)], "text string, replaced int, found int")
    got = pii.pseudonymised(odd, KEY)
    assert got.columns == ["text", "found", "replaced"] and got.first().found == 2 and got.first().replaced[0].kind == "card"


CARD = "4111111111111111"


def test_next_to_numbers(spark):
    texts = [f"4111 1111 1111 1111 12/25", f"{CARD} 123", f"room 12 {CARD}", f"1 2 3 4 5 6 4111 1111 1111 1111 7 8", f"{CARD} {CARD}", "7 123-45-6789 2024-02-29 5",
             "12/31/1999", "13/32/1999", "call 212-555-0123 now", "212.555.0124", "212 555 0125 12345", "1 2 3 4 5 6 7 8 9 1 2 3 4 5"]
    kinds = [["card"], ["card"], ["card"], ["card"], ["card"] * 2, ["ssn", "date"], ["date"], [], ["phone"], ["phone"], ["phone"], []]
    got = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), KEY).orderBy("doc_id").collect()
    assert [[x.kind for x in r.replaced] for r in got] == kinds
    want = pii.pseudonymised(spark.createDataFrame([(CARD,)], "text string"), KEY).first().text
    for r, source in zip(got, texts):
        assert re.sub(r"\d", "0", r.text) == re.sub(r"\d", "0", source) and (r.text == source) == (not r.replaced)
    assert got[1].text == f"{want} 123" and got[2].text == f"room 12 {want}" and got[4].text == f"{want} {want}"
    assert got[3].text.replace(" ", "") == f"123456{want}78"


def test_late_days(spark):
    days = spark.range(44321).select(pii._late_day(F.col("id")).alias("day"), "id")
    back = days.select("id", F.date_format("day", "MM/dd/yyyy").alias("text")).select("id", "text", pii._late(F.col("text")).alias("back"))
    assert back.where("back IS NULL OR back <> id").count() == 0 and back.select(F.countDistinct("text")).first()[0] == 44321
