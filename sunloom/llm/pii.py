"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Numbers and addresses are found by pattern and validated; what passes is permuted within its own format by a keyed Feistel
network, so a value has the same pseudonym in every document, different values have different ones, and who has the key can
invert them. Nothing is looked up or shuffled; a row's work depends on its text alone.

    email   letters and digits of the local part are permuted in their kind, the domain stays
    ip      four octets up to 255, permuted over all addresses
    date    yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy; real days from 1900-01-01 on, permuted over 73,170 days; where dd/mm is no day,
            mm/dd/yyyy, permuted over the 44,321 days up to April 2100 that only this reading has
    ssn     ddd-dd-dddd with a valid area, group and serial, permuted over the valid ones
    phone   10 to 15 digits with a country code or an area code in brackets; a country code that stands apart stays;
            ten digits as 3-3-4 with the same blank, point or hyphen twice
    card    13 to 19 digits, single blanks or hyphens between them, with a right check digit; the pseudonym has one, too

A run of digits, single blanks and hyphens (`RUN` digits at most at a time) that is no value itself is searched for values that begin and
end at a separator. From the left, the longest; cards in their usual groups go before digits that pass the check by chance.

What fails its validation stays as it is. Separators stay in place, and values that differ only in them get the same digits.

The network alternates over two halves that keep their sizes: each round adds to one half, digit by digit or modulo the size of
its range, a keyed hash (SHA-256) of the other half. Every round can be undone, so the whole is a permutation of the format.

Defined cases: null text stays null, empty text empty, both without finds. Repeated rows get the same result. All input columns
are kept; one named like the output gives way to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.llm.common import fresh, replacing

ROUNDS = 8
KINDS = ("email", "ip", "date", "ssn", "phone", "card")
FIRST_DAY = "1900-01-01"
#: Sizes of the halves of days, valid numbers by area, and addresses.
DAYS, AREAS, SERIALS, OCTETS = (270, 271), 898, 99 * 9999, (1 << 16, 1 << 16)
#: The same for days after the twelfth of a month, which mm/dd/yyyy alone can name; and the mean number of them in a month.
LATE_DAYS, LATE_IN_MONTH = (943, 47), 44321 / 2404
RUN = 1001

#: Patterns, the first that matches at a place decides.
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
_DATE = r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?!-?\d)|(?<![\d./])\d{2}([./])\d{2}\1\d{4}(?!\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)"
_PHONE = r"(?<![\d+(])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)"
_RUN = rf"(?<![\p{{L}}\d.])\d(?:[ -]?\d){{12,{RUN - 1}}}(?![\p{{L}}\d])"
_TEN = r"\d{3}(?:-\d{3}-|\.\d{3}\.| \d{3} )\d{4}"
PATTERN = "|".join((_EMAIL, _IP, _DATE, _SSN, _PHONE, _RUN, rf"(?<![\p{{L}}\d.+-]){_TEN}(?![\p{{L}}\d]|[.-]\d)"))
#: Cards in their usual groups, and all that is no card.
_SHAPED = r"^(\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{3}-\d\d-\d{4}|\d{4}-\d\d-\d\d|" + _TEN + ")$"


def _hash(key: str, tweak: Column, step: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, step.cast("string"), other.cast("string")), 256)


def _rounds(start: Column, left, right) -> Column:
    """Alternating rounds over struct(l, r); `left(l, r, i)` gives the new l, `right` the new r."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, i: F.when(
        i % 2 == 1, F.struct(left(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))).otherwise(
        F.struct(s["l"].alias("l"), right(s["r"], s["l"], i).alias("r"))))


def permuted_text(value: Column, key: str, kind: str) -> Column:
    """Letters A-Z, a-z and digits permuted within their kinds, other characters in place."""
    def moved(half: Column, other: Column, step: Column) -> Column:
        mask = _hash(key, F.concat_ws("|", F.lit(kind), F.length(half).cast("string")), step, other)

        def shift(c: Column, at: Column) -> Column:
            by = F.conv(F.substring(mask, (at % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)

            def within(first: int, size: int) -> Column:
                return F.chr((code - first + by) % size + first)
            return (F.when(c.rlike("^[0-9]$"), within(48, 10)).when(c.rlike("^[a-z]$"), within(97, 26))
                    .when(c.rlike("^[A-Z]$"), within(65, 26)).otherwise(c))
        return F.array_join(F.transform(F.split(half, ""), shift), "")

    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, F.length(value)).alias("r"))
    done = _rounds(start, moved, moved)
    return F.concat(done["l"], done["r"])


def permuted_number(value: Column, key: str, kind: str, left: int, right: int) -> Column:
    """A permutation of 0 .. left * right - 1."""
    def moved(size: int):
        return lambda half, other, step: F.pmod(
            half + F.conv(F.substring(_hash(key, F.lit(kind), step, other), 1, 15), 16, 10).cast("bigint"), F.lit(size))
    value = value.cast("bigint")
    done = _rounds(F.struct(F.floor(value / right).cast("bigint").alias("l"), F.pmod(value, F.lit(right)).cast("bigint").alias("r")), moved(left), moved(right))
    return done["l"] * right + done["r"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _refilled(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    done = F.aggregate(F.split(shape, ""), start, lambda s, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(
        F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))))
    return done["out"]


def _check_digit(payload: Column) -> Column:
    """The Luhn digit that completes a number."""
    def worth(c: Column, at: Column) -> Column:
        d = c.cast("int")
        return F.when(at % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    total = F.aggregate(F.transform(F.split(F.reverse(payload), ""), worth), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    return ((10 - total % 10) % 10).cast("string")


def _day(value: Column) -> Column:
    """Days since FIRST_DAY, null if that's no day of the permuted range."""
    iso = F.when(value.rlike(r"^\d{4}-"), value).otherwise(F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)))
    day = F.date_diff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    return F.when((day >= 0) & (day < DAYS[0] * DAYS[1]), day)


def _first(month: Column) -> Column:
    """Days after the twelfth before a month, counted from FIRST_DAY on."""
    return F.date_diff(F.add_months(F.lit(FIRST_DAY).cast("date"), month.cast("int")), F.lit(FIRST_DAY).cast("date")) - 12 * month


def _late(value: Column) -> Column:
    """Place of a day mm/dd/yyyy that is none as dd/mm/yyyy among the days after the twelfth, null if it isn't one."""
    month, day, year = (F.substring(value, a, n).cast("int") for a, n in ((1, 2), (4, 2), (7, 4)))
    there = F.try_to_date(F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 1, 2), F.substring(value, 4, 2)), "yyyy-MM-dd")
    place = (_first((year - 1900) * 12 + month - 1) + day - 13).cast("bigint")
    return F.when(value.contains("/") & there.isNotNull() & (day > 12) & (year >= 1900), F.when(place < LATE_DAYS[0] * LATE_DAYS[1], place))


def _late_day(place: Column) -> Column:
    """The day at a place."""
    near = F.floor(place / LATE_IN_MONTH).cast("bigint")
    month = F.when(_first(near + 1) <= place, near + 1).when(_first(near) <= place, near).otherwise(near - 1)
    return F.date_add(F.add_months(F.lit(FIRST_DAY).cast("date"), month.cast("int")), (place - _first(month) + 12).cast("int"))


def _serial(value: Column) -> Column:
    """Place of a number among the valid ones, null if it isn't valid."""
    area, group, number = (F.substring(value, a, n).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (number > 0)
    return F.when(valid, (area - F.when(area > 666, 2).otherwise(1)) * SERIALS + (group - 1) * 9999 + number - 1)


def kind_of(value: Column) -> Column:
    """The kind of a match, null if it isn't valid."""
    octets = F.forall(F.split(value, r"\."), lambda x: x.cast("int") < 256)
    n = F.length(_digits(value))
    return (F.when(value.contains("@"), "email")
            .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(octets, "ip"))
            .when(value.rlike(r"^(\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4})$"), F.when(_day(value).isNotNull() | _late(value).isNotNull(), "date"))
            .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(_serial(value).isNotNull(), "ssn"))
            .when(value.rlike(r"^[+(]"), F.when((n >= 10) & (n <= 15), "phone"))
            .when(value.rlike(f"^{_TEN}$"), "phone")
            .when((n >= 13) & (n <= 19) & F.call_function("luhn_check", _digits(value)), "card"))


def parts(value: Column) -> Column:
    """A match as an array of (match, kind) that make it up: itself, or values within a run of digits and what lies between."""
    def part(match: Column, kind: Column) -> Column:
        return F.struct(match.alias("match"), kind.cast("string").alias("kind"))

    # groups with the separator behind them
    groups = F.regexp_extract_all(value, F.lit(r"\d+[ -]?"), F.lit(0))

    def joined(start: Column, stop: Column) -> Column:
        return F.array_join(F.slice(groups, start, stop - start + 1), "")

    def ends(i: Column) -> Column:
        """The last group of the longest value from group `i` on, and of the longest in usual groups; 0 for none."""
        last = F.least(i + 18, F.size(groups))
        found = F.filter(F.transform(F.sequence(i, last), lambda j: F.struct(j.alias("to"), F.rtrim(F.regexp_replace(joined(i, j), "-$", "")).alias("text"))),
                         lambda x: F.length(x["text"]).between(9, 37) & kind_of(x["text"]).isNotNull())
        top = lambda xs: F.coalesce(F.array_max(F.transform(xs, lambda x: x["to"])), F.lit(0))
        return F.struct(top(found).alias("any"), top(F.filter(found, lambda x: x["text"].rlike(_SHAPED))).alias("shaped"))

    places = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: ends(i))

    def taken(s: Column, i: Column) -> Column:
        here = F.element_at(s["places"], i)
        cut_short = F.exists(F.slice(s["places"], i + 1, F.greatest(here["any"] - i, F.lit(0))), lambda x: x["shaped"] > 0)
        stop = F.when(here["shaped"] > 0, here["shaped"]).when(~cut_short, here["any"]).otherwise(0)
        text = joined(i, F.greatest(stop, i))
        bare = F.regexp_replace(text, "[ -]$", "")
        more = F.when(stop > 0, F.array(part(bare, kind_of(bare)), part(F.substring(text, F.length(bare) + 1, F.lit(1)), F.lit(None)))).otherwise(
            F.array(part(text, F.lit(None))))
        return F.when(i < s["next"], s).otherwise(F.struct(s["places"].alias("places"), (F.greatest(stop, i) + 1).alias("next"), F.concat(s["out"], more).alias("out")))

    start = F.struct(places.alias("places"), F.lit(1).alias("next"), F.array().cast("array<struct<match: string, kind: string>>").alias("out"))
    inside = F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, taken, lambda s: s["out"])
    whole = kind_of(value)
    return F.when(whole.isNull() & value.rlike(r"^\d[\d -]*$") & value.rlike("[ -]") & (F.length(_digits(value)) >= 13), inside).otherwise(F.array(part(value, whole)))


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """What stands for a valid match."""
    at = F.instr(value, "@")
    email = F.concat(permuted_text(F.substring(value, F.lit(1), at - 1), key, "email"), F.substring(value, at, F.length(value)))

    parts = F.split(value, r"\.")
    address = reduce(lambda total, k: total * 256 + parts[k].cast("bigint"), range(4), F.lit(0).cast("bigint"))
    ip_number = permuted_number(address, key, "ip", *OCTETS)
    ip = F.concat_ws(".", *[F.pmod(F.shiftright(ip_number, 8 * k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)])

    day = F.date_add(F.lit(FIRST_DAY).cast("date"), permuted_number(_day(value), key, "date", *DAYS).cast("int"))
    date = (F.when(value.contains("-"), F.date_format(day, "yyyy-MM-dd")).when(value.contains("."), F.date_format(day, "dd.MM.yyyy"))
            .when(_day(value).isNotNull(), F.date_format(day, "dd/MM/yyyy"))
            .otherwise(F.date_format(_late_day(permuted_number(_late(value), key, "late date", *LATE_DAYS)), "MM/dd/yyyy")))

    serial = permuted_number(_serial(value), key, "ssn", AREAS, SERIALS)
    area = F.floor(serial / SERIALS).cast("bigint") + 1
    rest = F.pmod(serial, F.lit(SERIALS))
    ssn = F.concat_ws("-", F.lpad(F.when(area >= 666, area + 1).otherwise(area).cast("string"), 3, "0"),
                      F.lpad((F.floor(rest / 9999).cast("bigint") + 1).cast("string"), 2, "0"), F.lpad((F.pmod(rest, F.lit(9999)) + 1).cast("string"), 4, "0"))

    country = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])", 0)
    local = F.substring(value, F.length(country) + 1, F.length(value))
    phone = F.concat(country, _refilled(local, permuted_text(_digits(local), key, "phone")))

    digits = _digits(value)
    payload = permuted_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    card = _refilled(value, F.concat(payload, _check_digit(payload)))
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "date", date).when(kind == "ssn", ssn)
            .when(kind == "phone", phone).when(kind == "card", card))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", out: str = "replaced") -> DataFrame:
    """`docs` with pseudonyms in its texts, and `out`: an array of (kind, pseudonym) in order of the text."""
    docs, _ = replacing(docs, [(out, "string")], text_col)
    text, seen = F.col(f"`{text_col}`").cast("string"), fresh([*docs.columns, out], "found")
    matches = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), 0), lambda m: parts(m))
    named = F.transform(F.col(seen), lambda xs: F.transform(xs, lambda f: F.struct(
        f["match"].alias("match"), f["kind"].alias("kind"), pseudonym(f["match"], f["kind"], key).alias("pseudonym"))))
    found = docs.withColumn(seen, F.when(text.rlike(PATTERN), matches))
    # only texts with a match are cut up
    found = found.withColumn(seen, F.when(F.col(seen).isNotNull(), named))
    fills = F.concat(F.transform(seen, lambda xs: F.array_join(F.transform(xs, lambda f: F.coalesce(f["pseudonym"], f["match"])), "")), F.array(F.lit("")))
    woven = F.array_join(F.flatten(F.zip_with(F.split(text, PATTERN, -1), fills, lambda a, b: F.array(a, b))), "")
    valid = F.transform(F.filter(F.flatten(seen), lambda f: f["kind"].isNotNull()), lambda f: F.struct(f["kind"].alias("kind"), f["pseudonym"].alias("pseudonym")))
    return found.withColumns({text_col: F.when(F.col(seen).isNotNull(), woven).otherwise(text),
                              out: F.coalesce(valid, F.array().cast("array<struct<kind: string, pseudonym: string>>"))}).drop(seen)
