"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by pattern and validated (Luhn for card numbers, mod 97 for IBANs, octets of
addresses, calendar dates, area rules of social security numbers); numbers that fail are left
alone.  A valid value is replaced by a keyed permutation of itself within its own format: a
Feistel network whose round function is a keyed SHA-256.  A permutation never maps two values to
one, and equal values get equal pseudonyms in every document, so they stay linked.

| kind  | domain of the permutation                                              |
|-------|------------------------------------------------------------------------|
| card  | all digits but the last, which is the new Luhn digit; separators stay  |
| phone | all digits after the country code; punctuation stays                   |
| ip    | the four octets as one 32-bit number                                   |
| date  | the days of the 400-year cycle of the date (ISO or dd/mm/yyyy)         |
| ssn   | the serial digits after the validated area                             |
| iban  | the digits of the account, under new check digits; letters stay        |
| email | the letters and digits of the local part, each within its own class    |

Defined results: a null text stays null and has no values; texts without values are returned
unchanged; extra columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: What may be personal data; the first alternative that matches at a place decides its kind.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])",
    "date": r"(?<![\p{L}\p{N}/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\p{L}\p{N}/-])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![\p{L}\p{N}])"
             r"|(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\p{L}\p{N}])"
             r"|(?<![\p{L}\p{N}.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])",
}
ANY = "|".join(PATTERNS.values())
#: A text without these holds nothing that the patterns could match: only e-mail addresses do without a digit.
HINT = r"[0-9]|@"
CYCLE_START = "1600-01-01"
CYCLE_DAYS, CYCLE_FACTORS = 146_097, (189, 773)


def _bind(value: Column, function: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once, however often ``function`` uses it."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _fold(steps: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(steps, start, step)


def _noise(key: str, kind: str, step: Column, value: Column) -> Column:
    """Keyed round function: a number below 2^60."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str) -> Column:
    """struct(l, r): the permuted pair; l stays below left_size and r below right_size (an even number of rounds)."""
    start = F.struct(left.alias("l"), right.alias("r"), left_size.alias("m"), right_size.alias("n"))

    def turn(s: Column, step: Column) -> Column:
        mixed = F.pmod(s["l"] + _noise(key, kind, step, s["r"]), s["m"])
        return F.struct(s["r"].alias("l"), mixed.alias("r"), s["n"].alias("m"), s["m"].alias("n"))

    return _fold(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _long(x: int | Column) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")


def permuted_number(value: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    low = sizes[1]
    pair = feistel(F.floor(value / low).cast("long"), F.pmod(value, _long(low)), _long(sizes[0]), _long(low), key, kind)
    return _bind(pair, lambda p: p["l"] * low + p["r"])


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Digits to digits of the same count (2 to 34); leading zeros count."""

    def permute(d: Column) -> Column:
        half = F.floor(F.length(d) / 2).cast("int")
        power = lambda n: F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")
        pair = feistel(F.substr(d, F.lit(1), half).cast("long"), F.substr(d, half + 1).cast("long"), power(half), power(F.length(d) - half),
                       key, f"{kind}")
        return _bind(pair, lambda p: F.concat(
            F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), F.length(d) - half, "0")))

    return _bind(digits, permute)


def _refill(shape: Column, digits: Column) -> Column:
    """Put ``digits`` one by one in place of the digits of ``shape``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def place(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(
            F.concat(s["out"], F.when(digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + digit.cast("int")).alias("at"))

    return _fold(F.split(shape, ""), start, place)["out"]


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits; a valid number's is a multiple of ten."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return _fold(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of a string of digits and capitals (A = 10 ... Z = 35)."""

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return _fold(F.split(text, ""), F.lit(0), step)


def _card(v: Column, key: str) -> Column:
    def new(digits: Column) -> Column:
        payload = permuted_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
        check = _bind(payload, lambda p: F.concat(p, F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(luhn_sum(digits) % 10 == 0, _refill(v, check))

    return _bind(_only_digits(v), new)


def _phone(v: Column, key: str) -> Column:
    prefix = F.regexp_extract(v, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substr(v, F.length(prefix) + 1)
    return _bind(F.struct(prefix.alias("p"), rest.alias("r")), lambda s: F.when(
        F.length(_only_digits(s["r"])).between(7, 15),
        F.concat(s["p"], _refill(s["r"], permuted_digits(_only_digits(s["r"]), key, "phone")))))


def _ip(v: Column, key: str) -> Column:
    octets = F.transform(F.split(v, "\\."), lambda o: o.cast("long"))
    valid = lambda o: F.forall(o, lambda x: x <= 255)
    number = lambda o: _fold(o, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    back = lambda n: F.concat_ws(".", *[F.pmod(F.shiftright(n, s), _long(256)).cast("string") for s in (24, 16, 8, 0)])
    return _bind(octets, lambda o: F.when(valid(o), _bind(permuted_number(number(o), (1 << 16, 1 << 16), key, "ip"), back)))


def _date(v: Column, key: str) -> Column:
    iso = v.contains("-")
    form = lambda f: F.try_to_date(v, f)
    day = F.when(iso, form("yyyy-MM-dd")).otherwise(form("dd/MM/yyyy"))

    def new(d: Column) -> Column:
        offset = F.datediff(d, F.lit(CYCLE_START).cast("date")).cast("long")
        cycle = F.floor(offset / CYCLE_DAYS).cast("long")
        moved = F.date_add(
            F.lit(CYCLE_START).cast("date"), (cycle * CYCLE_DAYS + permuted_number(F.pmod(offset, _long(CYCLE_DAYS)), CYCLE_FACTORS, key, "date")).cast("int"))
        text = _bind(moved, lambda m: F.when(iso, F.date_format(m, "yyyy-MM-dd")).otherwise(F.date_format(m, "dd/MM/yyyy")))
        return F.when(d.isNotNull() & F.year(d).between(1200, 9599), text)

    return _bind(day, new)


def _ssn(v: Column, key: str) -> Column:
    area, group, serial = F.substring(v, 1, 3), F.substring(v, 5, 2), F.substring(v, 8, 4)
    valid = ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    # group 01 to 99 and serial 0001 to 9999, the area's own permutation
    pair = feistel(group.cast("long") - 1, serial.cast("long") - 1, _long(99), _long(9999), key, "ssn")
    return F.when(valid, _bind(pair, lambda p: F.concat(
        area, F.lit("-"), F.lpad((p["l"] + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((p["r"] + 1).cast("string"), 4, "0"))))


def _iban(v: Column, key: str) -> Column:
    def new(s: Column) -> Column:
        bban = F.substr(s, F.lit(5))
        country = F.substring(s, 1, 2)
        moved = _refill(bban, permuted_digits(_only_digits(bban), key, "iban"))
        check = lambda b: F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        whole = _bind(moved, lambda b: F.concat(country, check(b), b))
        spaced = _bind(whole, lambda w: _fold(
            F.split(v, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda a, c: F.struct(
                F.concat(a["out"], F.when(c == " ", c).otherwise(F.substr(w, a["at"], F.lit(1)))).alias("out"),
                (a["at"] + (c != " ").cast("int")).alias("at")))["out"])
        valid = F.length(s).between(15, 34) & (F.length(_only_digits(bban)) >= 6) & (_mod97(F.concat(bban, F.substring(s, 1, 4))) == 1)
        return F.when(valid, spaced)

    return _bind(F.regexp_replace(v, " ", ""), new)


#: Classes of characters that are turned within themselves: first code point and size.
CLASSES = ((97, 26), (65, 26), (48, 10), (0xE0, 23), (0xC0, 23))


def _email(v: Column, key: str) -> Column:
    """Feistel over the halves of the local part; a round turns each character within its class."""
    local = F.substring_index(v, "@", 1)
    domain = F.concat(F.lit("@"), F.substring_index(v, "@", -1))

    def turned(text: Column, other: Column, step: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), step.cast("string"), other), 256)

        def one(c: Column, i: Column, noise: Column) -> Column:
            code = F.ascii(c)
            shift = F.conv(F.substr(noise, F.pmod(4 * i, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int")
            out = c
            for low, size in CLASSES:
                out = F.when(code.between(low, low + size - 1), F.chr(F.lit(low) + F.pmod(code - low + shift, F.lit(size)))).otherwise(out)
            return out

        return _bind(stream, lambda s: F.array_join(F.transform(F.split(text, ""), lambda c, i: one(c, i, s)), ""))

    def permute(t: Column) -> Column:
        half = F.floor((F.length(t) + 1) / 2).cast("int")
        start = F.struct(F.substr(t, F.lit(1), half).alias("l"), F.substr(t, half + 1).alias("r"))
        pair = _fold(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, i: F.struct(s["r"].alias("l"), turned(s["l"], s["r"], i).alias("r")))
        return _bind(pair, lambda p: F.concat(p["l"], p["r"]))

    return F.concat(_bind(local, permute), domain)


MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: str) -> Column:
    """struct(kind, new): what a matched value is and what replaces it; null where it is not valid."""
    # a value that fails as one kind may be valid as the next whose whole pattern it fits
    tries = [
        F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), maker(value, key)) for kind, maker in MAKERS.items()]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("new")) for k, t in zip(MAKERS, tries, strict=True)])
    return F.get(F.filter(kinds, lambda s: s["new"].isNotNull()), F.lit(0))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` as (row, text, found): found is array<struct<kind, value, new>> in text order."""
    base = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("body"))
    hinted = F.col("body").rlike(HINT)
    matches = F.when(hinted, F.regexp_extract_all("body", F.lit(ANY), F.lit(0)))
    base = base.select("row", "body", F.coalesce(matches, F.array().cast("array<string>")).alias("values"))
    named = F.transform("values", lambda v: _bind(pseudonym(v, key), lambda p: F.struct(
        p["kind"].alias("kind"), v.alias("value"), p["new"].alias("new"))))
    base = base.select("row", "body", named.alias("all"))
    gaps = F.split("body", ANY, -1)
    woven = F.concat(
        F.array_join(F.zip_with(F.slice(gaps, 1, F.size("all")), "all", lambda g, m: F.concat(g, F.coalesce(m["new"], m["value"]))), ""),
        F.element_at(gaps, -1))
    return base.select(
        "row", F.when(F.size("all") > 0, woven).otherwise(F.col("body")).alias("text"),
        F.filter("all", lambda m: m["new"].isNotNull()).alias("found"))
