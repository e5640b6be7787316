"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

One pattern finds candidates in a text. Each is validated (Luhn, mod 97, octets, real dates, number ranges) and becomes an
array of small numbers, each with the count of values it may take. A keyed Feistel network permutes the array: the
numbers of one half are shifted, modulo their counts, by keyed SHA-256 digests of the other half, in turn; each number of a
half has bits of its own. Marks and lengths
stay, check digits are computed anew and ranges kept, so a pseudonym is valid in its format, equal values stay equal across documents,
and who has the key can undo it. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import set_aside

#: Patterns of candidates, in the order in which they are tried at a place. Dates of these years only.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![A-Za-z0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![A-Za-z0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}(?<first>[-/.])[0-9]{2}\k<first>[0-9]{2}|[0-9]{2}(?<last>[-/.])[0-9]{2}\k<last>[0-9]{4})(?![A-Za-z0-9]|[./-][0-9])",
}
FIRST_YEAR, LAST_YEAR = 1904, 2099
#: Country calling codes of one digit and of two; all others have three.
CALLING_CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: How many area, group and serial numbers of a social security number are valid (666 isn't, nor is any part of zeros).
SSN_COUNTS, SSN_GAP = (898, 99, 9999), 666
ROUNDS = 8
#: Hexadecimal digits of a digest by which one number is shifted, and numbers that a digest has digits for.
DRAWN, SERVED = 12, 5


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permuted(values: Column, counts: Column, tweak: Column, undo: bool = False) -> Column:
    """An array of numbers, each from 0 to its count - 1, permuted by a Feistel network keyed by `tweak`."""
    half = F.floor(F.size(values) / 2)
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(held: Column, i: Column) -> Column:
        moves = lambda p: (p < half) == (i % 2 == 0)
        other = F.array_join(F.transform(F.filter(held, lambda _, p: ~moves(p)), lambda x: x.cast("string")), ",")
        first = F.when(i % 2 == 0, F.lit(0)).otherwise(half).cast("int")
        many = F.greatest(F.when(i % 2 == 0, half).otherwise(F.size(values) - half), F.lit(1))
        blocks = F.sequence(F.lit(0), F.floor((many - 1) / SERVED).cast("int"))

        def shifted(keys: Column) -> Column:
            def one(x: Column, p: Column) -> Column:
                count, nth = F.element_at(counts, p.cast("int") + 1), p.cast("int") - first
                drawn = F.substring(F.element_at(keys, F.floor(nth / SERVED).cast("int") + 1), nth % SERVED * DRAWN + 1, F.lit(DRAWN))
                by = (F.conv(drawn, 16, 10).cast("long") % count).cast("int")
                return F.when(moves(p), F.pmod(x - by if undo else x + by, count)).otherwise(x)

            return F.transform(held, one)

        digest = lambda b: F.sha2(F.concat_ws("|", tweak, i.cast("string"), b.cast("string"), other), 256)
        return _bound(F.transform(blocks, digest), shifted)

    return F.aggregate(rounds, values, step)


def _characters(text: Column, tweak: Column, letters: int, undo: bool) -> Column:
    """Letters and digits permuted in their kinds (the first `letters` of the alphabet), other characters kept."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    kind = lambda c: F.when(c.between(48, 57), 48).when(c.between(65, 64 + letters), 65).when(c.between(97, 96 + letters), 97)
    base = F.transform(codes, lambda c: F.coalesce(kind(c), c))
    counts = F.transform(codes, lambda c: F.when(kind(c).isNull(), 1).when(kind(c) == 48, 10).otherwise(letters))
    moved = permuted(F.zip_with(codes, base, lambda c, b: c - b), counts, tweak, undo)
    return F.array_join(F.zip_with(moved, base, lambda x, b: F.char(x + b)), "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ssn(m: Column, tweak: Column, undo: bool) -> Column:
    """A valid number's place among the valid ones is permuted, part by part, so that all results are valid."""
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    places = F.array(area - 1 - F.when(area > SSN_GAP, 1).otherwise(0), group - 1, serial - 1)

    def shown(x: Column) -> Column:
        place = F.element_at(x, 1) + 1
        parts = (place + F.when(place >= SSN_GAP, 1).otherwise(0), F.element_at(x, 2) + 1, F.element_at(x, 3) + 1)
        return F.concat_ws("-", *(F.lpad(p.cast("string"), n, "0") for p, n in zip(parts, (3, 2, 4), strict=True)))

    return _bound(permuted(places, F.array(*map(F.lit, SSN_COUNTS)), tweak, undo), shown)


def _phone(m: Column, tweak: Column, undo: bool) -> Column:
    """The digits after the country's code are permuted, however they are parted, in the places of the old ones."""
    digits = _digits(m)
    code = F.when(m.startswith("+"), F.coalesce(F.nullif(F.regexp_extract(digits, f"^(?:{CALLING_CODES})", 0), F.lit("")), F.substring(digits, 1, 3))).otherwise(F.lit(""))
    rest = F.substring(digits, F.length(code) + 1, F.length(digits))
    return _bound(F.concat(code, _characters(rest, F.concat_ws("|", tweak, code), 26, undo)), lambda x: _spaced(m, x))


def _luhn(digits: Column) -> Column:
    """The check digit that makes digits plus it valid."""
    values = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: _doubled(c.cast("int"), i % 2 == 0))
    total = F.aggregate(values, F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def _doubled(x: Column, double: Column) -> Column:
    return F.when(double, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of a number whose letters stand for 10 to 35."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    return F.aggregate(codes, F.lit(0).cast("int"), lambda a, c: F.when(c < 65, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97))


def _spaced(like: Column, plain: Column) -> Column:
    """plain's characters in the places of like's letters and digits."""
    chars = F.filter(F.split(like, ""), lambda c: c != "")
    seen = lambda p: F.size(F.filter(F.slice(chars, F.lit(1), (p + 1).cast("int")), lambda c: c.rlike("[A-Za-z0-9]")))
    return F.array_join(F.transform(chars, lambda c, p: F.when(c.rlike("[A-Za-z0-9]"), F.substring(plain, seen(p), F.lit(1))).otherwise(c)), "")


def _date(m: Column, tweak: Column, undo: bool) -> Column:
    """Dates move in their block of 28 years, 10227 = 21 * 487 days each."""
    year_first = m.rlike("^[0-9]{4}")
    mark = F.when(year_first, F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))
    a, b, c = (F.split(m, "[-/.]")[i] for i in range(3))
    iso = F.when(year_first, F.concat_ws("-", a, b, c)).otherwise(F.concat_ws("-", c, b, a))
    other = F.when(~year_first, F.concat_ws("-", c, a, b))  # month first, if day first is no date
    day, swapped = F.try_to_date(iso, "yyyy-MM-dd"), F.try_to_date(other, "yyyy-MM-dd")

    def moved(found: Column) -> Column:
        start = F.make_date(F.year(found) - (F.year(found) - FIRST_YEAR) % 28, F.lit(1), F.lit(1))
        nr = F.datediff(found, start)
        out = permuted(F.array(F.floor(nr / 487).cast("int"), (nr % 487).cast("int")), F.array(F.lit(21), F.lit(487)), F.concat_ws("|", tweak, start.cast("string")), undo)
        return F.date_add(start, (F.element_at(out, 1) * 487 + F.element_at(out, 2)).cast("int"))

    def shown(found: Column, month_first: Column) -> Column:
        y, mo, d = (F.date_format(found, x) for x in ("yyyy", "MM", "dd"))
        return F.when(year_first, F.concat(y, mark, mo, mark, d)).when(month_first, F.concat(mo, mark, d, mark, y)).otherwise(F.concat(d, mark, mo, mark, y))

    found = F.coalesce(day, swapped)
    right = F.year(found).between(FIRST_YEAR, LAST_YEAR)
    return F.when(right, _bound(moved(found), lambda x: shown(x, day.isNull()))).otherwise(m)


def pseudonym(m: Column, key: Column, undo: bool = False) -> Column:
    """What stands for a candidate: itself, if it isn't valid."""
    tweak = lambda kind: F.concat(key, F.lit(f"|{kind}"))
    is_kind = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    digits = _digits(m)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    card = _bound(_characters(body, tweak("card"), 26, undo), lambda x: _spaced(m, F.concat(x, _luhn(x))))
    plain = F.regexp_replace(m, " ", "")
    bank, land = F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 2)
    sealed = lambda x: F.concat(land, F.lpad((98 - _mod97(F.concat(x, land, F.lit("00")))).cast("string"), 2, "0"), x)
    iban = _bound(_characters(bank, tweak("iban"), 26, undo), lambda x: _spaced(m, sealed(x)))
    octets = F.transform(F.split(m, "\\."), lambda x: x.cast("int"))
    ip = F.array_join(F.transform(permuted(octets, F.array(*[F.lit(256)] * 4), tweak("ip"), undo), lambda x: x.cast("string")), ".")
    at = F.instr(m, "@")
    name, host = F.substring(m, F.lit(1), at - 1), F.substring(m, at, F.length(m))
    return (
        F.when(at > 0, F.concat(_characters(name, F.concat_ws("|", tweak("email"), host), 26, undo), host))
        .when(is_kind("secret") & m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), _characters(m, tweak("secret"), 6, undo))
        .when(is_kind("iban") & (_mod97(F.concat(bank, F.substring(plain, 1, 4))) == 1), iban)
        .when(is_kind("date"), _date(m, tweak("date"), undo))
        .when(is_kind("ip") & F.forall(octets, lambda x: x < 256), ip)
        .when(is_kind("ssn") & ~m.rlike("^(?:000|666|9..)|-00-|-0000$"), _ssn(m, tweak("ssn"), undo))
        .when(is_kind("card") & (_luhn(body) == F.substring(digits, -1, 1)), card)
        .when(is_kind("phone") & F.length(digits).between(7, 15), _phone(m, tweak("phone"), undo))
        .otherwise(m)
    )


def pseudonymised(docs: DataFrame, key: str, undo: bool = False, text_col: str = "text", count_col: str = "n_replaced") -> DataFrame:
    """docs with personal data in text replaced by pseudonyms, and how many were.

    All else in a text stays as it is. Null and empty texts stay; candidates that fail validation stay. Equal values
    have equal pseudonyms under one key, phones also where they are written with other marks; undo gives the texts back (a
    card's or account's check digits must be right; a date with the month first whose pseudonym can be read with the day first
    comes back as another). Who has the key can undo it: there is none by default. The key is read by
    a subquery, so that no plan, event log or page of the user interface shows it. Other columns pass through, one named
    like the count as {name}_in; rows that repeat come out alike.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    docs = set_aside(docs, count_col)
    text, every = F.col(text_col), "|".join(f"(?:{p})" for p in PATTERNS.values())
    work, found, secret = "_storyloom_new", "_storyloom_found", "_storyloom_key"
    held = docs.sparkSession.createDataFrame([(key,)], f"{secret} string").scalar()
    # Most texts hold neither a digit nor an @: they are not split.
    some = text.rlike("[0-9@]")
    out = docs.withColumn(found, F.when(some, F.regexp_extract_all(text, F.lit(every), 0))).withColumn(secret, held)
    out = out.withColumn(work, F.when(F.size(found) > 0, F.transform(F.col(found), lambda m: pseudonym(m, F.col(secret), undo))))
    changed = F.size(F.filter(F.zip_with(found, work, lambda a, b: a != b), lambda x: x))
    pieces = F.split(text, every, -1)
    new = F.array_join(F.zip_with(pieces, F.col(work), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    there = F.col(work).isNotNull()
    out = out.withColumn(count_col, F.when(there, changed).otherwise(0).cast("long"))
    return out.withColumn(text_col, F.when(there & (F.col(count_col) > 0), new).otherwise(text)).drop(work, found, secret)

