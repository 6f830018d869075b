"""Dates, checksums, hashes and value patterns as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed shapes of dates: pattern, and the order of its groups.
_ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:T[\d:.]+)?$"
_SLASH = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
_US = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
_DOTS = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
_MONTH_FIRST = r"^([A-Za-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})$"
_DAY_FIRST = r"^(\d{1,2})(?:st|nd|rd|th)? ([A-Za-z]{3,9})\.?,? (\d{4})$"
_DAY_DASH = r"^(\d{1,2})-([A-Za-z]{3,9})\.?-(\d{4})$"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: Words that name a month; a fixed list.
MONTH_WORDS = {m.lower()[:k]: i + 1 for i, m in enumerate(MONTHS) for k in (3, len(m))} | {"sept": 9}


def parse_date(value: Column) -> Column:
    """A date in one of the common shapes, else null.

    With slashes or dashes and the year last, the month comes first unless the first number exceeds 12. Dates
    that do not exist are null.
    """
    v = F.regexp_replace(value, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")

    def group(pattern: str, k: int) -> Column:
        return F.regexp_extract(v, pattern, k)

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    def month(name: Column) -> Column:
        return F.try_element_at(F.create_map(*(F.lit(x) for kv in MONTH_WORDS.items() for x in kv)), F.lower(name)).cast("string")

    day_first = F.when(v.rlike(_US), group(_US, 1).cast("int") > 12)
    return (
        F.when(v.rlike(_ISO), made(group(_ISO, 1), group(_ISO, 2), group(_ISO, 3)))
        .when(v.rlike(_SLASH), made(group(_SLASH, 1), group(_SLASH, 2), group(_SLASH, 3)))
        .when(day_first, made(group(_US, 3), group(_US, 2), group(_US, 1)))
        .when(v.rlike(_US), made(group(_US, 3), group(_US, 1), group(_US, 2)))
        .when(v.rlike(_DOTS), made(group(_DOTS, 3), group(_DOTS, 2), group(_DOTS, 1)))
        .when(v.rlike(_MONTH_FIRST), made(group(_MONTH_FIRST, 3), month(group(_MONTH_FIRST, 1)), group(_MONTH_FIRST, 2)))
        .when(v.rlike(_DAY_FIRST), made(group(_DAY_FIRST, 3), month(group(_DAY_FIRST, 2)), group(_DAY_FIRST, 1)))
        .when(v.rlike(_DAY_DASH), made(group(_DAY_DASH, 3), month(group(_DAY_DASH, 2)), group(_DAY_DASH, 1)))
    )


#: Formats in which dates are written out; the ordinal one is made apart.
DATE_FORMATS = [
    "dd/MM/yyyy", "MM/dd/yyyy", "d/M/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd",
    "d MMM yyyy", "dd MMMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "dd-MMM-yyyy",
]


def ordinal(n: Column) -> Column:
    """A number with its English suffix."""
    teen = (n % 100).between(11, 13)
    suffix = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def rendered_date(d: Column, pick: Column) -> Column:
    """A date in one of the long formats, chosen by a whole number."""
    forms = [F.date_format(d, f) for f in DATE_FORMATS] + [F.concat(ordinal(F.dayofmonth(d)), F.lit(" "), F.date_format(d, "MMMM yyyy"))]
    return F.get(F.array(*forms), F.pmod(pick, F.lit(len(forms))).cast("int"))


#: Birth words at the end of a line's text, with filler but no digit or break before the date.
BIRTH_CUE = r"(?iu)(?:^|[^\p{L}\p{N}_])(?:birth|born|dob|d\.o\.b)\.?[^.;|\t\n\p{Nd}]{0,25}$"


def mod97_ok(value: Column) -> Column:
    """Whether an account number of IBAN shape has a valid checksum; null for any other shape."""
    s = F.upper(F.regexp_replace(value, "[ -]", ""))
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    digits = F.array_join(F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string"))), "")
    rest = F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), F.lit(0), lambda a, d: (a * 10 + d.cast("int")) % 97)
    return F.when(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$"), rest == 1)


def hash_digit(key: Column) -> Column:
    """The md5 of a key, as a number, modulo 10: digits of 16 are 6 modulo 10, but for the last."""
    h = F.md5(key.cast("binary"))
    values = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int"))
    return ((F.aggregate(F.slice(values, 1, 31), F.lit(0), lambda a, x: a + x) * 6 + F.get(values, F.lit(31))) % 10).cast("int")


def pvi(p_empty: Column, p_given: Column) -> Column:
    """Bits of information that the input adds about its label; probabilities are floored at 1e-12."""
    return -F.log2(F.greatest(p_empty, F.lit(1e-12))) + F.log2(F.greatest(p_given, F.lit(1e-12)))


def pattern_regex(pattern: str) -> str:
    """An anchored expression for a value pattern: ``#`` a digit, ``A`` a letter, ``X`` either, ``[..]`` a choice."""
    one = {"#": "[0-9]", "A": "[A-Z]", "X": "[A-Z0-9]"}
    out = [m.group() if m.group()[0] == "[" else one.get(m.group(), re.escape(m.group())) for m in re.finditer(r"\[[^\]]*\]|.", pattern)]
    return "^" + "".join(out) + "$"


def rendered_pattern(pattern: str, seed: Column) -> Column:
    """A value of a pattern, its characters drawn from the md5 of ``seed`` and their place."""
    sets = {"#": "0123456789", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "X": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}
    out = []
    for k, m in enumerate(re.finditer(r"\[[^\]]*\]|.", pattern)):
        token = m.group()
        pool = token[1:-1] if token[0] == "[" else sets.get(token)
        if pool is None:
            out.append(F.lit(token))
            continue
        n = F.conv(F.substring(F.md5(F.concat(seed, F.lit(f"|{k}")).cast("binary")), 1, 6), 16, 10).cast("int")
        out.append(F.substring(F.lit(pool), n % len(pool) + 1, F.lit(1)))
    return F.concat(*out)


def weighted_choice(names: list[str], weights: list[float], uniform: Column) -> Column:
    """One of ``names`` by cumulative weight, from a uniform number in [0, 1)."""
    total, upto, out = sum(weights), 0.0, None
    for name, weight in zip(names, weights):
        upto += weight
        out = F.when(uniform < upto / total, name) if out is None else out.when(uniform < upto / total, name)
    return out.otherwise(names[-1])


#: Shapes that values of a label must have (fixed rules).
SHAPES = {
    "PHONE": r"^[+(]?[0-9][0-9 ()./-]{5,18}$",
    "ACCOUNT": r"^[A-Z0-9][A-Z0-9 -]{5,33}$",
    "EMAIL": r"^[^ @]+@[^ @]+\.[A-Za-z]{2,}$",
    "DOB": r"[0-9]",
    "PERSON": r"^[^0-9@]{2,60}$",
}


def clean_value(value: Column, label: Column) -> Column:
    """A value without outer blanks if it has its label's shape, else null; labels without a rule only need text."""
    v = F.trim(F.regexp_replace(value, r"\s+", " "))
    fits = v != ""
    for name, shape in SHAPES.items():
        fits = F.when(label == name, v.rlike(shape)).otherwise(fits)
    return F.when(fits, v)


def name_for(names: Column, nonlatin: Column) -> Column:
    """The first name in the wanted kind of script, or else the first."""
    want = F.filter(names, lambda n: n.rlike(r"[\p{L}&&[^\p{IsLatin}]]") == nonlatin)
    return F.coalesce(F.get(want, F.lit(0)), F.get(names, F.lit(0)))
