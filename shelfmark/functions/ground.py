"""Whether an extracted value occurs in a text: as words, as a number, or as a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of numbers and dates.
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
VALUE = r"^\p{Sc}?[\t\n\f\r ]*-?[\t\n\f\r ]*[0-9][0-9, ]*(?:\.[0-9]+)?$"
NUMERIC = r"([0-9]{1,4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,4})"
DAY_MONTH = r"(?i)([0-9]{1,2})(?:st|nd|rd|th)?[\t\n\f\r ,.]+([a-z]{3,9})\.?[\t\n\f\r ,]+([0-9]{4})"
MONTH_DAY = r"(?i)([a-z]{3,9})\.?[\t\n\f\r ,]+([0-9]{1,2})(?:st|nd|rd|th)?[\t\n\f\r ,]+([0-9]{4})"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


def words(s: Column) -> Column:
    """Lower-case words joined and framed by spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{Nd}]+", " ")), F.lit(" "))


def canonical(s: Column) -> Column:
    """A number without currency, separators and closing zeros after a point; null if the value is no number."""
    s = F.trim(s)
    digits = F.regexp_replace(s, "[^0-9.]", "")
    short = F.when(F.contains(digits, F.lit(".")), F.regexp_replace(digits, r"\.?0*$", "")).otherwise(digits)
    return F.when(s.rlike(VALUE) & (short != ""), F.concat(F.when(F.contains(s, F.lit("-")), "-").otherwise(""), short))


def numbers(s: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(f"({NUMBER})"), F.lit(1)), canonical))


def month(name: Column) -> Column:
    at = F.array_position(F.split(F.lit(MONTHS), " "), F.lower(F.substring(name, 1, 3)))
    return at.cast("int")


def dates(s: Column) -> Column:
    """Days as numbers yyyymmdd. Numeric dates that do not begin with the year count both ways round; any month has up to 31 days."""

    def triples(pattern: str) -> Column:
        found = [F.regexp_extract_all(s, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
        return F.arrays_zip(*[f.alias(n) for f, n in zip(found, "abc")])

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.when(y.between(1000, 9999) & m.between(1, 12) & d.between(1, 31), y * 10000 + m * 100 + d)

    def numeric(x: Column) -> Column:
        a, b, c = (x[k].try_cast("int") for k in "abc")
        year = F.when(c < 100, c + 2000).otherwise(c)
        return F.when(F.length(x["a"]) == 4, F.array(day(a, b, c))).otherwise(F.array(day(year, b, a), day(year, a, b)))

    named = [
        F.flatten(F.transform(triples(NUMERIC), numeric)),
        F.transform(triples(DAY_MONTH), lambda x: day(x["c"].try_cast("int"), month(x["b"]), x["a"].try_cast("int"))),
        F.transform(triples(MONTH_DAY), lambda x: day(x["c"].try_cast("int"), month(x["a"]), x["b"].try_cast("int"))),
    ]
    return F.array_distinct(F.filter(F.flatten(F.array(*named)), lambda x: x.isNotNull()))


def grounded(text: Column, value: Column) -> Column:
    value = F.trim(value)
    own = words(value)
    as_words = (F.length(own) > 2) & F.contains(words(text), own)
    as_number = F.coalesce(F.array_contains(numbers(text), F.coalesce(canonical(value), F.lit("?"))), F.lit(False))
    as_date = F.arrays_overlap(dates(text), dates(value))
    return F.coalesce((value != "") & (as_words | as_number | as_date), F.lit(False))
