"""Dates, sessions and terms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = 8000
#: Day, month and year with ever more spaces between digits.
_PATTERNS = (
    (r"\b(\d{1,2})\s*\.\s*(\d{1,2})\s*\.\s*(\d{4})\b", ((1,), (2,), (3,))),
    (r"\b(\d)\s+(\d)\s*\.\s*(\d)\s+(\d)\s*\.\s*(\d{4})\b", ((1, 2), (3, 4), (5,))),
    (r"\b(\d)\s*(\d)?\s*\.\s*(\d)\s*(\d)?\s*\.\s*(\d)\s+(\d)\s+(\d)\s+(\d)\b", ((1, 2), (3, 4), (5, 6, 7, 8))),
)


def parsed(text: Column) -> Column:
    """A `dd.MM.yyyy` date; null if it isn't one."""
    return F.try_to_date(text, "dd.MM.yyyy")


def header_date(content: Column) -> Column:
    """The first date in a transcript's header as dd.MM.yyyy, or null."""
    head = F.left(content, F.lit(HEADER))
    found = []
    for pattern, (day, month, year) in _PATTERNS:
        part = lambda groups, p=pattern: F.concat(*[F.regexp_extract(head, p, g) for g in groups])
        pad = lambda groups: F.lpad(part(groups), 2, "0")  # noqa: B023, E731
        found.append(F.when(part(year) != "", F.concat_ws(".", pad(day), pad(month), part(year))))
    return F.coalesce(*found)


def session_id(name: Column, term: Column, year: Column) -> Column:
    """From a file or folder name with a three-digit session at its end; up to term 22 the zeros stay."""
    digits = F.regexp_extract(name, r"(\d{3})(?:\.txt)?$", 1)
    number = F.when(term <= 22, digits).otherwise(digits.try_cast("int").cast("string"))
    return F.when(digits != "", F.concat(F.lit("term"), term, F.lit("-year"), year, F.lit("-session"), number))


def term_of(id_: Column) -> Column:
    return F.regexp_extract(id_, r"term(\d+)", 1).try_cast("int")


def calendar_year(text: Column) -> Column:
    """The year of dd.mm.yyyy text, or null."""
    return F.get(F.split(text, r"\."), F.lit(2)).try_cast("int")


def sort_key(term: Column, year: Column) -> Column:
    return term * 100 + year


def term_year_label(term: Column, year: Column, year_from: Column, year_to: Column) -> Column:
    """`d17y1 (1983-1984)`, or without years where they are unknown."""
    short = F.concat(F.lit("d"), term, F.lit("y"), year)
    return F.when(year_from.isNull(), short).otherwise(F.concat(short, F.lit(" ("), year_from, F.lit("-"), year_to, F.lit(")")))


def year_label(calendar: Column, term: Column, year: Column) -> Column:
    """`2018 (d26y3)`."""
    return F.concat(calendar, F.lit(" (d"), term, F.lit("y"), year, F.lit(")"))
