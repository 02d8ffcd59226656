"""Spelling rules for symbols, calendar days and period labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\r\x0b\x0c\u00a0\u3000"


def trimmed(c: Column) -> Column:
    """The text without white space at its ends; null stays null."""
    return F.btrim(c, F.lit(SPACES))


def symbol_key(c: Column) -> Column:
    """Trimmed, in upper case, with '.' as '-'; blank and null give null."""
    return F.nullif(F.translate(F.upper(trimmed(c)), ".", "-"), F.lit(""))


def calendar_day(c: Column) -> Column:
    """The day that a text states as yyyy-MM-dd, yyyy/MM/dd or yyyyMMdd, with or without a time behind it; null
    where there's none or the day doesn't exist."""
    p = r"^[\s ]*(\d{4})([-/]?)(\d{2})\2(\d{2})(?:[T ]\d{1,2}:\d{2}.*)?[\s ]*$"
    return F.when(c.rlike(p), F.try_to_date(F.regexp_replace(c, p, "$1-$3-$4"), "yyyy-MM-dd"))


def quarter_of(c: Column) -> Column:
    """The quarter (1-4) that a period label names, such as Q2, 2Q, Quarter 2, Q2 2023, 2023-Q2 or Second quarter; else null.

    Labels of years, halves and months give null.
    """
    t = F.lower(trimmed(c))
    year = r"(?:(?:fy)?\s*'?(?:\d{4}|\d{2}))?"
    sep = r"[\s\-_/.,]*"
    patterns = [rf"^{year}{sep}q(?:uarter|tr)?{sep}([1-4])(?:{sep}{year})?$", rf"^{year}{sep}([1-4]){sep}q(?:uarter|tr)?(?:{sep}{year})?$", rf"^{year}{sep}([1-4])(?:st|nd|rd|th){sep}q(?:uarter|tr)?(?:{sep}{year})?$"]
    found = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns])
    word = F.regexp_extract(t, r"^(?:the\s+)?(first|second|third|fourth)[\s\-]+quarter", 1)
    named = F.when(word == "first", 1).when(word == "second", 2).when(word == "third", 3).when(word == "fourth", 4)
    return F.coalesce(found.try_cast("int"), named)
