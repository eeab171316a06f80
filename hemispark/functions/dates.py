"""Dates printed in many notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemispark.functions.text import fold_accents

#: Beginnings of month names, English and French without accents.
MONTHS = {
    "JAN": 1, "FEB": 2, "FEV": 2, "MAR": 3, "APR": 4, "AVR": 4, "MAY": 5, "MAI": 5, "JUN": 6, "JUIN": 6, "JUL": 7, "JUIL": 7,
    "AUG": 8, "AOU": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12,
}
_NAME = "|".join(sorted(MONTHS, key=len, reverse=True))


def day_month_year(c: Column) -> Column:
    """The date in ``10 FEBRUARY 2015`` anywhere in the text; NULL if there is none or it does not exist."""
    found = F.regexp_extract(c, r"(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})", 0)
    return F.try_to_timestamp(F.regexp_replace(found, r"\s+", " "), F.lit("d MMMM yyyy")).cast("date")


def _made(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def printed_date(c: Column) -> Column:
    """The date of a printed notation; NULL if a part is missing, unreadable or impossible.

    Read are ``2014-07-08`` (year first), ``25.07.2018`` and ``23/05/2018`` (day first), and a day, a month's name in
    English or French (whole or cut) and a year in either order, among weekdays, ordinals, times and odd spaces.
    """
    t = F.regexp_replace(F.upper(fold_accents(c)), r"[\s\p{Z}]+", " ")
    iso = r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)"
    numeric = r"(?<!\d)(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)"
    named = rf"(?<!\d)(\d{{1,2}})(?:ST|ND|RD|TH|ER)? (?:DE |OF )?({_NAME})[A-Z]*\.?,? (\d{{4}})(?!\d)"
    turned = rf"(?<![A-Z])({_NAME})[A-Z]*\.? (\d{{1,2}})(?:ST|ND|RD|TH)?,? (\d{{4}})(?!\d)"
    months = F.create_map(*(x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))))
    part = lambda p, g: F.regexp_extract(t, p, g)
    return (
        F.when(t.rlike(iso), _made(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(t.rlike(numeric), _made(part(numeric, 3), part(numeric, 2), part(numeric, 1)))
        .when(t.rlike(named), _made(part(named, 3), F.try_element_at(months, part(named, 2)), part(named, 1)))
        .when(t.rlike(turned), _made(part(turned, 3), F.try_element_at(months, part(turned, 1)), part(turned, 2)))
    )
