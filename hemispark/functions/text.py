"""Column helpers for text, with the semantics of Python's string methods where it matters."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, _EDGE, "")


def words(c: Column) -> Column:
    """Words between white space of any kind; never an empty one."""
    return F.filter(F.split(strip(c), r"[\s\p{Z}]+"), lambda w: w != "")


def _fold_pairs() -> tuple[str, str]:
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(base) == 1 and base.isascii() and base.isalpha():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_pairs()


def fold_accents(c: Column) -> Column:
    """Letters without accents, composed or not; stays in generated code."""
    return F.translate(F.regexp_replace(c, r"\p{M}+", ""), FOLD_FROM, FOLD_TO)


def name_key(c: Column) -> Column:
    """Accents, case and outer white space removed."""
    return strip(F.lower(fold_accents(c)))


def extract(c: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match; NULL without a match, '' if the group is empty."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def ratio(a: Column, b: Column) -> Column:
    """Quotient; NULL for a zero or missing denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))
