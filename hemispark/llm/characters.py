"""One consistent form for text that looks the same but differs in its characters.

A transducer is compiled once from a conflict-checked mapping of grapheme clusters. It reads a string from
left to right in one pass, character by character, goes on while a longer cluster (a letter with its marks) is known, and writes the plain form:

* full-width, mathematical and ligature forms become the ordinary letters,
* accents are joined with their letter,
* characters that cannot be seen are removed (joiners stay between emoji),
* every space but the plain one and line breaks becomes the plain space, no-break hyphens the hyphen,
* letters of other scripts that look like Latin ones become Latin, but only in words that otherwise read as Latin:
  a word wholly and openly in another script stays as it is.

Typographic quotes, dashes, currency signs and line breaks are never touched. NULL gives NULL, '' gives ''.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that cannot be seen.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufe0e\ufe0f\ufeff"
# Spaces other than the plain one.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011"
# Letters of other scripts drawn like a Latin letter, and the letter they are read as.
LOOKALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ԁ": "d", "ӏ": "l", "Ӏ": "I", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ա": "w", "Տ": "S", "Օ": "O", "Լ": "L",
    # Latin letters that are not the ordinary ones
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ѡ": "w", "ꞵ": "b",
}
# Read as a Latin letter only inside a word with Latin letters; alone they are openly Greek or Armenian.
LOOSE = {"α": "a", "ε": "e", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "β": "b", "к": "k", "т": "t", "м": "m", "в": "b", "н": "h", "г": "r", "п": "n", "и": "u"}
#: Blocks whose compatibility form is the plain letter, digit or sign: width, letter-like, number and presentation forms.
FORM_BLOCKS = ((0x2100, 0x214F), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFF01, 0xFFEE), (0x1D400, 0x1D7FF))
#: Letter-like signs that are signs of their own.
KEEP_FORMS = "\u2116\u2117\u2120\u2121\u2122\u212e\u213b\u2103\u2109\u2100\u2101\u2105\u2106"


def compile_mapping(pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """A dict of the pairs; two different results for a cluster, or a result that is itself mapped, is a conflict."""
    table: dict[str, str] = {}
    for source, target in pairs:
        if table.setdefault(source, target) != target:
            raise ValueError(f"conflict: {source!r} -> {table[source]!r} and {target!r}")
    for source, target in table.items():
        for cluster in (target, *target):
            if cluster != source and table.get(cluster, cluster) != cluster:
                raise ValueError(f"not a fixed point: {source!r} -> {target!r}")
    return table


def _forms() -> Iterable[tuple[str, str]]:
    for low, high in FORM_BLOCKS:
        for code in range(low, high + 1):
            char = chr(code)
            plain = unicodedata.normalize("NFKC", char)
            if char in KEEP_FORMS or plain == char or not unicodedata.name(char, ""):
                continue
            if plain.isascii() and (low != 0x2100 or len(plain) == 1) or 0xFF01 <= code:
                yield char, "" if plain in INVISIBLE else "".join(LOOKALIKE.get(c, c) for c in plain)


@lru_cache(1)
def _transducer() -> tuple[dict[str, str], dict[tuple[str, str], str], dict[int, str | None]]:
    """Entries (a character and the plain form it begins), steps (a plain form and a mark, and the joined form), and single characters outside words.

    All pairs, of every kind, go through one conflict check. The steps go on from joined forms too, so that a letter takes all
    marks it can be joined with: the longest known cluster wins.
    """
    entries = compile_mapping([*_forms(), *LOOKALIKE.items(), *((c, " ") for c in SPACES), *((c, "-") for c in HYPHENS), *((c, "") for c in INVISIBLE)])
    if entries.keys() & LOOSE.keys():
        raise ValueError(f"conflict: {entries.keys() & LOOSE.keys()}")
    entries |= LOOSE  # these hold inside Latin words only
    marks = [chr(c) for c in range(0x300, 0x370)]
    pairs, frontier = [], {*filter(str.isalpha, map(chr, range(0x41, 0x7B))), *(c for v in entries.values() for c in v if c.isalpha())}
    seen: set[str] = set()
    while frontier:
        seen |= frontier
        joined = [(base + mark, whole) for base in sorted(frontier) for mark in marks if len(whole := unicodedata.normalize("NFC", base + mark)) == 1]
        pairs += joined
        frontier = {whole for _, whole in joined} - seen
    steps = {(k[0], k[1]): v for k, v in compile_mapping(pairs).items()}
    outside = {ord(k): v or None for k, v in entries.items() if k not in LOOKALIKE and k not in LOOSE}
    return entries, steps, outside


_WORD = regex.compile(rf"[\p{{L}}\p{{M}}\p{{Nl}}{INVISIBLE}]+")
_PICTURE = regex.compile(r"\p{Extended_Pictographic}")


def _ranges() -> str:
    codes = sorted({*map(ord, _transducer()[0]), *range(0x300, 0x370)})
    runs: list[list[int]] = []
    for code in codes:
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


@lru_cache(1)
def trigger() -> str:
    """Java pattern of the characters the transducer may change; text without any is in its final form."""
    return f"[{_ranges()}]"


@lru_cache(1)
def _trigger_py() -> re.Pattern:
    return re.compile("[" + regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", _ranges()) + "]")


def _word(word: str) -> str:
    entries, steps, outside = _transducer()
    bare = word if word.isascii() else "".join(c for c in word if c not in INVISIBLE)
    if not bare:
        return ""
    kinds = {"alike" if c in LOOKALIKE or c in LOOSE else "form" if c in entries else "mark" if unicodedata.combining(c) else "latin" if c.isascii() or "LATIN" in unicodedata.name(c, "") else "other" for c in bare}
    if not kinds & {"latin", "form"} and ("other" in kinds or any(c in LOOSE for c in bare)):
        return word  # wholly and openly in another script
    out, at, left = [], "", False
    for c in bare:
        if (joined := steps.get((at, c))) is not None:
            at = joined  # the cluster goes on
            continue
        out.append(at)
        plain = entries.get(c, c)
        left |= "\u0300" <= c <= "\u036f"
        out.append(plain[:-1])
        at = plain[-1:]
    out.append(at)
    return unicodedata.normalize("NFC", "".join(out)) if left else "".join(out)


def normalize_text(text: str | None) -> str | None:
    """The consistent form of one string."""
    if text is None or text.isascii() or not _trigger_py().search(text):
        return text
    outside = _transducer()[2]
    out, at = [], 0
    for m in _WORD.finditer(text):
        gap = text[at : m.start()]
        out.append(gap if gap.isascii() else gap.translate(outside))
        word = m.group()
        if not word.strip(INVISIBLE) and _PICTURE.search(text, max(0, m.start() - 1), m.start()) and word[0] in "\u200d\ufe0e\ufe0f":
            out.append(word)  # joiners between emoji
        else:
            out.append(word if word.isascii() else _word(word))
        at = m.end()
    gap = text[at:]
    out.append(gap if gap.isascii() else gap.translate(outside))
    return "".join(out)


@F.pandas_udf(T.StringType())
def _normalize(values: pd.Series) -> pd.Series:
    return values.map(normalize_text, na_action="ignore")


def normalized(column: Column | str) -> Column:
    """Column in its consistent form."""
    return _normalize(F.col(column) if isinstance(column, str) else column)


def normalize_columns(df: DataFrame, columns: list[str], suffix: str = "_norm") -> DataFrame:
    """Add ``<column><suffix>`` in the consistent form for each of ``columns``; NULL stays NULL, '' stays ''."""
    return df.select("*", *(normalized(df[c]).alias(c + suffix) for c in columns))


def visually_identical(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, field): each value that the transducer changes, once per key, even for redelivered rows.

    Values without any character of the mapping are skipped before they reach Python; such values are in their
    final form. Empty tables give no rows; columns besides ``keys`` and ``columns`` are never read.
    """
    # only values with more bytes than characters can hold any other character
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), df[c].alias("_value")) for c in columns))).alias("_pair"))
    long = long.select(*keys, F.col("_pair.field").alias("field"), F.col("_pair._value").alias("_value")).where((F.octet_length("_value") > F.length("_value")) & F.col("_value").rlike(trigger()))
    return long.where(F.col("_value") != normalized("_value")).select(*keys, "field").distinct()
