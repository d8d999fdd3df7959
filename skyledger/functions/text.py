"""Text cleaning, number and date parsing, and route keys as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number words that are understood.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5,
    "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "hundred": 100, "thousand": 1000,
}

# Texts that stand for a missing value in a CSV file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

COMPAT_NUMBER = r"^(?:[0-9]+|-?[0-9]+\.[0-9]+)$"
SIGNED_NUMBER = r"^-?[0-9]+(?:\.[0-9]+)?$"
NUMBER = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
SHORT_US_DATE = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})$"

# Two-digit years from here on belong to the 1900s.
CENTURY_PIVOT = 69

ISO_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_number(word: Column) -> Column:
    """Value of one number word, any letter case; null for an unknown word."""
    entries = [F.lit(v) for w, n in NUMBER_WORDS.items() for v in (w, float(n))]
    return F.try_element_at(F.create_map(*entries), F.lower(word))


def clean_numeric(text: Column, mode: str = "compat") -> Column:
    """Number held in a text: digits, a decimal, or the sum of its number words.

    ``compat`` reads ``-5`` as missing (only a decimal may carry a sign);
    ``signed`` accepts it. Words are added up, so ``Two Hundred`` is 102.
    """
    if mode not in ("compat", "signed"):
        raise ValueError(f"mode must be 'compat' or 'signed', got {mode!r}")
    number = COMPAT_NUMBER if mode == "compat" else SIGNED_NUMBER
    word_sum = F.aggregate(
        F.transform(F.split(_strip(text), r"\s+"), word_number),
        F.lit(None).cast("double"),
        lambda total, n: F.when(n.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + n),
    )
    # Only texts with a letter can hold a word; the rest never reach the split.
    return F.when(text.rlike(number), text.try_cast("double")).when(
        text.rlike("[A-Za-z]"), word_sum
    )


def parse_number(text: Column) -> Column:
    """Plain numeric parse: sign, decimal point and exponent allowed, anything else null."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


# One piece of a date format: quoted text, a run of one letter, or any other character.
_FORMAT_PIECE = re.compile(r"'(?P<quoted>[^']*)'|(?P<run>(?P<letter>[A-Za-z])(?P=letter)*)|(?P<other>.)")


def _shape(date_format: str) -> str:
    """Regular expression for the texts a date format can possibly fit."""
    shape = []
    for piece in _FORMAT_PIECE.finditer(date_format):
        run = piece["run"]
        if run is None:
            shape.append(re.escape(piece["quoted"] or piece["other"] or ""))
        elif run[0] not in "yMdHhmsS" or (run[0] == "M" and len(run) > 2):
            shape.append(".+")
        else:
            shape.append("[0-9]{1,2}" if len(run) == 1 else f"[0-9]{{{len(run)}}}")
    return f"^{''.join(shape)}$"


def parse_timestamp(text: Column, formats: Sequence[str] = ISO_FORMATS) -> Column:
    """First format that fits wins; null when none does.

    A text is parsed only if it has the shape of the format: failing to parse is dear.
    """
    return F.coalesce(
        *[F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats]
    )


def standardize_date(text: Column) -> Column:
    """``m/d/yy`` to ISO text, null when a text with a slash is no such date; the rest is kept."""
    part = lambda i: F.regexp_extract(text, SHORT_US_DATE, i)
    year = part(3).try_cast("int")
    century = F.when(year >= CENTURY_PIVOT, 1900).otherwise(2000)
    iso = F.concat_ws("-", (year + century).cast("string"), part(1), part(2))
    parsed = F.when(text.rlike(SHORT_US_DATE), F.try_to_timestamp(iso, F.lit("yyyy-M-d")))
    return F.when(text.contains("/"), F.date_format(parsed, "yyyy-MM-dd")).otherwise(text)


def conversion_error(raw: Column, converted: Column, raw_is_text: bool = True) -> Column:
    """Why ``raw`` did not convert, as ``struct(error_type, detail)``."""

    def verdict(kind: str, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("error_type"), detail.alias("detail"))

    shown = raw.cast("string")
    leftover = _strip(F.regexp_replace(shown, r"[0-9.\-]", ""))
    result = F.when(converted.isNotNull(), verdict("No error", F.lit("")))
    result = result.when(raw.isNull(), verdict("Original value was NaN", F.lit("")))
    if not raw_is_text:
        return result.otherwise(verdict("Other conversion error", shown))
    return result.when(
        leftover != "", verdict("Invalid characters", F.concat(F.lit("Invalid: "), leftover))
    ).otherwise(verdict("Format error", F.concat(F.lit("Invalid: "), shown)))


def shorten(text: Column, limit: int = 80) -> Column:
    """Texts over ``limit`` characters end in ``...`` and fill exactly ``limit``."""
    cut = F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def symmetric_key(a: Column, b: Column, sep: str = "-") -> Column:
    """The same key for both directions; null when either end is missing."""
    return F.when(
        a.isNotNull() & b.isNotNull(), F.concat(F.least(a, b), F.lit(sep), F.greatest(a, b))
    )


def route_end(route: Column, side: str, strict: bool = False) -> Column:
    """Airport code on side ``A`` or ``B`` of ``A-B``; ``strict`` wants three capital letters."""
    if side not in ("A", "B"):
        raise ValueError(f"side must be 'A' or 'B', got {side!r}")
    if strict:
        pattern = "^([A-Z]{3})" if side == "A" else "-([A-Z]{3})$"
        found = F.regexp_extract(route, pattern, 1)
    else:
        found = F.split_part(route, F.lit("-"), F.lit(1 if side == "A" else 2))
    return F.nullif(found, F.lit(""))


def longitude(coordinates: Column) -> Column:
    """First number of a packed ``"lon, lat"`` text."""
    return F.trim(F.split_part(coordinates, F.lit(","), F.lit(1))).try_cast("double")


def latitude(coordinates: Column) -> Column:
    """Second number of a packed ``"lon, lat"`` text."""
    return F.trim(F.split_part(coordinates, F.lit(","), F.lit(2))).try_cast("double")
