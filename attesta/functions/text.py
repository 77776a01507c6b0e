"""Text normalisation as Column builders (FN1-FN9). Classes are spelt out: Java's \\s and \\D are ASCII only."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digits, letter variants and marks of the Persian and Arabic scripts.
PERSIAN_DIGITS, ARABIC_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩"
LETTERS_FROM, LETTERS_TO = "يىےكڪةۀأإٱھؤ", "یییککههاااهو"
MARKS = r"[ً-ٰٟـۖ-ۭ]"
INVISIBLES = r"[​‍‎‏‪-‮⁦-⁩﻿]"
NAME_DROPPED = r"[^ء-غف-يٮ-ۓە‌ ]"
NO_LETTER = r"[^ء-غف-يٮٯٱ-ۓە]+"  # U+0670 lies among the letters and is a mark
ZWNJ = "‌"
FOLD_FROM, FOLD_TO = "ژگپچ", "زکبج"
# What may change by composition: above the Latin letters all but ranges of
# characters that are composed, don't combine and are never the second part of another one.
SETTLED = ((0x400, 0x482), (0x61B, 0x64A), (0x660, 0x66F), (0x671, 0x6D3), (0x6D5, 0x6D5), (0x6F0, 0x6FF), (0x200B, 0x2027), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
UNSETTLED = r"[\x{300}-\x{10FFFF}&&[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SETTLED) + "]]"
BASE_FROM, BASE_TO = "گژپچەڕێۆڵڤ", "کزبجهریولف"


def fold_digits(c: Column) -> Column:
    return F.translate(c, PERSIAN_DIGITS + ARABIC_DIGITS, "0123456789" * 2)


def fold_letters(c: Column) -> Column:
    return F.translate(c, LETTERS_FROM, LETTERS_TO)


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(c, MARKS, "")


def strip_invisibles(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLES, "")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Canonical composition; the JVM has no function for it, so only text that may change by it goes to Python.

    A Python function sees every row whatever ``when`` says, so it is the text that is taken away from the others.
    """
    return F.coalesce(_nfc(F.when(c.rlike(UNSETTLED), c)), c)


def _spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column, compose: bool = True) -> Column:
    """Compose, strip, fold, digits, spaces around the joiner, spaces; null gives ''."""
    out = F.coalesce(c, F.lit(""))
    out = fold_digits(strip_marks(fold_letters(strip_invisibles(nfc(out) if compose else out))))
    return _spaces(F.regexp_replace(out, r"(?U)\s*‌\s*", ZWNJ))


def keep_digits(c: Column) -> Column:
    return F.regexp_replace(fold_digits(F.coalesce(c, F.lit(""))), "[^0-9]", "")


def normalize_name(c: Column, compose: bool = True) -> Column:
    return _spaces(F.regexp_replace(normalize_text(c, compose), f"{NAME_DROPPED}+", " "))


def normalize_date(c: Column) -> Column:
    """YYYY/MM/DD of three parts or eight digits; two-digit years and all else give null."""
    digits = fold_digits(strip_invisibles(F.coalesce(c, F.lit(""))))
    parts = F.filter(F.split(digits, "[^0-9]+"), lambda x: x != "")
    one = F.get(parts, F.lit(0))
    whole = F.array(F.substring(one, 1, 4), F.substring(one, 5, 2), F.substring(one, 7, 2))
    parts = F.when(F.size(parts) == 3, parts).when((F.size(parts) == 1) & (F.length(one) == 8), whole)
    y, m, d = (F.get(parts, F.lit(k)) for k in range(3))
    ok = (F.length(y) == 4) & F.length(m).between(1, 2) & F.length(d).between(1, 2)
    return F.when(ok, F.concat_ws("/", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def match_key(c: Column) -> Column:
    """Letters only: those of ``normalize_name``, without what it does to the spaces between them."""
    return F.regexp_replace(fold_letters(nfc(F.coalesce(c, F.lit("")))), NO_LETTER, "")


def fold_key(c: Column) -> Column:
    return F.translate(match_key(c), FOLD_FROM, FOLD_TO)


def base_key(c: Column) -> Column:
    """Letters only, and Kurdish and Persian ones as the Arabic letters they come from."""
    return F.translate(match_key(c), BASE_FROM, BASE_TO)


def label_of(c: Column) -> Column:
    """A training label: without joiners, which aren't drawn, and with single spaces; null gives ''."""
    return _spaces(F.translate(F.coalesce(c, F.lit("")), ZWNJ, ""))


def reading_order(c: Column) -> Column:
    """Right-to-left text for display: runs in reverse order, and letters reversed in all but runs of digits and Latin letters."""
    runs = F.regexp_extract_all(c, F.lit(r"([0-9A-Za-z]+|[^0-9A-Za-z]+)"), 1)
    return F.array_join(F.reverse(F.transform(runs, lambda r: F.when(r.rlike("^[0-9A-Za-z]"), r).otherwise(F.reverse(r)))), "")
