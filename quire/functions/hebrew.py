"""Word normalisation for Hebrew-script text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Clitic prefixes in the order they are tried; final letters and their base forms.
TWO_LETTER_PREFIXES = ["וה", "וש", "וב", "ול", "וכ", "ומ", "בה", "מה", "לה", "כש"]
ONE_LETTER_PREFIXES = ["ו", "ה", "ב", "ל", "כ", "מ", "ש"]
FINALS, BASES = "ךםןףץ", "כמנפצ"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_hebrew(c: str | Column) -> Column:
    """Any character of the Hebrew block."""
    return _c(c).rlike(r"[֐-׿]")


def clean_word(c: str | Column) -> Column:
    """Without format characters, and without punctuation and white space at the ends."""
    c = F.regexp_replace(_c(c), r"\p{Cf}", "")
    return F.regexp_replace(F.regexp_replace(c, r"^[\p{P}\s]+", ""), r"[\p{P}\s]+$", "")


@F.pandas_udf(StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """Decomposed and without combining marks; Spark has no built-in decomposition."""
    return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFD", x) if unicodedata.category(ch) != "Mn"))


def without_punctuation(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), r"[\p{P}\p{S}־׀׃׳״]", "")


def query_form(c: str | Column) -> Column:
    """Trimmed, without punctuation, white space in one blank."""
    return F.trim(F.regexp_replace(without_punctuation(F.trim(_c(c))), r"\s+", " "))


def base_letters(c: str | Column) -> Column:
    return F.translate(_c(c), FINALS, BASES)


def transliteration(c: str | Column, vowels: bool = True) -> Column:
    """Upper case, only A-Z, < > and $; without vowels on request."""
    out = F.regexp_replace(F.upper(_c(c)), r"[^A-Z<>$]", "")
    return out if vowels else F.translate(out, "AEIOU", "")


def stripped_forms(c: str | Column) -> Column:
    """All forms without one prefix, in the order tried; at least two letters stay. Null where a prefix does not fit."""
    c = _c(c)
    fits = lambda p: c.startswith(p) & (F.length(c) > len(p) + 1)
    forms = [F.when(fits(p), F.substring(c, len(p) + 1, 1000)) for p in TWO_LETTER_PREFIXES + ONE_LETTER_PREFIXES]
    return F.filter(F.array(*forms), lambda x: x.isNotNull())


def strip_prefix(c: str | Column) -> Column:
    """Without the first prefix that fits; the word itself if none does."""
    c = _c(c)
    return F.coalesce(F.get(stripped_forms(c), F.lit(0)), c)


def only_punctuation(c: str | Column) -> Column:
    return _c(c).rlike(r"(?U)^[\W_]+$")


def safe_name(c: str | Column, longest: int = 80) -> Column:
    """Letters, digits, '-' and '.'; everything else '_'; trimmed and cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(_c(c), r"[^A-Za-z0-9.\-]+", "_"), r"^_+|_+$", ""), 1, longest)
