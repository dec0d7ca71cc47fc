"""Identifiers and codes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colophon.functions import words as fixed
from colophon.functions.text import bound, casefold, col, find, mapping

ISBN_IN_TEXT = r"(?i)(?:97[89][- ]?)?\d{1,5}[- ]?\d{1,7}[- ]?\d{1,7}[- ]?[\dX]\b"


def _digit(text: Column, i: Column) -> Column:
    c = F.substring(text, i, F.lit(1))
    return F.when(c == "X", F.lit(10)).otherwise(c.cast("int"))


def _one_digit(text: Column) -> Column:
    return text.rlike(r"^(.)\1*$")


def _check13(first12: Column) -> Column:
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda s, i: s + _digit(first12, i) * F.when(i % 2 == 1, 1).otherwise(3))
    return (F.lit(10) - total % 10) % 10


def normalize_isbn(raw: Column | str) -> Column:
    """ID1: the 13 digits of a valid ISBN, or null."""
    return bound(_valid_isbn, F.upper(F.regexp_replace(col(raw), "[^0-9Xx]", "")))


def _valid_isbn(s: Column) -> Column:
    sum10 = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0), lambda t, i: t + (F.lit(11) - i) * _digit(s, i))
    ten = s.rlike(r"^\d{9}[\dX]$") & ~_one_digit(F.substring(s, 1, 9))
    from10 = F.concat(F.lit("978"), F.substring(s, 1, 9))
    thirteen = s.rlike(r"^97[89]\d{10}$") & ~_one_digit(F.substring(s, 4, 9))
    return F.when(ten, F.when(sum10 % 11 == 0, F.concat(from10, _check13(from10).cast("string")))).when(thirteen, F.when(_check13(s) == _digit(s, F.lit(13)), s))


def normalize_asin(raw: Column | str) -> Column:
    """ID2: B and nine signs, or a valid ISBN-10; else null."""
    s = F.upper(F.btrim(col(raw)))
    ten = (F.char_length(s) == 10) & normalize_isbn(s).isNotNull()
    return F.when(~_one_digit(s) & (s.rlike("^B[0-9A-Z]{9}$") | ten), s)


def isbns_in(text: Column | str) -> Column:
    """TX14: the different valid ISBNs printed in a text."""
    found = F.regexp_extract_all(col(text), F.lit(f"({ISBN_IN_TEXT})"), F.lit(1))
    return F.array_distinct(F.array_compact(F.transform(found, normalize_isbn)))


def language_code(value: Column | str) -> Column:
    """ID3."""
    v = casefold(F.btrim(col(value)))
    codes = sorted(set(fixed.LANGUAGE_CODES.values()))
    return F.coalesce(find(mapping(fixed.LANGUAGE_CODES), v), F.when(v.isin(codes), v))


def language_name(code: Column | str) -> Column:
    """ID4."""
    return F.coalesce(find(mapping(fixed.LANGUAGE_NAMES), col(code)), col(code))


def series_text(name: Column, index: Column) -> Column:
    """ID5: "Series [3]", whole numbers without decimals."""
    n = F.when(index == F.floor(index), F.floor(index).cast("string")).otherwise(index.cast("string"))
    return F.when(index.isNull(), name).otherwise(F.concat(name, F.lit(" ["), n, F.lit("]")))
