"""Normal forms of texts and identifiers. ASCII is folded in the JVM; only what holds other characters is sent to the Arrow UDF, nulls in its place otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ARABIC_INDIC, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"


@F.pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def bind(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(c), use), 1)


def fold_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_INDIC, ASCII_DIGITS)


def arabic_digits(c: Column) -> Column:
    return F.translate(c, ASCII_DIGITS, ARABIC_INDIC)


#: White space in any script, with the separators from U+001C on: a class for the JVM's expressions.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"


def stripped(c: Column) -> Column:
    """Without white space at both ends, whatever its script."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def beyond_ascii(c: Column) -> Column:
    return F.octet_length(c) > F.length(c)


def folded(c: Column, ascii_way: Callable[[Column], Column] = F.lower, other_way: Callable[[Column], Column] = nfkc_casefold) -> Column:
    """NFKC and casefold; the JVM's own way where a text is ASCII."""
    return F.coalesce(F.when(~beyond_ascii(c), ascii_way(c)), other_way(F.when(beyond_ascii(c), c)))


def tidied(c: Column) -> Column:
    """One space for white space, trimmed, without trailing marks."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, f"{WHITE}+", " ")), r"[.,;:]+$", "")


def normalize_text(c: Column) -> Column:
    """NFKC, casefold, one space for white space, trimmed, without trailing marks."""
    return tidied(folded(c))


#: A private character that stands between texts that are folded together.
BETWEEN = "\ue000"


def normalize_texts(texts: Column) -> Column:
    """``normalize_text`` of an array's texts, folded in one call; nulls are left out."""
    joined = F.array_join(F.transform(texts, lambda t: F.translate(t, BETWEEN, "")), BETWEEN)
    return F.transform(F.split(folded(joined), BETWEEN), tidied)


def normalize_identifier(c: Column) -> Column:
    """NFKC, without spaces, tabs, hyphens, dots and slashes, upper case."""
    return F.upper(F.translate(folded(c, lambda x: x, nfkc), " \t-./", ""))


def extract_rates(label: Column) -> Column:
    """Distinct percentages in a tax label as sorted strings; none for retentions."""
    low = F.lower(label)
    found = F.transform(F.regexp_extract_all(low, F.lit(r"([0-9]+(?:[.,][0-9]+)?)\s*%"), F.lit(1)), lambda r: F.translate(r, ",", "."))
    return F.when(low.contains("reten"), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(found)))
