"""Check digits of accounts and tax numbers, as folds over characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugemill.functions.dates import date_of

B36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The alphabet and weights of Chinese credit codes (GB 32100-2015).
USCC = "0123456789ABCDEFGHJKLMNPQRTUWXY"
USCC_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)


def characters(c: Column, first: int, last: int) -> Column:
    """Characters from ``first`` to ``last``, from 0 on."""
    return F.split(F.substring(c, first + 1, last - first + 1), "")


def value_at(alphabet: str, c: Column) -> Column:
    return F.position(c, F.lit(alphabet)) - 1


def mod97(s: Column) -> Column:
    """Remainder of a string in which letters stand for 10 to 35."""
    step = lambda acc, ch: F.when(ch.rlike("[0-9]"), F.pmod(acc * 10 + ch.try_cast("int"), F.lit(97))).otherwise(F.pmod(acc * 100 + value_at(B36, ch).cast("int"), F.lit(97)))
    return F.aggregate(F.split(s, ""), F.lit(0), step)


def valid_iban(c: Column) -> Column:
    s = F.upper(F.translate(c, " ", ""))
    turned = F.concat(F.substring(s, 5, 1000), F.substring(s, 1, 4))
    return F.when(s.rlike("^[0-9A-Z]{15,}$"), mod97(turned) == 1).otherwise(False)


def weighted(chars: Column, alphabet: str, weights: tuple[int, ...]) -> Column:
    pairs = F.arrays_zip(chars.alias("c"), F.array(*map(F.lit, weights)).alias("w"))
    return F.aggregate(pairs, F.lit(0), lambda acc, p: acc + value_at(alphabet, p["c"]).cast("int") * p["w"])


def valid_clabe(c: Column) -> Column:
    total = weighted(characters(c, 0, 16), "0123456789", (3, 7, 1) * 5 + (3, 7))
    return F.when(c.rlike("^[0-9]{18}$"), ((10 - total % 10) % 10) == F.substring(c, 18, 1).try_cast("int")).otherwise(False)


def make_iban(country: str, bban: Column) -> Column:
    """An account with its two check digits; ``bban`` is digits and upper-case letters."""
    return F.concat(F.lit(country), F.lpad((98 - mod97(F.concat(bban, F.lit(f"{country}00")))).cast("string"), 2, "0"), bban)


def make_clabe(first: Column) -> Column:
    """Seventeen digits and their check digit."""
    total = weighted(characters(first, 0, 16), "0123456789", (3, 7, 1) * 5 + (3, 7))
    return F.concat(first, ((10 - total % 10) % 10).cast("string"))


def valid_account(c: Column) -> Column:
    return c.isNull() | valid_iban(c) | valid_clabe(c)


def valid_uscc(c: Column) -> Column:
    total = weighted(characters(c, 0, 16), USCC, USCC_WEIGHTS)
    return F.when(c.rlike(f"^[159Y][{USCC}][0-9]{{6}}[{USCC}]{{10}}$"), ((31 - total % 31) % 31) == value_at(USCC, F.substring(c, 18, 1))).otherwise(False)


def valid_gstin(c: Column) -> Column:
    pairs = F.arrays_zip(characters(c, 0, 13).alias("c"), F.array(*map(F.lit, (1, 2) * 7)).alias("w"))

    def add(acc: Column, p: Column) -> Column:
        v = value_at(B36, p["c"]).cast("int") * p["w"]
        return acc + v - F.when(v >= 36, 35).otherwise(0)

    total = F.aggregate(pairs, F.lit(0), add)
    return F.when(c.rlike("^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9]Z[0-9A-Z]$"), ((36 - total % 36) % 36) == value_at(B36, F.substring(c, 15, 1))).otherwise(False)


def valid_rfc(c: Column) -> Column:
    n = F.length(c)
    at = lambda i: F.substring(c, n - 9 + F.lit(i + 1), F.lit(2))
    year = at(0).try_cast("int")
    real = date_of(F.when(year <= 26, year + 2000).otherwise(year + 1900), at(2), at(4)).isNotNull()
    return F.when(c.rlike("^[A-Z]{3,4}[0-9]{6}[0-9A-Z]{3}$"), real).otherwise(False)


def valid_tax_id(country: Column, c: Column) -> Column:
    """By country; others and nulls pass."""
    return c.isNull() | F.when(country == "CN", valid_uscc(c)).when(country == "IN", valid_gstin(c)).when(country == "MX", valid_rfc(c)).otherwise(True)
