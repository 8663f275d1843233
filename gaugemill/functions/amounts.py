"""Amounts: parsing with a format class, rounding, and printing in national styles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugemill.functions.text import bind, fold_digits, stripped

AMOUNT, READ_PLACES = "decimal(38,6)", 12
#: Minor units by currency, marks before and around an amount.
MINOR_UNITS = {"USD": 2, "EUR": 2, "GBP": 2, "INR": 2, "CNY": 2, "JPY": 0, "KRW": 0, "BRL": 2, "MXN": 2, "SAR": 2, "AED": 2, "IDR": 2, "THB": 2}
CURRENCY_PREFIXES = ("R$", "Rp", "Rs", "NT$", "CA$", "A$", "MX$", "US$", "د.إ", "ر.س")
CURRENCY_SYMBOLS = "$€£¥₹฿₩₺₫"
SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "INR": "₹", "CNY": "¥", "JPY": "¥", "KRW": "₩", "BRL": "R$", "MXN": "$", "SAR": "ر.س", "AED": "د.إ", "IDR": "Rp", "THB": "฿"}
SYMBOL_AFTER = ("EUR", "SAR", "AED")


def bare_amount(c: Column) -> Column:
    """The text of an amount without spaces, currency marks and codes."""
    s = F.translate(stripped(fold_digits(c.cast("string"))), "  ", "")
    prefix = "|".join(p.replace("$", r"\$").replace(".", r"\.") for p in CURRENCY_PREFIXES)
    s = F.regexp_replace(s, f"^(?:{prefix})", "")
    s = F.regexp_replace(s, f"^[{CURRENCY_SYMBOLS}]+|[{CURRENCY_SYMBOLS}]+$", "")
    return F.regexp_replace(F.regexp_replace(s, "[A-Za-z]{3}$", ""), "^[A-Za-z]{3}", "")


def read_amount(c: Column) -> Column:
    """Struct (class, value). Classes: plain, us (1,234.56), eu (1.234,56), comma (548,01), none (unreadable, or beyond 26 digits before the point) or null.

    The separators tell the class: none or a point is plain; a comma before two digits is comma; several of one kind before
    one of the other, three digits apart, are us or eu. ``value`` holds 12 digits after the point; of longer
    fractions the last one only tells whether anything follows, so that rounding to fewer than 12 places is that of the whole number."""

    def judged(s: Column) -> Column:
        sign = F.when(F.substring(s, 1, 1).isin("+", "-"), F.substring(s, 1, 1)).otherwise("")
        body = F.substring(s, F.length(sign) + 1, F.length(s))
        return bind(F.struct(sign.alias("sign"), F.split(body, "[.,]", -1).alias("groups"), F.regexp_replace(body, "[0-9]", "").alias("marks")), classed)

    def classed(t: Column) -> Column:
        groups, marks, n = t["groups"], t["marks"], F.size(t["groups"])
        inner = F.slice(groups, F.lit(2), F.greatest(n - 2, F.lit(0)))
        threes = (t["sign"] == "") & (F.length(F.get(groups, F.lit(0))) <= 3) & F.forall(inner, lambda g: F.length(g) == 3)
        kind = (
            F.when(~F.forall(groups, lambda g: g.rlike("^[0-9]+$")), "none")
            .when(marks.isin("", "."), "plain")
            .when((marks == ",") & (t["sign"] != "+") & (F.length(F.element_at(groups, -1)) == 2), "comma")
            .when(threes & marks.rlike("^,+[.]$"), "us")
            .when(threes & marks.rlike("^[.]+,$"), "eu")
            .otherwise("none")
        )
        whole = F.array_join(F.slice(groups, F.lit(1), F.greatest(n - 1, F.lit(1))), "")
        part = F.when(n > 1, F.element_at(groups, -1)).otherwise("")
        rest = F.when(F.substring(part, READ_PLACES, 1_000_000).rlike("[1-9]"), "1").otherwise("0")
        part = F.when(F.length(part) > READ_PLACES, F.concat(F.substring(part, 1, READ_PLACES - 1), rest)).otherwise(part)
        value = F.concat(t["sign"], whole, F.lit("."), part, F.lit("0")).try_cast(f"decimal(38,{READ_PLACES})")
        return bind(F.struct(kind.alias("kind"), F.when(kind != "none", value).alias("value")), lambda r: F.struct(F.when(r["value"].isNull(), "none").otherwise(r["kind"]).alias("class"), r["value"].alias("value")))

    return bind(bare_amount(c), lambda s: F.when(s.isNotNull(), judged(s)))


def amount_class(c: Column) -> Column:
    return read_amount(c)["class"]


def parse_amount(c: Column) -> Column:
    """The value of ``read_amount``; plain numbers that fit are cast at once."""
    text = c.cast("string")
    return F.when(text.rlike(f"^-?[0-9]{{1,{38 - READ_PLACES}}}(?:[.][0-9]{{1,{READ_PLACES}}})?\\z"), text.try_cast(f"decimal(38,{READ_PLACES})")).otherwise(read_amount(c)["value"])


def by_scale(value: Column, minor: Column | int, rounding, scales=range(5)) -> Column:
    """``rounding(value, n)`` for n = ``minor``: a scale must be a literal."""
    if isinstance(minor, int):
        return rounding(value, minor).cast(AMOUNT)
    return bind(value, lambda v: reduce(lambda acc, n: acc.when(minor == n, rounding(v, n).cast(AMOUNT)), scales, F.when(F.lit(False), v.cast(AMOUNT))))


def half_even(value: Column, minor: Column | int) -> Column:
    """For comparing."""
    return by_scale(value, minor, F.bround)


def half_up(value: Column, minor: Column | int) -> Column:
    """For producing amounts."""
    return by_scale(value, minor, F.round)


def minor_units(currency: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MINOR_UNITS.items() for x in kv]), currency), F.lit(2))


def format_amount(value: Column, style: str, places: int) -> Column:
    """western 1,234.56, european 1.234,56, indian 12,34,567.00 or space 1 234.56."""
    rounded = F.round(value.cast("decimal(28,6)"), places)
    sign = F.when(rounded < 0, "-").otherwise("")
    digits = F.abs(rounded).cast(f"decimal(30,{places})").cast("string")
    whole, part = F.regexp_extract(digits, "^([0-9]+)", 1), F.regexp_extract(digits, r"\.([0-9]+)$", 1)
    if style == "indian":
        grouped = F.regexp_replace(whole, r"(?<=[0-9])(?=(?:[0-9]{2})*[0-9]{3}$)", ",")
    else:
        grouped = F.regexp_replace(whole, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", {"western": ",", "european": ".", "space": " "}[style])
    return F.concat(sign, grouped, *([F.lit("," if style == "european" else "."), part] if places else []))


def with_symbol(text: Column, currency: str, mode: str = "symbol") -> Column:
    """An amount with its symbol, its code or both."""
    if mode == "code":
        return F.concat(text, F.lit(f" {currency}"))
    mark = SYMBOLS[currency]
    shown = F.concat(text, F.lit(f" {mark}")) if currency in SYMBOL_AFTER else F.concat(F.lit(mark), text)
    return F.concat(shown, F.lit(f" {currency}")) if mode == "both" else shown
