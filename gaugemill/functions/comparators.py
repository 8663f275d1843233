"""Comparators as column builders, and the registry through which categories add their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugemill.functions.amounts import half_even, parse_amount
from gaugemill.functions.dates import parse_date
from gaugemill.functions.text import bind, fold_digits, normalize_identifier, normalize_text, normalize_texts, stripped

#: name -> (truth, answer, context) -> whether two given values agree; null counts as no.
Builder = Callable[[Column, Column, dict[str, Column]], Column]
_BUILDERS: dict[str, Builder] = {}
_CONTEXTS: dict[str, Callable[[dict[str, Column]], dict[str, Column]]] = {}


def register_comparator(name: str, builder: Builder) -> None:
    _BUILDERS[name] = builder


def register_context(category: str, build: Callable[[dict[str, Column]], dict[str, Column]]) -> None:
    """``build`` maps a pair table's columns to what the category's comparators need, such as minor units."""
    _CONTEXTS[category] = build


def context_of(category: str, columns: dict[str, Column]) -> dict[str, Column]:
    return _CONTEXTS[category](columns) if category in _CONTEXTS else columns


def comparator(name: str) -> Builder:
    if name not in _BUILDERS:
        raise ValueError(f"no comparator is named {name!r}; there are {sorted(_BUILDERS)}")
    return _BUILDERS[name]


def null_rule(truth: Column, answer: Column, agrees: Column) -> Column:
    """correct, incorrect or hallucination, by what is null first."""
    return (
        F.when(truth.isNull() & answer.isNull(), "correct")
        .when(truth.isNull(), "hallucination")
        .when(answer.isNull(), "incorrect")
        .when(F.coalesce(agrees, F.lit(False)), "correct")
        .otherwise("incorrect")
    )


def exact(truth: Column, answer: Column, ctx: dict[str, Column]) -> Column:
    return normalize_text(truth) == normalize_text(answer)


def name(truth: Column, answer: Column, ctx: dict[str, Column]) -> Column:
    """The printed name, or any alternate (an array of strings) that isn't empty."""
    own = exact(truth, answer, ctx)
    if "alternates" not in ctx:
        return own
    given = normalize_texts(F.filter(ctx["alternates"], lambda a: a != ""))
    return own | F.coalesce(F.array_contains(F.filter(given, lambda a: a != ""), normalize_text(answer)), F.lit(False))


def identifier(truth: Column, answer: Column, ctx: dict[str, Column]) -> Column:
    return normalize_identifier(truth) == normalize_identifier(answer)


def date(truth: Column, answer: Column, ctx: dict[str, Column]) -> Column:
    return parse_date(truth) == parse_date(answer)


def amount(truth: Column, answer: Column, ctx: dict[str, Column]) -> Column:
    """Equal after rounding half-even to the currency's minor units."""
    minor = ctx.get("minor_units", 2)
    return half_even(parse_amount(truth), minor) == half_even(parse_amount(answer), minor)


def rate_set(truth: Column, answer: Column, ctx: dict[str, Column]) -> Column:
    """Texts of JSON arrays, as sets of numbers; anything but an array, and an array with an unreadable member, agrees with nothing."""

    def members(c: Column) -> Column:
        c = stripped(c)
        read = F.transform(F.from_json(c, "array<string>"), parse_amount)
        return bind(read, lambda r: F.when(c.startswith("[") & ~F.exists(r, lambda x: x.isNull()), F.array_sort(F.array_distinct(r))))

    return members(truth) == members(answer)


def integer(truth: Column, answer: Column, ctx: dict[str, Column]) -> Column:
    read = lambda c: bind(stripped(fold_digits(c)), lambda s: F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("bigint")))
    return read(truth) == read(answer)


for _name, _builder in (("exact", exact), ("name", name), ("identifier", identifier), ("date", date), ("amount", amount), ("rate_set", rate_set), ("integer", integer)):
    register_comparator(_name, _builder)


def outcome(names: list[str], which: Column, truth: Column, answer: Column, ctx: dict[str, Column], error: Column | None = None) -> Column:
    """The outcome of a pair by the comparator that ``which`` names; a failed call's pairs are all incorrect."""
    rules = F.when(error.isNotNull(), "incorrect") if error is not None else F.when(F.lit(False), "incorrect")
    for n in names:
        rules = rules.when(which == n, null_rule(truth, answer, comparator(n)(truth, answer, ctx)))
    return rules.otherwise(F.raise_error(F.concat(F.lit("no comparator is named "), which)))
