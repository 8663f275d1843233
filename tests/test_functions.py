"""Golden cases of the comparators, metrics, calendars, check digits and money formats."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gaugemill.functions import amounts, checks, comparators, dates, text
from gaugemill.operators import metrics


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(v):
    return F.lit(v).cast("string")


AMOUNTS = [
    ("100000.00", "100000", 2, "correct"), ("100000.00", "1,00,000.00", 2, "incorrect"), ("100000.00", "1000000", 2, "incorrect"), ("68396.85", "68.396,85", 2, "correct"),
    ("9133.59", "$9,133.59", 2, "correct"), ("1234.56", "R$ 1.234,56", 2, "correct"), ("1234.56", "1234.56 USD", 2, "correct"), ("548.01", "548,01", 2, "correct"), ("68396.85", "68.396", 2, "incorrect"),
    ("1234.00", "1.234", 2, "incorrect"), ("12.345", "12.345", 3, "correct"), ("12.345", "12.3450", 3, "correct"), ("12.345", "12.35", 3, "incorrect"), ("132000", "132000", 0, "correct"), ("132000", "1320.00", 0, "incorrect"),
    ("1234.50", "1234.5", 2, "correct"), ("1234.50", "1234", 2, "incorrect"), ("100.00", "-100.00", 2, "incorrect"), (None, None, 2, "correct"), (None, "10.00", 2, "hallucination"), ("10.00", None, 2, "incorrect"), ("5.00", "٥.٠٠", 2, "correct"),
]


def test_amounts(spark):
    rows = spark.createDataFrame([(i, t, a, m) for i, (t, a, m, _) in enumerate(AMOUNTS)], "i int, t string, a string, m int")
    got = rows.select("i", comparators.null_rule(F.col("t"), F.col("a"), comparators.amount(F.col("t"), F.col("a"), {"minor_units": F.col("m")})).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [x[3] for x in AMOUNTS]
    assert one(spark, amounts.parse_amount(lit("1,234"))) is None and one(spark, amounts.amount_class(lit("1,234"))) == "none"
    assert one(spark, amounts.parse_amount(lit("1e+16"))) is None


@pytest.mark.parametrize(("shown", "iso"), [("2026-03-04T00:00:00Z", "2026-03-04"), ("06/27/2025", "2025-06-27"), ("27/06/2025", "2025-06-27"), ("May 28, 2025", "2025-05-28"), ("28 May 2025", "2025-05-28"), ("5.5.2025", "2025-05-05"), ("04/03/2026", None), ("2026-02-30", None), ("31 Foo 2020", None), ("0008-03-04", "0008-03-04"), ("", None)])
def test_dates(spark, shown, iso):
    assert str(one(spark, dates.parse_date(lit(shown))) or None) == str(iso)


PAIRS = [
    ("identifier", "DE123456789", "de 123 456-789", "correct"), ("identifier", "33637151000104", "33.637.151/0001-04", "correct"), ("identifier", "T1234567890123", "T1234567890124", "incorrect"),
    ("exact", "Acme Ltd", "ACME  ltd.", "correct"), ("exact", "Acme Ltd", "Acme GmbH", "incorrect"), ("exact", "Ａ① ß", "a1 SS", "correct"), ("exact", None, "something", "hallucination"), ("exact", "x", None, "incorrect"),
    ("rate_set", '["9","9"]', "[9]", "correct"), ("rate_set", '["16"]', '["16","10"]', "incorrect"), ("rate_set", '["18","1.65"]', '["1.65","18"]', "correct"), ("rate_set", "[]", "[]", "correct"), ("rate_set", '["9"]', '["x"]', "incorrect"), ("rate_set", '["9"]', '"9"', "incorrect"),
    ("integer", "6", "6", "correct"), ("integer", "6", "7", "incorrect"), ("integer", "6", "6.0", "incorrect"), ("integer", "6", " +6 ", "correct"),
    ("date", "2026-03-04", "04/03/2026", "incorrect"), ("date", "2026-03-04", "2569-03-04", "incorrect"), ("date", None, None, "correct"),
]


def test_comparators(spark):
    rows = spark.createDataFrame([(i, n, t, a) for i, (n, t, a, _) in enumerate(PAIRS)], "i int, n string, t string, a string")
    names = sorted({p[0] for p in PAIRS})
    got = rows.select("i", comparators.outcome(names, F.col("n"), F.col("t"), F.col("a"), {}).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [p[3] for p in PAIRS]
    with pytest.raises(ValueError, match="no comparator"):
        comparators.comparator("missing")


def test_alternates(spark):
    agrees = comparators.name(lit("東京オフィスサプライ株式会社"), lit("tokyo office supply k.k."), {"alternates": F.array(lit(""), lit("Tokyo Office Supply K.K."))})
    assert one(spark, agrees)
    assert one(spark, text.normalize_text(lit("  Foo   Bar Ltd. "))) == "foo bar ltd"


def test_wilson(spark):
    for (s, n), (lo, hi) in {(0, 0): (0, 0), (0, 10): (0, 0.2776), (10, 10): (0.7224, 1), (5, 10): (0.2366, 0.7634), (348, 455): (0.7237, 0.8015)}.items():
        got = one(spark, metrics.wilson(F.lit(s).cast("long"), F.lit(n).cast("long")))
        assert (got["lo"], got["hi"]) == (pytest.approx(lo, abs=2e-4), pytest.approx(hi, abs=2e-4))


def test_percentiles(spark):
    rows = spark.range(1, 101).selectExpr("cast(id as double) as latency_ms")
    assert metrics.latency_percentiles(rows, []).first()["p95"] == pytest.approx(95.05)
    assert metrics.latency_percentiles(rows.filter("latency_ms < 0"), []).first()["p50"] == 0.0


def test_calendars(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, dates.japanese_text(d("2026-03-04"))) == "令和8年3月4日"
    assert one(spark, dates.era_of(d("2019-04-30")))["era_year"] == 31
    assert one(spark, dates.era_of(d("2019-05-01")))["era"] == "令和"
    assert one(spark, dates.from_era(lit("令和"), F.lit(1), F.lit(3), F.lit(4))) is None
    assert one(spark, dates.thai_text(d("2026-03-04"))) == "4 มีนาคม 2569"


def test_check_digits(spark):
    assert one(spark, checks.valid_iban(lit("GB82 WEST 1234 5698 7654 32")))
    assert not one(spark, checks.valid_iban(lit("GB82 WEST 1234 5698 7654 33")))
    assert not one(spark, checks.valid_uscc(lit("H1QW9U96QL54NB7U8K")))
    assert not one(spark, checks.valid_rfc(lit("VWH527641YL2")))
    assert one(spark, checks.valid_clabe(lit("032180000118359719")))
    assert not one(spark, checks.valid_clabe(lit("032180000118359718")))
    assert one(spark, checks.valid_gstin(lit("27AAPFU0939F1ZV")))
    assert not one(spark, checks.valid_gstin(lit("27AAPFU0939F1ZW")))
    assert one(spark, checks.valid_account(F.lit(None).cast("string")))


def test_money(spark):
    half = lambda v, n: one(spark, amounts.half_up(F.lit(Decimal(v)).cast("decimal(20,6)"), F.lit(n)))
    assert half("1.005", 2) == Decimal("1.01") and half("2.675", 2) == Decimal("2.68") and half("1234.5", 0) == 1235
    assert one(spark, amounts.half_even(F.lit(Decimal("1234.505")).cast("decimal(20,6)"), F.lit(2))) == Decimal("1234.50")
    show = lambda v, style, n=2: one(spark, amounts.format_amount(F.lit(Decimal(v)), style, n))
    assert show("1234567.89", "western") == "1,234,567.89" and show("1234567.89", "european") == "1.234.567,89"
    assert show("1234567.00", "indian") == "12,34,567.00" and show("-999.5", "space") == "-999.50" and show("132000", "western", 0) == "132,000"
    assert one(spark, amounts.with_symbol(lit("5"), "EUR", "both")) == "5 € EUR"


@pytest.mark.parametrize(("country", "shown", "want"), [("DE", "10.02.2025", "2025-02-10"), ("US", "06/08/2026", "2026-06-08"), ("US", "02/30/2026", "02/30/2026"), ("JP", "2026/3/4", "2026-03-04"), (None, "1/2/2026", "1/2/2026")])
def test_localised_dates(spark, country, shown, want):
    assert one(spark, dates.localize_date(lit(shown), lit(dates.CONVENTIONS.get(country)))) == want


def test_one_rounding_and_any_script(spark):
    agree = lambda rule, a, b, ctx=None: one(spark, comparators.null_rule(lit(a), lit(b), rule(lit(a), lit(b), ctx or {})))
    assert agree(comparators.amount, "0.01", "0.0149999999") == "correct"
    assert agree(comparators.amount, "0.02", "0.0150000000000000000001") == "correct" and agree(comparators.amount, "0.02", "0.015") == "correct" and agree(comparators.amount, "0.02", "0.025") == "correct"
    assert agree(comparators.amount, "0.01", "0.0050000000000000000000001") == "correct" and agree(comparators.amount, "0.01", "0.005") == "incorrect"
    assert agree(comparators.amount, "9" * 26, "9" * 26 + ".00") == "correct" and one(spark, amounts.amount_class(lit("9" * 27))) == "none"
    for given, answer in (("Straße", "STRASSE"), ("ＡＣＭＥ", "acme."), ("ab", "AB")):
        assert agree(comparators.name, "Other", answer, {"alternates": F.array(F.lit(""), F.lit(given))}) == "correct"
    assert agree(comparators.name, "Other", "none of them", {"alternates": F.array(F.lit("x"))}) == "incorrect"


def test_made_accounts_are_valid(spark):
    from gaugemill.functions import checks

    rows = spark.range(300).select(checks.make_iban("DE", F.lpad(F.col("id").cast("string"), 18, "7")).alias("iban"), checks.make_clabe(F.lpad(F.col("id").cast("string"), 17, "3")).alias("clabe"))
    assert rows.filter(checks.valid_iban(F.col("iban")) & checks.valid_clabe(F.col("clabe"))).count() == 300
