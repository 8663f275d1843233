"""Vendor payloads to canonical answers (O65, O66). Labels are mapped, values aren't corrected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugemill.functions.dates import CONVENTIONS, localize_date
from gaugemill.functions.text import bind, extract_rates

#: Label types of expense payloads by field, with their priority (a lower number wins).
EXPENSE_FIELDS = (
    ("VENDOR_NAME", "vendor_name", 0), ("VENDOR_VAT_NUMBER", "vendor_tax_id", 0), ("VENDOR_GST_NUMBER", "vendor_tax_id", 0), ("TAX_PAYER_ID", "vendor_tax_id", 1),
    ("INVOICE_RECEIPT_ID", "invoice_number", 0), ("INVOICE_RECEIPT_DATE", "invoice_date", 0), ("DUE_DATE", "due_date", 0), ("PAYMENT_DUE_DATE", "due_date", 0),
    ("SUBTOTAL", "subtotal", 0), ("TAX", "tax_total", 0), ("TOTAL", "total", 0),
)
CURRENCY_FIELDS = (("TOTAL", 0), ("SUBTOTAL", 1), ("TAX", 2))
SELLER_WORDS = "vendor|seller|supplier|from|remit"
SUMMARY_FIELDS = "array<struct<Type: struct<Text: string>, LabelDetection: struct<Text: string>, ValueDetection: struct<Text: string>, Currency: struct<Code: string>>>"
EXPENSE_SCHEMA = f"ExpenseDocuments array<struct<SummaryFields: {SUMMARY_FIELDS}, LineItemGroups: array<struct<LineItems: array<string>>>>>"


def answer_text(raw: Column) -> Column:
    """The text of the first choice, or the parts of the first candidate put together."""
    v = F.try_parse_json(raw)
    parts = F.try_variant_get(v, "$.candidates[0].content.parts", "array<variant>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")
    return F.coalesce(F.try_variant_get(v, "$.choices[0].message.content", "string"), joined)


def canonicalize_chat(responses: DataFrame, fields: Sequence[str], count_field: str | None = "line_item_count") -> DataFrame:
    """Add a column a field from ``raw`` (JSON text): scalars as text, lists as JSON, null where absent; text that isn't a JSON object gives nulls.

    ``readable`` tells an object from anything else; ``kinds`` maps each field that is there to its JSON type."""
    parsed = responses.withColumn("__v", F.try_parse_json(answer_text(F.col("raw")))).withColumn("readable", F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False)))

    def value(f: str) -> Column:
        own = F.try_variant_get("__v", f"$.{f}", "variant")
        kind = F.schema_of_variant(own)
        text = F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(own)).otherwise(F.try_variant_get("__v", f"$.{f}", "string"))
        if f == count_field:  # 6.0 and "6" count as 6; what isn't a number stays as it is
            text = F.coalesce(F.when(text.rlike(r"^-?[0-9]+(\.0+)?$"), F.regexp_replace(text, r"\.0+$", "")), text)
        return F.when(F.col("readable") & (kind != "VOID"), text)

    return parsed.select(*responses.columns, "readable", *[value(f).alias(f) for f in fields])


def canonicalize_expense(responses: DataFrame) -> DataFrame:
    """(tool, doc_id, raw) to the fields of ``EXPENSE_FIELDS``, currency, tax_rates and line_item_count, row by row: nothing is shuffled.

    For each field the lowest priority, then the first position wins; a value must be there. Unreadable text gives nulls."""
    country = F.upper(F.substring(F.col("doc_id").cast("string"), 1, 2))
    convention = F.element_at(F.create_map(*[F.lit(x) for kv in CONVENTIONS.items() for x in kv]), country)
    parts = F.coalesce(F.from_json("raw", EXPENSE_SCHEMA)["ExpenseDocuments"], F.array().cast(EXPENSE_SCHEMA.split(" ", 1)[1]))

    def entry(f: Column, place: Column) -> Column:
        label = F.lower(F.coalesce(f["LabelDetection"]["Text"], F.lit("")))
        kind = F.upper(f["Type"]["Text"])
        kind = F.when((kind == "NAME") & label.rlike(SELLER_WORDS), "seller").otherwise(kind)
        return F.struct(place.alias("place"), kind.alias("kind"), label.alias("label"), f["ValueDetection"]["Text"].alias("value"), F.nullif(f["Currency"]["Code"], F.lit("")).alias("code"))

    entries = F.flatten(F.transform("parts", lambda d: F.coalesce(d["SummaryFields"], F.array().cast(SUMMARY_FIELDS))))
    counts = F.transform("parts", lambda d: F.aggregate(F.coalesce(d["LineItemGroups"], F.array().cast("array<struct<LineItems:array<string>>>")), F.lit(0), lambda acc, g: acc + F.coalesce(F.size(g["LineItems"]), F.lit(0))))
    read = responses.select("tool", "doc_id", parts.alias("parts")).select("tool", "doc_id", F.filter(F.transform(entries, entry), lambda e: e["value"].isNotNull()).alias("entries"), F.get(F.filter(counts, lambda n: n > 0), F.lit(0)).alias("line_item_count"))

    def best(ranks: dict[str, int], value: str) -> Column:
        rank = lambda e: F.coalesce(*[F.when(e["kind"] == k, F.lit(p)) for k, p in ranks.items()])
        given = F.filter("entries", lambda e: e["kind"].isin(list(ranks)) & e[value].isNotNull())
        return F.array_min(F.transform(given, lambda e: F.struct(rank(e), e["place"], e[value].alias("value"))))["value"]

    fields: dict[str, dict[str, int]] = {}
    for kind, field, priority in (*EXPENSE_FIELDS, ("seller", "vendor_name", 0)):
        fields.setdefault(field, {})[kind] = priority
    found = {f: best(ranks, "value") for f, ranks in fields.items()} | {"currency": best(dict(CURRENCY_FIELDS), "code")}
    found |= {f: localize_date(found[f], convention) for f in ("invoice_date", "due_date")}
    rates = F.flatten(F.transform(F.filter("entries", lambda e: e["kind"] == "TAX"), lambda e: extract_rates(e["label"])))
    rates = bind(F.array_sort(F.array_distinct(rates)), lambda r: F.when(F.size(r) > 0, r))
    return read.select("tool", "doc_id", *[c.alias(f) for f, c in found.items()], rates.alias("tax_rates"), "line_item_count")
