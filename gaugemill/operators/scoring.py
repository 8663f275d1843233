"""From documents and responses to outcomes and unit rows.

Fixed fields are compared side by side: one wide row a unit, no shuffle but the response join. The long form is made from the wide one
for failures and for categories whose fields vary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugemill.functions.comparators import comparator, null_rule, outcome


def explode_files(manifest: DataFrame, variants: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, variants map<string, array<string>>) to one row a file: doc_id, variant, file, seq (place in the manifest's order)."""
    files = manifest.select("doc_id", F.explode("variants").alias("variant", "files"))
    if variants is not None:
        files = files.filter(F.col("variant").isin(list(variants)))
    return files.select("doc_id", "variant", F.posexplode("files").alias("seq", "file"))


def select_units(files: DataFrame, known_tools: Sequence[str], tools: str = "all", variants: str = "all", limit: int | None = None, strict: bool = True) -> DataFrame:
    """Units of the chosen tools: each file with each tool. Unknown tools are an error when running (``strict``), dropped when scoring."""
    wanted = list(known_tools) if tools == "all" else [t.strip() for t in tools.split(",") if t.strip()]
    if strict and (unknown := sorted(set(wanted) - set(known_tools))):
        raise ValueError(f"unknown tools: {', '.join(unknown)}")
    wanted = [t for t in wanted if t in set(known_tools)]
    kept = files if variants == "all" else files.filter(F.col("variant").isin([v.strip() for v in variants.split(",")]))
    if limit is not None:
        kept = kept.orderBy("doc_id", "variant").limit(limit)
    return kept.withColumn("tool", F.explode(F.array(*map(F.lit, wanted)).cast("array<string>")))


def unpivot(wide: DataFrame, keys: Sequence[str], fields: Sequence[str], value: str) -> DataFrame:
    """One row a field in the configured order: keys, field_seq, field, value (as string; arrays as JSON)."""
    kinds = dict(wide.dtypes)
    text = lambda f: F.to_json(f) if kinds.get(f, "").startswith("array") else F.date_format(f, "yyyy-MM-dd") if kinds.get(f) == "date" else F.col(f).cast("string") if f in kinds else F.lit(None).cast("string")
    rows = F.array(*[F.struct(F.lit(i).alias("field_seq"), F.lit(f).alias("field"), text(f).alias(value)) for i, f in enumerate(fields, 1)])
    return wide.select(*keys, F.inline(rows))


def unpivot_truth(truth: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    return unpivot(truth, keys, fields, "truth")


def unpivot_prediction(answers: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("tool", "doc_id")) -> DataFrame:
    """A field that the answers lack is null; other columns are ignored."""
    return unpivot(answers, keys, fields, "answer")


def long_rows(wide: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows with truth_<field> and answer_<field> to one row a field: keys, field_seq, field, truth, answer. No shuffle."""
    rows = F.array(*[F.struct(F.lit(i).alias("field_seq"), F.lit(f).alias("field"), F.col(f"truth_{f}").cast("string").alias("truth"), F.col(f"answer_{f}").cast("string").alias("answer")) for i, f in enumerate(fields, 1)])
    return wide.select(*keys, F.inline(rows))


def drop_unscored(pairs: DataFrame) -> DataFrame:
    """Pairs whose field its document lists as unscored leave every denominator."""
    return pairs.filter(~F.array_contains("unscored_fields", F.col("field")))


def pair_units(files: DataFrame, tools: DataFrame, responses: DataFrame, on: Sequence[str] = ("tool", "doc_id", "variant")) -> DataFrame:
    """Every tool with every file, and its response where there is one; ``status`` is skipped, failed or answered. ``tools`` is a short configured list."""
    grid = files.crossJoin(F.broadcast(tools))
    marked = responses.withColumn("__there", F.lit(True))
    joined = grid.join(marked.hint("merge"), list(on), "left")
    return joined.withColumn("status", F.when(F.col("__there").isNull(), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("answered")).drop("__there")


def align(truth_long: DataFrame, answers_long: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each truth row with its answer, null where there is none."""
    return truth_long.join(answers_long.hint("merge"), list(on), "left")


def attach_context(pairs: DataFrame, minor_units: DataFrame) -> DataFrame:
    """minor_units by currency, 2 by default. The look-up has a row a currency."""
    return pairs.join(F.broadcast(minor_units), "currency", "left").withColumn("minor_units", F.coalesce("minor_units", F.lit(2)))


def pending_work(units: DataFrame, responses: DataFrame, on: Sequence[str] = ("tool", "doc_id")) -> DataFrame:
    """Units without a response, or whose response has an error."""
    return units.join(responses.filter("error is null").select(*on).distinct().hint("merge"), list(on), "left_anti")


def reconcile(manifest: DataFrame, truth: DataFrame) -> DataFrame:
    """Documents of one side only: doc_id, rule."""
    listed, known = manifest.select("doc_id").distinct(), truth.select("doc_id").distinct()
    return listed.join(known, "doc_id", "left_anti").select("doc_id", F.lit("listed without truth").alias("rule")).unionByName(known.join(listed, "doc_id", "left_anti").select("doc_id", F.lit("truth without listing").alias("rule")))


def coverage_gaps(manifest: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected variants that a document's files lack: doc_id, variant. A document without a list (null) lacks them all."""
    missing = F.array_except(F.array(*map(F.lit, expected)), F.coalesce(F.map_keys("variants"), F.array().cast("array<string>")))
    return manifest.select("doc_id", F.explode(missing).alias("variant"))


def score_pairs(pairs: DataFrame, registry: dict[str, str], context: dict[str, Column] | None = None) -> DataFrame:
    """Add ``outcome`` to a long pair table (field, truth, answer, error) by each field's comparator."""
    unknown = sorted(set(registry.values()) - {n for n in registry.values() if comparator(n)})
    if unknown:
        raise ValueError(f"unknown comparators: {unknown}")
    which = F.element_at(F.create_map(*[F.lit(x) for kv in registry.items() for x in kv]), F.col("field"))
    names = list(dict.fromkeys(registry.values()))
    return pairs.withColumn("outcome", outcome(names, which, F.col("truth"), F.col("answer"), context or {}, F.col("error")))


def score_wide(units: DataFrame, registry: dict[str, str], context: dict[str, Column] | None = None, alternates: str | None = None) -> DataFrame:
    """Add a struct ``outcomes`` (an outcome a field) to rows with truth_<field>, answer_<field>, error and unscored_fields; null where unscored.

    ``alternates`` names a column map<field, array<string>> of other right answers."""

    def one(field: str) -> Column:
        truth, answer = F.col(f"truth_{field}").cast("string"), F.col(f"answer_{field}").cast("string")
        given = (context or {}) | ({"alternates": F.element_at(alternates, field)} if alternates and registry[field] == "name" else {})
        judged = F.when(F.col("error").isNotNull(), "incorrect").otherwise(null_rule(truth, answer, comparator(registry[field])(truth, answer, given)))
        return F.when(~F.array_contains("unscored_fields", field), judged).alias(field)

    return units.withColumn("outcomes", F.struct(*[one(f) for f in registry]))


def unit_rows(scored: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row a unit from wide outcomes: n_fields, n_correct, n_hallucination, exact, with error, cost_usd and latency_ms. No shuffle."""
    each = F.array(*[F.col(f"outcomes.{f}") for f in fields])
    count = lambda o: F.size(F.filter(each, F.lit(o).__eq__)).cast("long")
    n = F.size(F.filter(each, lambda x: x.isNotNull())).cast("long")
    return scored.select(*keys, n.alias("n_fields"), count("correct").alias("n_correct"), count("hallucination").alias("n_hallucination"), ((count("correct") == n) & F.col("error").isNull()).alias("exact"), "error", "latency_ms", "cost_usd")


def outcome_rows(scored: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row a scored field from wide outcomes: keys, field, truth, answer, outcome. No shuffle, and no comparison again."""
    text = lambda name: F.col(name).cast("string")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), text(f"truth_{f}").alias("truth"), text(f"answer_{f}").alias("answer"), F.col(f"outcomes.{f}").alias("outcome")) for f in fields])
    return scored.select(*keys, F.inline(rows)).filter("outcome is not null")


def unit_exact(pairs: DataFrame, keys: Sequence[str] = ("tool", "doc_id", "variant")) -> DataFrame:
    """Unit rows from a long pair table: one aggregation with partial results."""
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fields"), F.count_if(F.col("outcome") == "correct").alias("n_correct"), F.count_if(F.col("outcome") == "hallucination").alias("n_hallucination"), (F.bool_and(F.col("outcome") == "correct") & F.max("error").isNull()).alias("exact"))


def failures(pairs: DataFrame) -> DataFrame:
    """Pairs that aren't correct."""
    return pairs.filter(F.col("outcome") != "correct")


def union_runs(*runs: DataFrame) -> DataFrame:
    first, *rest = runs
    for r in rest:
        first = first.unionByName(r, allowMissingColumns=True)
    return first


def newest(responses: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The newest row of each key. Of rows written at the same time the one with the greatest content stays, so any partitioning keeps the same one."""
    content = F.sha2(F.to_json(F.struct(*[c for c in sorted(responses.columns) if c not in keys and c != order]), {"ignoreNullFields": "false"}), 256)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(content)))
    return responses.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
