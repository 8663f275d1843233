"""Leaderboards, recommendations, ordered picks and pivots."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from gaugemill.operators.metrics import block


def leaderboard(summary: DataFrame) -> DataFrame:
    """Tools by exact-match rate, ties by tool. A summary has a row a tool, so its one window partition is that small."""
    order = Window.orderBy(F.desc_nulls_last("exact_match.rate"), "tool")
    return summary.withColumn("place", F.row_number().over(order).cast("long"))


def leader(summary: DataFrame) -> DataFrame:
    """The best tool and its figures; ties by tool."""
    return summary.orderBy(F.desc_nulls_last("exact_match.rate"), "tool").limit(1)


def with_slice_metric(board: DataFrame, slices: DataFrame, dimension: str, values: Sequence[str]) -> DataFrame:
    """Replace each tool's exact-match block by that of slices, pooled by their counts; a tool without them is dropped."""
    chosen = slices.filter((F.col("dimension") == dimension) & F.col("value").isin(list(values))).groupBy("tool").agg(F.sum("n_exact").alias("s"), F.sum("n_units").alias("n"))
    return board.drop("exact_match").join(chosen.hint("merge"), "tool").withColumn("exact_match", block(F.col("s"), F.col("n"))).drop("s", "n")


def recommend(board: DataFrame, slices: DataFrame | None = None, where: dict[str, Sequence[str]] | None = None, max_mean_cost: str | None = None, min_rate: float | None = None) -> DataFrame:
    """Tools within the limits by rate, then cost of an exact unit (null last), then tool, with their place; ``where`` maps a dimension to its pooled slices."""
    for dimension, values in (where or {}).items():
        board = with_slice_metric(board, slices, dimension, values)
    if min_rate is not None:
        board = board.filter(F.col("exact_match.rate") >= min_rate)
    if max_mean_cost is not None:
        board = board.filter(F.col("mean_cost") <= F.lit(max_mean_cost).cast("decimal(28,6)"))
    order = Window.orderBy(F.desc_nulls_last("exact_match.rate"), F.asc_nulls_last("cost_per_exact"), "tool")
    return board.withColumn("place", F.row_number().over(order).cast("long"))


def top_failures(failures: DataFrame, order: Sequence[str], tool: str | None = None, country: str | None = None, field: str | None = None, n: int = 5) -> DataFrame:
    """The first n failures in the outputs' order; ``country`` is a prefix of doc_id."""
    if tool is not None:
        failures = failures.filter(F.col("tool") == tool)
    if field is not None:
        failures = failures.filter(F.col("field") == field)
    if country is not None:
        failures = failures.filter(F.col("doc_id").cast("string").startswith(country))
    return failures.orderBy(*order).limit(n)


def quota_sample(failures: DataFrame, rules: Sequence[tuple[str, Column, int]], order: Sequence[str], keys: Sequence[str], keep: int = 24) -> DataFrame:
    """Ordered rules (reason, condition, quota): each takes its first rows not taken before; ``keep`` in all. What a rule leaves stays for later ones.

    One scan and one exchange for any number of rules: a rule needs no rows beyond the first ones up to the sum of the quotas, and Spark keeps
    only that many of each before it shuffles. The choice goes over these few. Rows with equal ``keys`` are rows of their own; ties in ``order``
    follow the keys, then the whole row."""
    most, columns = sum(quota for _, _, quota in rules), failures.columns
    matched = F.filter(F.array(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(i)) for i, (_, condition, _) in enumerate(rules)]), lambda i: i.isNotNull())
    each = failures.withColumn("__row", F.monotonically_increasing_id()).withColumn("__rule", F.explode(matched))
    place = F.row_number().over(Window.partitionBy("__rule").orderBy(*order, *keys, F.xxhash64(*columns), "__row"))
    first = each.withColumn("__place", place).filter(F.col("__place") <= most).coalesce(1)

    def choose(batches):
        if not (held := list(batches)):
            return
        rows = pa.Table.from_batches(held)
        taken, chosen, found = set(), [], list(zip(*(rows.column(c).to_pylist() for c in ("__rule", "__place", "__row")), range(rows.num_rows), strict=True))
        for i, (_, _, quota) in enumerate(rules):
            own = [(row, at) for rule, _, row, at in sorted(found) if rule == i and row not in taken][:quota]
            taken |= {row for row, _ in own}
            chosen += [at for _, at in own]
        picked = rows.take(pa.array(chosen[:keep], pa.int64()))
        reasons = pa.array([rules[i][0] for i in picked.column("__rule").to_pylist()], pa.string())
        out = picked.select(columns).append_column("reason", reasons).append_column("rule", picked.column("__rule").cast(pa.int32()))
        yield from out.combine_chunks().to_batches()

    schema = StructType([*failures.schema.fields, StructField("reason", StringType()), StructField("rule", IntegerType())])
    rules = [(reason, None, quota) for reason, _, quota in rules]  # columns stay at the driver
    return first.mapInArrow(choose, schema)


def weakest_slices(slices: DataFrame, tool: str, dimensions: Sequence[str]) -> DataFrame:
    """A tool's slices, worst first."""
    return slices.filter((F.col("tool") == tool) & F.col("dimension").isin(list(dimensions))).orderBy(F.asc_nulls_last("exact_match.rate"), "dimension", "value")


def split_gap(public: DataFrame, private: DataFrame) -> DataFrame:
    """Per tool private rate minus public rate in percentage points; null where a side lacks it."""
    other = private.select("tool", F.col("exact_match.rate").alias("private_rate"))
    return public.select("tool", F.col("exact_match.rate").alias("public_rate")).join(other.hint("merge"), "tool", "left").withColumn("gap_points", (F.col("private_rate") - F.col("public_rate")) * 100)


def pick_by_priority(candidates: DataFrame, keys: Sequence[str], value: str, priority: str, position: str) -> DataFrame:
    """Among repeated answers the lowest priority number, then the first position."""
    return candidates.groupBy(*keys).agg(F.min_by(value, F.struct(priority, position)).alias(value))


def heatmap(slices: DataFrame, dimension: str, tools: Sequence[str]) -> DataFrame:
    """value x tool matrix of (rate, successes, n); cells without units stay null."""
    cell = F.struct(F.col("exact_match.rate").alias("rate"), F.col("n_exact").alias("successes"), F.col("n_units").alias("n"))
    return slices.filter(F.col("dimension") == dimension).groupBy("value").pivot("tool", list(tools)).agg(F.first(cell))
