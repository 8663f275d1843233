"""Rates with intervals, costs, latencies, summaries and slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugemill.sources.scratch import scratch

Z = 1.959963984540054


def wilson(successes: Column, n: Column) -> Column:
    """95 % Wilson interval as struct (lo, hi), clamped to [0, 1]; (0, 0) without trials."""
    p, z2 = successes.cast("double") / n, Z * Z
    centre, margin = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    lo, hi = F.greatest(F.lit(0.0), (centre - margin) / (1 + z2 / n)), F.least(F.lit(1.0), (centre + margin) / (1 + z2 / n))
    return F.when(n > 0, F.struct(lo.alias("lo"), hi.alias("hi"))).otherwise(F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")))


def rate(successes: Column, n: Column) -> Column:
    return F.when(n > 0, successes.cast("double") / n)


def block(successes: Column, n: Column) -> Column:
    """A metric: successes, n, rate (null without trials), interval."""
    return F.struct(successes.alias("successes"), n.alias("n"), rate(successes, n).alias("rate"), wilson(successes, n).alias("interval"))


def rate_with_wilson(df: DataFrame, success: Column, by: Sequence[str]) -> DataFrame:
    counted = df.groupBy(*by).agg(F.count_if(success).alias("successes"), F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rate", rate(F.col("successes"), F.col("n"))).withColumn("interval", wilson(F.col("successes"), F.col("n")))


SHARES = (("p50", 0.5), ("p95", 0.95))


def order_statistics(values: DataFrame, by: Sequence[str], column: str, weight: str, shares: Sequence[tuple[str, float]] = SHARES) -> DataFrame:
    """(by, a column a share): exact percentiles with linear interpolation of ``column``, each of whose rows stands for ``weight`` equal values; 0.0 without values.

    No task holds a group. Values are dealt out by range of (by, value) and written; the weights of the ranges are the histogram: of a group, a
    row a range. Running sums over these name the range that holds a rank, and only there values are ranked."""
    spark, place = values.sparkSession, [f"__by{i}" for i in range(len(by))]
    keyed = values.filter(F.col(column).isNotNull()).select(*[F.col(b).alias(p) for b, p in zip(by, place, strict=True)], F.col(column).cast("double").alias("__v"), F.col(weight).cast("long").alias("__w"))
    path, counted = scratch(spark, "ranges"), keyed.groupBy(*place, "__v").agg(F.sum("__w").alias("__w"))
    dealt = counted.repartitionByRange(*place, "__v").withColumn("__range", F.spark_partition_id())
    dealt.write.parquet(path)
    ranged = spark.read.schema(dealt.schema).parquet(path)
    sums = ranged.groupBy(*place, "__range").agg(F.sum("__w").alias("__in"))
    order = Window.partitionBy(*place).orderBy("__range")  # a row a range
    sums = sums.withColumn("__before", F.sum("__in").over(order) - F.col("__in")).withColumn("__n", F.sum("__in").over(Window.partitionBy(*place)))
    at = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(share) * (F.col("__n") - 1)).alias("at")) for name, share in shares])
    ranks = sums.select(*place, "__range", "__before", "__in", F.inline(at)).select("*", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    wanted = ranks.filter((F.col("rank") >= F.col("__before")) & (F.col("rank") < F.col("__before") + F.col("__in")))
    wanted = wanted.groupBy(*place, "__range", "__before").agg(F.collect_set(F.struct("name", "at", "rank")).alias("__ranks"))  # two a share
    schema, small = wanted.schema, scratch(spark, "ranks")
    wanted.write.parquet(small)  # read back, its size is known: Spark broadcasts it or not
    wanted = spark.read.schema(schema).parquet(small)
    same = [F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}")) for p in place] + [F.col("a.__range") == F.col("b.__range")]
    inside = ranged.alias("a").join(wanted.alias("b"), same).select(*[F.col(f"a.{p}") for p in place], "a.__range", "__v", "__w", "__before", "__ranks")
    upto = F.col("__before") + F.sum("__w").over(Window.partitionBy(*place, "__range").orderBy("__v"))  # one range of a group, the part of a task that wrote it
    hit = inside.withColumn("__upto", upto).select(*place, "__v", F.inline(F.filter("__ranks", lambda r: (r["rank"] < F.col("__upto")) & (r["rank"] >= F.col("__upto") - F.col("__w")))))
    share_of = F.when(F.floor("at") == F.ceil("at"), F.lit(1.0)).when(F.col("rank") == F.floor("at"), F.ceil("at") - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    found = hit.groupBy(*place).agg(*[F.sum(F.when(F.col("name") == name, F.col("__v") * share_of)).alias(name) for name, _ in shares])
    return found.select(*[F.col(p).alias(b) for p, b in zip(place, by, strict=True)], *[F.coalesce(name, F.lit(0.0)).alias(name) for name, _ in shares])


def beside(left: DataFrame, right: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``left`` with ``columns`` of ``right``, a row a group on both sides; null keys meet."""
    same = [F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by]
    other = right.alias("r").hint("merge") if by else F.broadcast(right.alias("r"))  # without groups there is one row
    return left.alias("l").join(other, same or F.lit(True), "left").select("l.*", *[F.col(f"r.{c}") for c in columns])


def latency_percentiles(units: DataFrame, by: Sequence[str], column: str = "latency_ms", approximate: bool = False) -> DataFrame:
    """A row a group: p50 and p95, exact for groups of any size; ``approximate`` is one aggregation."""
    if approximate:
        return units.groupBy(*by).agg(*[F.coalesce(F.percentile_approx(column, share, 100_000).cast("double"), F.lit(0.0)).alias(name) for name, share in SHARES])
    found = order_statistics(units.select(*by, column).withColumn("__one", F.lit(1)), by, column, "__one")
    return beside(units.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), found, by, [n for n, _ in SHARES]).select(*by, *[F.coalesce(n, F.lit(0.0)).alias(n) for n, _ in SHARES])


def cost_metrics(units: DataFrame, by: Sequence[str]) -> DataFrame:
    """total, mean over all units, cost of an exact unit (null when none is exact). Decimals: the same sums under any partitioning."""
    sums = units.groupBy(*by).agg(F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("e"))
    return sums.select(*by, *costs(F.col("cost_usd"), F.col("n"), F.col("e")))


def costs(cost: Column, n: Column, n_exact: Column) -> list[Column]:
    total = F.coalesce(cost, F.lit(0)).cast("decimal(28,6)")
    return [total.alias("total_cost"), F.try_divide(total, n).cast("decimal(28,6)").alias("mean_cost"), F.try_divide(total, F.nullif(n_exact, F.lit(0))).cast("decimal(28,6)").alias("cost_per_exact")]


#: What a partial state counts for each group and latency; states add up.
COUNTS = ("n_units", "n_exact", "n_fields", "n_correct", "n_hallucination", "n_failed", "n_skipped", "cost_usd")


def partial_state(units: DataFrame, by: Sequence[str] = ("tool",)) -> DataFrame:
    """Unit rows to a state that can be stored and added to: (by, latency_ms, ``COUNTS``), the latencies being an exact histogram.

    A unit with ``skipped`` true was never attempted: it counts as that alone."""
    skipped = F.coalesce(F.col("skipped"), F.lit(False)) if "skipped" in units.columns else F.lit(False)
    one = lambda c: F.when(~skipped, c).otherwise(F.lit(0)).cast("long")
    rows = units.select(
        *by, F.when(~skipped, F.col("latency_ms")).cast("double").alias("latency_ms"), one(F.lit(1)).alias("n_units"), one(F.col("exact").cast("int")).alias("n_exact"),
        *[one(F.col(c)).alias(c) for c in ("n_fields", "n_correct", "n_hallucination")], one(F.col("error").isNotNull().cast("int")).alias("n_failed"), skipped.cast("long").alias("n_skipped"),
        F.when(~skipped, F.col("cost_usd")).cast("decimal(28,6)").alias("cost_usd"),
    )
    return merged_states(rows, by)


def merged_states(states: DataFrame, by: Sequence[str] = ("tool",)) -> DataFrame:
    """The sum of states, given as one table."""
    return states.groupBy(*by, "latency_ms").agg(*[F.sum(c).cast("decimal(28,6)" if c == "cost_usd" else "long").alias(c) for c in COUNTS])


def summarize_state(state: DataFrame, by: Sequence[str] = ("tool",)) -> DataFrame:
    """The summary of a state: exact-match, field accuracy, hallucination and failure rates, units that were skipped, costs, exact latency percentiles."""
    path = scratch(state.sparkSession, "state")
    state.write.parquet(path)
    state = state.sparkSession.read.schema(state.schema).parquet(path)
    sums = state.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS])
    with_latency = beside(sums, order_statistics(state, by, "latency_ms", "n_units"), by, [n for n, _ in SHARES])
    return figures(with_latency.withColumns({n: F.coalesce(n, F.lit(0.0)) for n, _ in SHARES}), by)


def figures(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    pairs = (("exact_match", "n_exact", "n_units"), ("field_accuracy", "n_correct", "n_fields"), ("hallucination", "n_hallucination", "n_fields"), ("failure", "n_failed", "n_units"))
    return sums.select(*by, *[c for c in COUNTS if c != "cost_usd"], *costs(F.col("cost_usd"), F.col("n_units"), F.col("n_exact")), "p50", "p95", *[block(F.col(s), F.col(n)).alias(name) for name, s, n in pairs])


def summarize(units: DataFrame, by: Sequence[str] = ("tool",), approximate: bool = False) -> DataFrame:
    """Unit rows that carry their pair counts to a row a group. ``approximate``: percentiles by sketches, in one aggregation over the state."""
    state = partial_state(units, by)
    if not approximate:
        return summarize_state(state, by)
    own = latency_percentiles(units if "skipped" not in units.columns else units.filter(~F.coalesce(F.col("skipped"), F.lit(False))), by, approximate=True)
    sums = beside(state.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS]), own, by, [n for n, _ in SHARES])
    return figures(sums.withColumns({n: F.coalesce(n, F.lit(0.0)) for n, _ in SHARES}), by)


def dimension_coords(documents: DataFrame, dimensions: Sequence[str], key: str = "doc_id") -> DataFrame:
    """(key, dimension, value) rows; lists joined by +; nulls have no slice."""
    kinds = dict(documents.dtypes)
    text = lambda d: F.array_join(d, "+") if kinds[d].startswith("array") else F.col(d).cast("string")
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), text(d).alias("value")) for d in dimensions])
    return documents.select(key, F.inline(rows)).filter(F.col("value").isNotNull())


def summarize_slices(units: DataFrame, coords: DataFrame, key: str = "doc_id") -> DataFrame:
    """``summarize`` for each (tool, dimension, value), one dimension at a time."""
    return summarize(units.join(coords.hint("merge"), key), ("tool", "dimension", "value"))


def summarize_own_slices(units: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """``summarize_slices`` of units that carry their documents' dimensions: no join, and only states move."""
    return summarize(dimension_coords(units, dimensions, "*"), ("tool", "dimension", "value"))


def run_summary(units: DataFrame, responses: DataFrame, known: DataFrame, on: Sequence[str] = ("tool", "doc_id")) -> DataFrame:
    """Per tool documents, cached (answered before, without error), new and failed."""
    before = known.filter("error is null").select(*on).distinct().withColumn("__before", F.lit(True))
    now = responses.select(*on, F.col("error").isNotNull().alias("__failed"))
    joined = units.join(before.hint("merge"), list(on), "left").join(now.hint("merge"), list(on), "left")
    fresh = F.col("__before").isNull() & F.col("__failed").isNotNull()
    return joined.groupBy("tool").agg(F.count(F.lit(1)).alias("documents"), F.count_if("__before").alias("cached"), F.count_if(fresh & ~F.col("__failed")).alias("new"), F.count_if(fresh & F.col("__failed")).alias("failed"))


def cost_plan(units: DataFrame, prices: DataFrame, budget: str, pending: DataFrame | None = None) -> DataFrame:
    """Estimate a tool and in all (tool null), and whether the total is within the budget; with ``pending`` also what is left to do. ``prices`` has a row a tool."""
    own = units.join(F.broadcast(prices), "tool").groupBy("tool").agg(F.count(F.lit(1)).alias("n_units"), F.sum("price").cast("decimal(28,6)").alias("estimate"))
    if pending is not None:
        left = pending.join(F.broadcast(prices), "tool").groupBy("tool").agg(F.sum("price").cast("decimal(28,6)").alias("pending_estimate"))
        own = own.join(left.hint("merge"), "tool", "left").withColumn("pending_estimate", F.coalesce("pending_estimate", F.lit(0).cast("decimal(28,6)")))
    sums = [F.sum(c).cast(t).alias(c) for c, t in own.dtypes if c != "tool"]
    total = own.agg(*sums).select(F.lit(None).cast("string").alias("tool"), *[c for c in own.columns if c != "tool"])
    return own.unionByName(total).withColumn("within_budget", F.col("estimate") <= F.lit(budget).cast("decimal(28,6)"))


def inventory(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values: kind, value."""
    rows = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns])
    return results.select(F.inline(rows)).filter("value is not null").distinct()


def price_usage(responses: DataFrame, prices: DataFrame, default: tuple[str, str]) -> DataFrame:
    """cost = (tokens_in p_in + tokens_out p_out) / 10^6 by model, default prices for unknown models. ``prices`` has a row a model."""
    joined = responses.join(F.broadcast(prices), "model", "left")
    p_in, p_out = (F.coalesce(c, F.lit(d).cast("decimal(10,4)")) for c, d in zip(("p_in", "p_out"), default, strict=True))
    cost = (F.col("tokens_in").cast("decimal(18,0)") * p_in + F.col("tokens_out").cast("decimal(18,0)") * p_out) / F.lit(1_000_000).cast("decimal(10,0)")
    return joined.withColumn("cost_usd", cost.cast("decimal(28,6)"))
