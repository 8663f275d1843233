"""Scoring inputs derived from the star schema, by the same formulas in Spark and in SQL (``VIEWS``).

A document is an order with at least one line; three tools answer five fields of it, with errors planted by arithmetic on its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = (("party_id", "identifier"), ("invoice_date", "date"), ("due_date", "date"), ("total", "amount"), ("line_item_count", "integer"))
TOOLS = (("t_a", 5), ("t_b", 7), ("t_c", 11))
DIMENSIONS = ("country", "region", "segment", "tax_mode", "variant")
ANSWERED = "doc_id % 97 <> 3"  # documents that the tools were given
PRICES = (("t_a", "0.0125"), ("t_b", "0.0040"), ("t_c", "0.0021"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents of a task, which holds all rows that are made of them.
DOCUMENTS = 100_000


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents. The join by their key comes last: they leave it dealt out by ``doc_id``, so joins and sums by that need no exchange of the wider
    rows made of them. Their number sets the parts: Spark sizes parts by the bytes shuffled, which are few here."""
    parts = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf, "orders").count() // DOCUMENTS))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).repartition(parts, "o_orderkey").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    nations = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows at any scale
    party = table(spark, sf, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf, "orders").join(party, F.col("o_custkey") == F.col("c_custkey"))
    d = F.col("o_orderdate").cast("date")
    return orders.repartition(parts, "o_orderkey").join(lines.hint("merge"), "o_orderkey").select(
        F.col("o_orderkey").alias("doc_id"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderstatus").alias("tax_mode"),
        F.col("o_orderpriority").alias("variant"),
        F.col("c_name").alias("party_id"),
        d.alias("invoice_date"),
        F.when(F.col("o_orderkey") % 13 != 0, F.date_add(d, 30)).alias("due_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
        F.col("n_lines").alias("line_item_count"),
        F.when(F.col("o_orderkey") % 29 == 0, F.array(F.lit("line_item_count"))).otherwise(F.array().cast("array<string>")).alias("unscored_fields"),
    )


def tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOOLS), "tool string, m int")


def responses(documents: DataFrame) -> DataFrame:
    """One row per answered (tool, doc_id): the five answers as strings, error, latency_ms, cost_usd. Columns stay one scan: tools are exploded."""
    tool = F.explode(F.array(*[F.struct(F.lit(t).alias("tool"), F.lit(m).alias("m")) for t, m in TOOLS]))
    wide = documents.filter(ANSWERED).withColumn("t", tool).select("*", "t.tool", "t.m").drop("t")
    k = lambda f: (F.col("doc_id") + f) % F.col("m")

    def answer(f: int, one: Column, two: Column, other: Column) -> Column:
        return F.when(k(f) == 0, None).when(k(f) == 1, one).when(k(f) == 2, two).otherwise(other)

    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    total = F.col("total").cast("string")
    n = F.col("line_item_count")
    return wide.select(
        "tool",
        "doc_id",
        "variant",
        answer(1, F.concat("party_id", F.lit("X")), F.concat(F.substring("party_id", 1, 9), F.lit("-"), F.substring("party_id", 10, 100)), F.col("party_id")).alias("party_id"),
        answer(2, iso(F.date_add("invoice_date", 1)), F.date_format("invoice_date", "MM/dd/yyyy"), iso("invoice_date")).alias("invoice_date"),
        answer(3, iso(F.date_add("invoice_date", 30)), iso("due_date"), iso("due_date")).alias("due_date"),
        answer(4, (F.col("total") + 1).cast("string"), F.concat(F.lit("$"), total), total).alias("total"),
        answer(5, (n + 1).cast("string"), n.cast("string"), n.cast("string")).alias("line_item_count"),
        F.when(F.col("doc_id") % (F.col("m") * F.col("m")) == 0, F.lit("call failed")).alias("error"),
        (F.lit(100.0) + (F.col("doc_id") * F.col("m")) % 900).alias("latency_ms"),
        (((F.col("doc_id") % 50) + F.col("m")) / F.lit(1000)).cast("decimal(18,6)").alias("cost_usd"),
    )


_FIELD_ROWS = " UNION ALL ".join(
    f"SELECT tool, doc_id, variant, error, {i} AS field_seq, '{f}' AS field, {t} AS truth, a_{f} AS answer, {'unscored' if f == 'line_item_count' else 'false'} AS unscored FROM answered"
    for i, (f, t) in enumerate((("party_id", "party_id"), ("invoice_date", "strftime(invoice_date, '%Y-%m-%d')"), ("due_date", "strftime(due_date, '%Y-%m-%d')"), ("total", "CAST(total AS VARCHAR)"), ("line_item_count", "CAST(line_item_count AS VARCHAR)")), 1)
)

#: Common table expressions: docs, tools, answered (truth and answers side by side), pairs (one row a scored pair, with outcome), units.
VIEWS = f"""WITH RECURSIVE docs AS (
  SELECT o_orderkey AS doc_id, n_name AS country, r_name AS region, c_mktsegment AS segment, o_orderstatus AS tax_mode, o_orderpriority AS variant,
    c_name AS party_id, CAST(o_orderdate AS DATE) AS invoice_date,
    CASE WHEN o_orderkey % 13 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) END AS due_date,
    CAST(o_totalprice AS DECIMAL(18,2)) AS total, n_lines AS line_item_count, o_orderkey % 29 = 0 AS unscored
  FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
tools(tool, m) AS (VALUES ('t_a', 5), ('t_b', 7), ('t_c', 11)),
answered AS (
  SELECT tool, m, docs.*, CASE WHEN doc_id % (m * m) = 0 THEN 'call failed' END AS error,
    100.0::DOUBLE + (doc_id * m) % 900 AS latency_ms, CAST(((doc_id % 50) + m) / 1000 AS DECIMAL(18,6)) AS cost_usd,
    CASE (doc_id + 1) % m WHEN 0 THEN NULL WHEN 1 THEN party_id || 'X' WHEN 2 THEN substr(party_id, 1, 9) || '-' || substr(party_id, 10) ELSE party_id END AS a_party_id,
    CASE (doc_id + 2) % m WHEN 0 THEN NULL WHEN 1 THEN strftime(invoice_date + INTERVAL 1 DAY, '%Y-%m-%d') WHEN 2 THEN strftime(invoice_date, '%m/%d/%Y') ELSE strftime(invoice_date, '%Y-%m-%d') END AS a_invoice_date,
    CASE (doc_id + 3) % m WHEN 0 THEN NULL WHEN 1 THEN strftime(invoice_date + INTERVAL 30 DAY, '%Y-%m-%d') ELSE strftime(due_date, '%Y-%m-%d') END AS a_due_date,
    CASE (doc_id + 4) % m WHEN 0 THEN NULL WHEN 1 THEN CAST(total + 1 AS VARCHAR) WHEN 2 THEN '$' || CAST(total AS VARCHAR) ELSE CAST(total AS VARCHAR) END AS a_total,
    CASE (doc_id + 5) % m WHEN 0 THEN NULL WHEN 1 THEN CAST(line_item_count + 1 AS VARCHAR) ELSE CAST(line_item_count AS VARCHAR) END AS a_line_item_count
  FROM docs, tools WHERE doc_id % 97 <> 3),
long AS ({_FIELD_ROWS}),
pairs AS (
  SELECT tool, doc_id, variant, error, field_seq, field, truth, answer,
    CASE WHEN error IS NOT NULL THEN 'incorrect' WHEN truth IS NULL AND answer IS NULL THEN 'correct' WHEN truth IS NULL THEN 'hallucination' WHEN answer IS NULL THEN 'incorrect'
      WHEN field = 'party_id' THEN CASE WHEN replace(truth, '-', '') = replace(answer, '-', '') THEN 'correct' ELSE 'incorrect' END
      WHEN field = 'total' THEN CASE WHEN truth = replace(answer, '$', '') THEN 'correct' ELSE 'incorrect' END
      WHEN answer LIKE '%/%' THEN CASE WHEN (CAST(substr(answer, 4, 2) AS INT) > 12 OR substr(answer, 1, 2) = substr(answer, 4, 2)) AND substr(answer, 7) || '-' || substr(answer, 1, 2) || '-' || substr(answer, 4, 2) = truth THEN 'correct' ELSE 'incorrect' END
      WHEN truth = answer THEN 'correct' ELSE 'incorrect' END AS outcome
  FROM long WHERE NOT unscored),
units AS (
  SELECT p.tool, p.doc_id, p.variant, count(*) AS n_fields, count(*) FILTER (outcome = 'correct') AS n_correct, count(*) FILTER (outcome = 'hallucination') AS n_hallucination,
    bool_and(outcome = 'correct') AND p.error IS NULL AS exact, p.error, any_value(latency_ms) AS latency_ms, any_value(cost_usd) AS cost_usd
  FROM pairs p JOIN answered a ON a.tool = p.tool AND a.doc_id = p.doc_id GROUP BY p.tool, p.doc_id, p.variant, p.error)
"""
