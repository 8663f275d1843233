"""The smallest category end to end, ordered picks, audits, stores, and the same results under any partitioning."""

import pytest
from pyspark.sql import functions as F

from gaugemill.operators import invoices, metrics, payloads, quality, ranking, scoring
from gaugemill.plans import queries, views
from gaugemill.sources import tables
from gaugemill.streaming import responses as streams

SF = "/root/testdata/sf0.001"
REGISTRY = {"widget_id": "identifier", "count": "integer"}


@pytest.fixture
def widgets(spark):
    truth = spark.createDataFrame([("EX-0001", "small", "WDG-001", "3"), ("EX-0002", "large", "WDG-002", "7"), ("EX-0003", "small", "WDG-003", None)], "doc_id string, size string, widget_id string, count string").withColumn("unscored_fields", F.array().cast("array<string>"))
    answers = spark.createDataFrame([("t", "EX-0001", "clean_pdf", "wdg-001", "3"), ("t", "EX-0002", "clean_pdf", "WDG-002", "6"), ("t", "EX-0003", "clean_pdf", "WDG-003", "5")], "tool string, doc_id string, variant string, widget_id string, count string")
    return truth, answers.withColumn("error", F.lit(None).cast("string")).withColumn("latency_ms", F.lit(1.0)).withColumn("cost_usd", F.lit(0).cast("decimal(18,6)"))


def wide(truth, answers):
    t = truth.select("doc_id", "unscored_fields", *[F.col(f).alias(f"truth_{f}") for f in REGISTRY])
    a = answers.select("tool", "doc_id", "variant", "error", "latency_ms", "cost_usd", *[F.col(f).alias(f"answer_{f}") for f in REGISTRY])
    return scoring.unit_rows(scoring.score_wide(a.join(t, "doc_id"), REGISTRY), list(REGISTRY), ["tool", "doc_id", "variant"])


def test_widgets(widgets):
    truth, answers = widgets
    units = wide(truth, answers)
    s = metrics.summarize(units).first()
    assert (s["n_exact"], s["n_units"], s["n_correct"], s["n_fields"], s["n_hallucination"], s["n_failed"]) == (1, 3, 4, 6, 1, 0)
    assert s["cost_per_exact"] == 0
    cut = {(r["dimension"], r["value"]): (r["n_exact"], r["n_units"]) for r in metrics.summarize_slices(units, metrics.dimension_coords(truth, ["size"])).collect()}
    assert cut == {("size", "small"): (1, 2), ("size", "large"): (0, 1)}
    long = scoring.align(scoring.drop_unscored(scoring.unpivot_truth(truth, list(REGISTRY), ("doc_id", "unscored_fields"))).drop("field_seq"), scoring.unpivot_prediction(answers, list(REGISTRY), ("tool", "doc_id", "variant", "error")), ("doc_id", "field"))
    scored = scoring.score_pairs(long, REGISTRY)
    assert scoring.failures(scored).count() == 2
    assert scoring.pending_work(units, answers).count() == 0


def test_failed_calls_spoil_every_field(widgets):
    truth, answers = widgets
    failed = wide(truth, answers.withColumn("error", F.lit("timeout"))).collect()
    assert all(r["n_correct"] == r["n_hallucination"] == 0 and not r["exact"] for r in failed)


def test_planted_totals(spark):
    want = {"t_a": (1457, 0, 7235, 4377, 23, 59), "t_b": (1457, 218, 7235, 5204, 17, 29), "t_c": (1457, 670, 7235, 5975, 10, 13)}
    got = {r["tool"]: (r["n_units"], r["n_exact"], r["n_fields"], r["n_correct"], r["n_hallucination"], r["n_failed"]) for r in queries.summary(spark, SF).collect()}
    assert got == want


def test_partitioning_changes_nothing(spark):
    results = []
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, queries.o37_summarize_slices(spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_unknown_tools(spark):
    files = spark.createDataFrame([("d", "v")], "doc_id string, variant string")
    with pytest.raises(ValueError, match="unknown tools: x"):
        scoring.select_units(files, ["t"], tools="t,x")
    assert scoring.select_units(files, ["t"], tools="t,x", strict=False).count() == 1


def test_quota_leaves_rows_to_later_rules(spark):
    rows = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(5)], "id int, kind string")
    got = ranking.quota_sample(rows, [("a", F.col("kind") == "a", 2), ("all", F.lit(True), 2)], ["id"], ["id"]).collect()
    assert [(r["id"], r["reason"]) for r in got] == [(0, "a"), (1, "a"), (2, "all"), (3, "all")]


def test_store_keeps_the_newest(spark, tmp_path):
    rows = spark.createDataFrame([("t", "m/1:2", "d", "v", "h", f"r{i}", 1.0, None, None, i) for i in range(3)], "tool_id string, tool_version string, doc_id string, variant string, sha256 string, raw string, latency_ms double, cost_usd decimal(18,6), error string, at long")
    tables.append_responses(rows.withColumn("written_at", F.timestamp_seconds("at")).drop("at"), str(tmp_path / "store"))
    (row,) = tables.read_responses(spark, str(tmp_path / "store"), ["t"]).collect()
    assert row["raw"] == "r2" and row["tool_version"] == "m_1_2"
    counts = streams.running_counts(streams.response_stream(spark, str(tmp_path / "store")))
    q = streams.keep_counts(counts, str(tmp_path / "counts"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "counts")).first()["answered"] == 3


def test_chat_payloads(spark):
    import json

    chat = lambda t: json.dumps({"choices": [{"message": {"content": t}}]})
    parts = json.dumps({"candidates": [{"content": {"parts": [{"text": '{"a": "x",'}, {"text": ' "line_item_count": 6.0}'}]}}]})
    rows = [(0, chat('{"a": 1.50, "line_item_count": "7"}')), (1, parts), (2, chat("[1]")), (3, "junk"), (4, None), (5, chat('{"a": null, "line_item_count": "many"}'))]
    got = payloads.canonicalize_chat(spark.createDataFrame(rows, "i int, raw string"), ["a", "line_item_count"]).orderBy("i").collect()
    assert [(r["readable"], r["a"], r["line_item_count"]) for r in got] == [(True, "1.5", "7"), (True, "x", "6"), (False, None, None), (False, None, None), (False, None, None), (True, None, "many")]


def test_evidence(spark):
    printed = spark.createDataFrame([(1, "a", "Total 12.50"), (1, "b", "0521"), (1, "c", "absent"), (2, "d", "١٢٫٥ ر"), (3, "e", "9")], "doc_id int, key string, rendered string")
    texts = spark.createDataFrame([(1, "TOTAL  12.50\nx 1250"), (2, "521 ر")], "doc_id int, text string")
    assert sorted(r["message"] for r in quality.check_evidence(printed, texts).collect()) == ["c=absent", "e=9"]


def test_generated_documents(spark):
    grid = invoices.document_grid(spark, 40, [("DE", "exclusive"), ("MX", "inclusive"), ("AE", "reverse_charge")])
    lines = invoices.generate_lines(invoices.seed_documents(grid, "s")).withColumn("rate", F.lit("16")).withColumnRenamed("tax_mode", "mode")
    sums = invoices.rollup_lines(invoices.apply_tax(lines))
    assert sums.count() == 40 and sums.filter("subtotal + tax_total <> total").count() == 0
    again = invoices.generate_lines(invoices.seed_documents(grid.repartition(7), "s"))
    columns = ["doc_id", "line_no", "price", "quantity", "amount"]
    assert sorted(map(tuple, again.select(*columns).collect())) == sorted(map(tuple, lines.select(*columns).collect()))


def test_truth_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"doc_id": "A",\n "fields": {"total": "1.00", "tax_rates": ["7"]}, "rendered_strings": {"total": "1,00"}}', encoding="utf-8")
    (row,) = tables.read_truth(spark, str(tmp_path)).collect()
    assert row["fields"]["tax_rates"] == ["7"] and row["rendered_strings"] == {"total": "1,00"} and row["unscored_fields"] is None


def test_views_have_their_fields():
    assert [f for f, _ in views.FIELDS] == queries.NAMES


def test_calendar_spans_all_orders(spark, tmp_path):
    rows = [(1, "1990-03-01"), (2, "2018-12-31"), (3, None), (4, "1996-02-29")]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: (r["era_year"], r["buddhist_year"]) for r in queries.QUERIES["o63_calendar_dim"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 2533), 2: (30, 2561), 3: (None, None), 4: (8, 2539)}
    spark.createDataFrame([], "o_orderkey long, o_orderdate string").write.parquet(f"{tmp_path}/none/orders.parquet")
    assert queries.QUERIES["o63_calendar_dim"](spark, f"{tmp_path}/none").count() == 0


def test_documents_without_a_text_stay(spark, tmp_path):
    spark.createDataFrame([(1, "A text.", "en", 7), (2, None, "en", None), (3, "", None, 0)], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["doc_id"] for r in queries.QUERIES["o54_normalize_documents"](spark, str(tmp_path)).collect()) == [1, 2, 3]
