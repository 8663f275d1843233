"""Operators whose plans must hold at any size: exact percentiles, sums of partial states, row-local look-ups, one-pass choices, evidence."""

import hashlib
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugemill.functions import comparators, text
from gaugemill.operators import invoices, metrics, quality, ranking, scoring
from gaugemill.plans import queries, views
from gaugemill.sources import store, tables
from gaugemill.sources.published import Published
from gaugemill.sources.store import ResponseStore
from gaugemill.streaming import responses as streams

SF = "/root/testdata/sf0.1"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


# ---- percentiles and states


def test_percentiles_equal_the_exact_ones(spark):
    """On a whole table, with a group of a third of all rows, one value that repeats, nulls, a null group and a single row."""
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.when(F.col("event_id") % 3 == 0, "hot").when(F.col("event_id") % 97 == 1, None).otherwise(F.col("event_type")).alias("g"), F.when(F.col("event_id") % 11 == 0, 5.0).otherwise(F.when(F.col("event_id") % 13 > 0, F.col("value"))).alias("latency_ms"))
    e = e.unionByName(spark.createDataFrame([("one", 7.5), ("none", None)], "g string, latency_ms double"))
    got = {r["g"]: (r["p50"], r["p95"]) for r in metrics.latency_percentiles(e, ["g"]).collect()}
    want = {r["g"]: (r["a"] or 0.0, r["b"] or 0.0) for r in e.groupBy("g").agg(F.percentile("latency_ms", 0.5).alias("a"), F.percentile("latency_ms", 0.95).alias("b")).collect()}
    assert got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)


@pytest.mark.parametrize("partitions", ["1", "5", "40"])
def test_percentiles_under_any_partitioning(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), rng.choice([1e-300, -5.0, 0.25, 3.5, 1e300, 7.0], 500), strict=True)] + [(9, float(i)) for i in range(200)]
    got = {r["g"]: (r["p50"], r["p95"]) for r in metrics.latency_percentiles(spark.createDataFrame(rows, "g int, latency_ms double"), ["g"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, found in got.items():
        assert found == pytest.approx([np.percentile([v for h, v in rows if h == g], p) for p in (50, 95)], rel=1e-12)


def units(spark, rows):
    return spark.createDataFrame(rows, "tool string, doc_id int, n_fields long, n_correct long, n_hallucination long, exact boolean, error string, latency_ms double, cost_usd decimal(18,6), skipped boolean")


def test_states_add_up(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, 5, rng.randrange(6), 0, rng.random() < 0.4, rng.choice([None, None, "failed"]), rng.choice([None, 1.0, 2.5, float(i)]), Decimal(i) / 1000, rng.random() < 0.1) for i in range(400)]
    whole = metrics.summarize(units(spark, rows))
    parts = [metrics.partial_state(units(spark, rows[i::3])) for i in range(3)]
    added = metrics.summarize_state(metrics.merged_states(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    assert sorted(map(str, whole.collect())) == sorted(map(str, added.collect()))
    for r in whole.collect():
        own = [x for x in rows if x[0] == r["tool"] and not x[9]]
        latencies = [x[7] for x in own if x[7] is not None]
        assert (r["n_units"], r["n_skipped"], r["n_failed"]) == (len(own), sum(x[0] == r["tool"] and x[9] for x in rows), sum(x[6] is not None for x in own))
        assert r["total_cost"] == sum(x[8] for x in own) and (r["p50"], r["p95"]) == pytest.approx(np.percentile(latencies, [50, 95]).tolist())


def test_summaries_of_nothing(spark):
    assert metrics.summarize(units(spark, [])).count() == 0
    (r,) = metrics.summarize(units(spark, [("t", 1, 5, 0, 0, False, None, None, None, True)])).collect()
    assert (r["n_units"], r["n_skipped"], r["exact_match"]["rate"], r["p50"], r["mean_cost"]) == (0, 1, None, 0.0, None)


def test_no_task_holds_a_group(spark):
    """The histogram has a row a range of a group, and only ranges that hold a rank are ranked."""
    rows = spark.range(20_000).select(F.lit("t").alias("tool"), F.col("id").cast("double").alias("latency_ms"), F.lit(1).alias("w"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = metrics.order_statistics(rows, ["tool"], "latency_ms", "w")
    text_of = plan(found)
    assert found.first()["p50"] == 9999.5 and found.first()["p95"] == pytest.approx(18999.05)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "percentile" not in text_of and "collect_list" not in text_of


# ---- units of lines


KEYWORDS = [(1, "ring", "box"), (2, "widget", "ream"), (2, "Widget", "sheet")]
KNOWN = [("A", "ream", False), ("A", "pcs", True), ("B", "box", False), ("B", "pc", True)]


def test_units_are_row_local(spark):
    keywords, known = spark.createDataFrame(KEYWORDS, "group_seq int, keyword string, unit string"), spark.createDataFrame(KNOWN, "country string, unit string, generic boolean")
    rows = [("A", "a ring"), ("A", "a ring"), ("A", "a ring"), ("B", "RING widget"), ("A", "ring widget"), ("A", "Widgets"), ("B", "widget"), ("B", None), ("C", "ring"), (None, "ring")]
    lines = spark.createDataFrame(rows, "country string, d string").withColumns({c: F.lit(1) for c in ("group_seq", "generic", "keyword")})
    out = invoices.assign_units(lines, keywords, known, F.col("d"))
    assert out.columns == [*lines.columns, "unit"]
    assert sorted((str(r["country"]), str(r["d"]), r["unit"]) for r in out.collect()) == sorted([("A", "a ring", "pcs")] * 3 + [("B", "RING widget", "box"), ("A", "ring widget", "pcs"), ("A", "Widgets", "ream"), ("B", "widget", "pc"), ("B", "None", "pc"), ("C", "ring", None), ("None", "ring", None)], key=lambda r: (r[0], r[1], str(r[2])))
    assert "Exchange" not in plan(out) and "Join" not in plan(out)
    none = invoices.assign_units(lines, keywords.limit(0), known.limit(0), F.col("d"))
    assert none.filter("unit is null").count() == len(rows)


# ---- scoring


def test_units_move_only_documents(spark):
    """Tools' answers, three a document, and their pairs are made where their document lies."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for make in (queries.units, queries.pairs, lambda s, sf: queries.scoring.unit_exact(queries.pairs(s, sf))):
        text_of = plan(make(spark, "/root/testdata/sf0.001"))
        assert text_of.count("Exchange hashpartitioning(o_orderkey") in (2, 4) and "hashpartitioning(doc_id" not in text_of
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parts_follow_the_documents(spark, monkeypatch):
    """A task holds a bounded number of documents, however few bytes they are."""
    monkeypatch.setattr(views, "DOCUMENTS", 100)
    d = queries.docs(spark, "/root/testdata/sf0.001")
    assert d.rdd.getNumPartitions() == 15 and d.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200


def test_buckets_follow_the_records(spark, monkeypatch):
    assert store.buckets_for(0) == 8 and all(n / store.buckets_for(n) <= store.RECORDS for n in (10**6, 162 * 10**6))
    monkeypatch.setattr(store, "RECORDS", 100)
    _, filled = queries.response_store(spark, "/root/testdata/sf0.001")
    assert filled.buckets == 45 and filled.records().count() > 4500


def test_no_task_holds_all_ties(spark):
    assert "SinglePartition" not in plan(queries.QUERIES["o03_tied_responses"](spark, "/root/testdata/sf0.001")) and "Exchange RoundRobin" not in plan(queries.QUERIES["o03_tied_responses"](spark, "/root/testdata/sf0.001"))


# ---- quotas


def greedy(rows, rules, keep):
    taken, out = set(), []
    for reason, fits, quota in rules:
        own = [i for i, r in enumerate(rows) if i not in taken and fits(r)]
        own = sorted(own, key=lambda i: (rows[i][0], i))[:quota]
        taken |= set(own)
        out += [(rows[i][0], reason) for i in own]
    return out[:keep]


def test_quotas_in_one_pass(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("abc"), rng.random() < 0.5) for i in range(300)]
    rows += rows[:5]
    frame = spark.createDataFrame(rows, "id int, kind string, flag boolean").repartition(5)
    rules = [("a", F.col("kind") == "a", 4, lambda r: r[1] == "a"), ("flag", F.col("flag"), 7, lambda r: r[2]), ("any", F.lit(True), 9, lambda r: True), ("none", F.lit(None).cast("boolean"), 3, lambda r: False), ("a again", F.col("kind") == "a", 60, lambda r: r[1] == "a")]
    got = ranking.quota_sample(frame, [r[:3] for r in rules], ["id"], ["id"], keep=30)
    assert got.columns == ["id", "kind", "flag", "reason", "rule"] and frame.columns == ["id", "kind", "flag"]
    assert [(r["id"], r["reason"]) for r in got.collect()] == greedy(sorted(rows), [(a, c, b) for a, _, b, c in rules], 30)
    simple = ranking.quota_sample(spark.createDataFrame(rows, "id int, kind string, flag boolean"), [r[:3] for r in rules], ["id"], ["id"])
    assert plan(simple).count("Exchange") == 1 and plan(simple).count("Scan") == 1
    assert ranking.quota_sample(frame.limit(0), [r[:3] for r in rules], ["id"], ["id"]).count() == 0


# ---- evidence


def test_evidence_reads_a_text_once(spark, monkeypatch):
    word = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}q x" for i in range(40)]
    many = [(1, f"k{i}", w) for i, w in enumerate(word)] + [(1, "k0", word[0]), (2, "a", "in no text"), (3, "b", None), (None, "c", "x"), (4, "d", "12 500,00"), (4, "g", "13 500,00"), (5, "e", "olé")]
    texts = [(1, " ".join(word[::2])), (2, None), (4, "a 1250000 b"), (5, "OLÉ")]
    printed, pages = spark.createDataFrame(many, "doc_id int, key string, rendered string"), spark.createDataFrame(texts, "doc_id int, text string")
    want = sorted([f"k{i}={word[i]}" for i in range(1, 40, 2)] + ["a=in no text", "c=x", "g=13 500,00"])
    for together in (1000, 7, 1):
        monkeypatch.setattr(quality, "TOGETHER", together)
        assert sorted(r["message"] for r in quality.check_evidence(printed, pages, text.nfkc_casefold).collect()) == want
    monkeypatch.undo()
    assert plan(quality.check_evidence(printed, pages)).count("Join") == 1
    assert quality.check_evidence(printed.limit(0), pages).count() == 0


# ---- white space, ties, missing lists


def test_white_space_of_any_script(spark):
    check = lambda name, a, b: spark.range(1).select(comparators.comparator(name)(F.lit(a), F.lit(b), {})).first()[0]
    assert check("amount", "12.50", "\t12.50") and check("date", "2020-01-05", "2020-01-05\n") and check("integer", "7", "\t7") and check("integer", "7", " ٧\u0085")
    assert check("exact", "a b", " A \u0085B.") and check("date", "2020-01-05", "5 Jan 2020") and check("rate_set", '["7"]', " [7]")
    assert not check("integer", "7", "7 7") and not check("amount", "12.50", "12.51\t")


def test_normal_forms_leave_ascii_in_the_jvm(spark):
    rows = [("Straße ÉCOLE x",), ("PLAIN  text.",), (None,), ("ﬁne",), ("İ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(text.normalize_text(F.col("t"))).collect()]
    assert got == ["strasse école x", "plain text", None, "fine", "i̇"]
    ids = [r[0] for r in spark.createDataFrame([("ab-１ 2",), ("x.y/z",), (None,)], "t string").coalesce(1).select(text.normalize_identifier(F.col("t"))).collect()]
    assert ids == ["AB12", "XYZ", None]


def test_ties_keep_the_same_record(spark):
    rows = [("k", i % 3, f"raw{i}", None if i % 2 else "e") for i in range(30)] + [("n", None, "a", None), ("n", None, "b", None)]
    frame = spark.createDataFrame(rows, "key string, at int, raw string, error string")
    found = {n: sorted(map(tuple, scoring.newest(frame.repartition(n), ["key"], "at").collect())) for n in (1, 3, 16)}
    assert found[1] == found[3] == found[16] and found[1][0][1] == 2


def test_documents_without_a_list_lack_every_variant(spark):
    manifest = spark.createDataFrame([(1, {"clean": ["f"]}), (2, None), (3, {})], "doc_id int, variants map<string,array<string>>")
    assert sorted(map(tuple, scoring.coverage_gaps(manifest, ["clean", "scan"]).collect())) == [(1, "scan"), (2, "clean"), (2, "scan"), (3, "clean"), (3, "scan")]


# ---- the response store


def record(tool, doc, raw, at, error=None):
    return (tool, "m/1:2", doc, "v", f"hash-{doc}", raw, 1.0, None, error, at)


def records(spark, rows):
    schema = "tool_id string, tool_version string, doc_id string, variant string, sha256 string, raw string, latency_ms double, cost_usd decimal(18,6), error string, at long"
    return spark.createDataFrame(rows, schema).withColumn("written_at", F.timestamp_seconds("at")).drop("at")


def test_response_store(spark, tmp_path):
    store = ResponseStore(spark, str(tmp_path / "store"), buckets=4)
    assert store.generations() == [] and store.read().count() == 0
    store.append(records(spark, [record("t", f"d{i}", "old", 1, "timeout") for i in range(6)]))
    store.append(records(spark, [record("t", f"d{i}", "new", 2) for i in range(4)] + [record("u", "d0", "b", 3), record("u", "d0", "a", 3)]))
    versions = {"t": "m/1:2", "u": "m/1:2"}
    units = spark.createDataFrame([(t, f"d{i}", f"hash-d{i}") for t in "tu" for i in range(8)], "tool_id string, doc string, sha256 string").withColumn("key", F.lit(1))
    want = sorted([("t", f"d{i}", "answered", "new") for i in range(4)] + [("t", f"d{i}", "failed", "old") for i in (4, 5)] + [("t", f"d{i}", "skipped", None) for i in (6, 7)] + [("u", f"d{i}", "skipped", None) for i in range(1, 8)])
    for again in range(2):
        paired = store.pair(units, versions)
        got = sorted((tuple(r) for r in paired.select("tool_id", "doc", "status", "raw").collect()), key=str)
        kept = [r for r in got if r[:2] == ("u", "d0")]
        assert [r for r in got if r not in kept] == sorted(want, key=str) and len(kept) == 1 and kept[0][3] in "ab"
        first = kept if not again else first
        assert kept == first
        assert store.pending(units, versions).count() == 16 - 5
        assert plan(paired).count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan(paired)
        assert "Exchange" not in plan(store.read())
        assert len(store.generations()) == 1 and store.generations()[0][0] == again + 1
        store.compact()
    assert store.records().count() == 7 and store.read(tools=["u"]).count() == 1 and store.read({"t": "other"}).count() == 0
    assert ResponseStore(spark, str(tmp_path / "store"), buckets=9).read().count() == 7


def test_a_stream_counts_the_newest_of_each_key(spark, tmp_path):
    path, store = str(tmp_path / "in"), ResponseStore(spark, str(tmp_path / "store"), buckets=2)

    def arrive(rows):
        records(spark, rows).coalesce(1).write.mode("append").parquet(path)
        streams.keep_newest_counts(streams.response_stream(spark, path, 1), store, str(tmp_path / "counts"), str(tmp_path / "cp")).awaitTermination()
        return {r["tool_id"]: (r["answered"], r["failed"]) for r in spark.read.parquet(str(tmp_path / "counts")).collect()}

    assert arrive([record("t", "a", "x", 1, "timeout"), record("t", "b", "x", 1), record("u", "a", "x", 1)]) == {"t": (1, 1), "u": (1, 0)}
    assert arrive([record("t", "a", "y", 2), record("t", "b", "x", 1), record("t", "b", "x", 1)]) == {"t": (2, 0), "u": (1, 0)}
    assert arrive([record("t", "a", "late", 1, "timeout"), record("v", "c", "x", 5, "e")]) == {"t": (2, 0), "u": (1, 0), "v": (0, 1)}


# ---- scenarios


def test_scenarios(spark):
    rows = [("a", "levies", 1, "10.10"), ("a", "levies", 2, "0.05"), ("b", "whole", 1, "10.50"), ("c", "reverse", 1, "3.00"), ("d", "split", 1, "0.07"), ("e", "none", 1, "1.00")]
    lines = spark.createDataFrame(rows, "doc_id string, scenario string, line_no int, amount string").withColumn("amount", F.col("amount").cast("decimal(18,2)")).withColumn("doc_seed", F.lit(1)).withColumn("line_seed", F.lit(1))
    taxed = invoices.taxed_lines(lines.filter("doc_id <> 'e'"), queries.scenario_table(spark))
    got = {r["doc_id"]: r for r in invoices.invoice_taxes(taxed).collect()}
    shown = lambda d: [(x["label"], x["rate"], str(x["amount"])) for x in got[d]["tax_lines"]]
    # 12 % of 10.10 and 0.05 by line, levies on 10.15
    assert shown("a") == [("ICMS 12%", "12", "1.22"), ("PIS 1.65%", "1.65", "0.17"), ("COFINS 7.6%", "7.6", "0.77")]
    assert (str(got["a"]["subtotal"]), str(got["a"]["tax_total"]), str(got["a"]["total"]), got["a"]["item_count"]) == ("10.15", "2.16", "12.31", 2)
    assert shown("b") == [("Tax 10%", "10", "1.00")] and str(got["b"]["total"]) == "12.00"
    assert shown("c") == [("VAT 0% (reverse charge)", "0", "0.00")] and str(got["c"]["total"]) == "3.00"
    assert shown("d") == [("CGST 9%", "9", "0.01"), ("SGST 9%", "9", "0.01")] and str(got["d"]["tax_total"]) == "0.01"
    with pytest.raises(Exception, match="no scenario is named none"):
        invoices.taxed_lines(lines, queries.scenario_table(spark)).collect()
    assert invoices.invoice_taxes(invoices.taxed_lines(lines.limit(0), queries.scenario_table(spark))).count() == 0


# ---- files and published results


def test_manifests_over_files(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.pdf").write_text("x")
    (tmp_path / "files" / "empty.pdf").write_text("")
    (tmp_path / "m.json").write_text('[{"doc_id": "A",\n "variants": {"clean": ["a.pdf"], "scan": []}}, {"doc_id": "B", "variants": {"clean": ["empty.pdf", null, "gone.pdf"], "scan": [null]}}, {"doc_id": "C"}]', encoding="utf-8")
    listing = tables.list_files(spark, str(tmp_path / "files")).select(F.substring_index("path", "/", -1).alias("file"), "length")
    assert "content" not in plan(listing).split("ReadSchema")[-1]
    found = quality.check_manifest(tables.read_manifest(spark, str(tmp_path / "m.json")), listing, ["clean", "scan"])
    assert sorted(map(tuple, found.collect())) == [("A", "no files", "scan"), ("B", "file", "empty.pdf"), ("B", "file", "gone.pdf"), ("B", "no files", "scan"), ("C", "variants", "clean,scan")]
    hashes = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in quality.fingerprint(tables.read_files(spark, str(tmp_path / "files"))).collect()}
    assert hashes == {"a.pdf": hashlib.sha256(b"x").hexdigest()}


def test_files_are_written_by_all_tasks(spark, tmp_path):
    """A small table is one task; its files are made by many, and documents go into few files."""
    rows = spark.range(2500).coalesce(1).select("id", F.to_json(F.struct(F.col("id").cast("string").alias("doc_id"), F.lit("DE").alias("country")), {"pretty": "true"}).alias("value"))
    assert tables.spread(rows, "id").rdd.getNumPartitions() == tables.TASKS * spark.sparkContext.defaultParallelism
    tables.write_documents(rows, "id", str(tmp_path / "truth"))
    assert len(list((tmp_path / "truth").rglob("part-*"))) == 3
    assert sorted(int(r["doc_id"]) for r in tables.read_truth(spark, str(tmp_path / "truth")).filter("country = 'DE'").collect()) == list(range(2500))
    tables.write_files(rows.filter("id < 40"), "id", str(tmp_path / "files"))
    written = {f.parent.name: f.read_text() for f in (tmp_path / "files").rglob("part-*")}
    assert len(written) == 40 and '"39"' in written["id=39"]
    assert len({f.name.split("-")[1] for f in (tmp_path / "files").rglob("part-*")}) > 4


def test_a_failed_run_leaves_the_one_before(spark, tmp_path):
    results = Published(spark, str(tmp_path), "2026/1", "public")
    with pytest.raises(FileNotFoundError):
        results.header()
    rows = spark.createDataFrame([("t", 3)], "tool string, n_units long")
    assert results.publish({"summary": rows}, "invoices", "2026-01-31", "notes.md") == 1
    with pytest.raises(Exception, match="a tool failed"):
        results.publish({"summary": rows, "failures": rows.select(F.raise_error(F.lit("a tool failed")).alias("tool"))}, "invoices", "2026-02-28")
    (header,) = results.header().collect()
    assert (header["category"], header["dataset_version"], header["split"], header["generated_at"], header["methodology"], header["rows"]) == ("invoices", "2026/1", "public", "2026-01-31", "notes.md", {"summary": 1})
    assert results.read("summary", "tool string, n_units long").first()["n_units"] == 3
    assert results.publish({"summary": rows.limit(0)}, "invoices", "2026-03-31") == 3 and results.runs(finished=False) == [3]
    assert results.header().first()["rows"] == {"summary": 0}
    with pytest.raises(ValueError, match="unknown outputs: charts"):
        results.publish({"charts": rows}, "invoices", "2026-03-31")
