"""Steps that several queries share do their work once."""

from pathlib import Path

import pytest

from gaugemill.operators import metrics, scoring
from gaugemill.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def dealt(df) -> int:
    """Exchanges of documents' orders and lines that ran, without those used again."""
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len([x for x in final.splitlines() if "REPARTITION_BY_NUM" in x and "ReusedExchange" not in x])


def test_truth_and_answers_share_their_exchanges(spark):
    assert dealt(Q.answered(spark, SF).drop("variant")) == 2  # orders, lines
    assert dealt(Q.answered(spark, SF)) == 3  # one side's orders bring their variant
    assert Q.answered(spark, SF).filter("doc_id % 97 = 3").isEmpty()


def test_units_that_carry_dimensions_are_cut_without_a_join(spark):
    own = metrics.summarize_own_slices(Q.stored_units(spark, SF, ("region", "variant")), ("region", "variant"))
    joined = metrics.summarize_slices(Q.stored_units(spark, SF).drop("variant"), metrics.dimension_coords(Q.docs(spark, SF), ("region", "variant")))
    order = ["tool", "dimension", "value"]
    assert own.orderBy(*order).collect() == joined.orderBy(*order).collect() and own.count() == 30


@pytest.mark.parametrize("name", ["o05_published_results", "o05_write_results"])
def test_results_compare_fields_once(spark, monkeypatch, name):
    """Units and failures of a run come from one scoring, with the outcomes of the long comparators."""
    u, p = Q.scored_once(spark, SF)
    long = Q.pairs(spark, SF)
    assert p.columns == long.columns and p.exceptAll(long).isEmpty() and long.exceptAll(p).isEmpty()
    assert u.exceptAll(Q.units(spark, SF)).isEmpty()
    calls, inner = [], Q.answered
    monkeypatch.setattr(Q, "answered", lambda *a, **k: calls.append(a) or inner(*a, **k))
    assert Q.QUERIES[name](spark, SF).count() == 3
    assert len(calls) == 1


def test_results_take_little_disk(spark, monkeypatch, tmp_path):
    """Lines are compressed, slices move no unit, and every output is what it was: units, failures, summary and slices."""
    monkeypatch.setattr(Q, "scratch", lambda _, name: f"{tmp_path}/{name}")
    joins = []
    monkeypatch.setattr(metrics, "summarize_slices", lambda *a, **k: joins.append(a))
    assert Q.QUERIES["o05_write_results"](spark, SF).count() == 3 and not joins
    monkeypatch.undo()
    folder = f"{tmp_path}/results/2026.1/public"
    u = Q.units(spark, SF)
    own = spark.read.schema(u.schema).json(f"{folder}/per_doc")
    assert own.exceptAll(u).isEmpty() and u.exceptAll(own).isEmpty()
    f = scoring.failures(Q.pairs(spark, SF))
    own = spark.read.schema(f.schema).json(f"{folder}/failures")
    assert own.exceptAll(f).isEmpty() and f.exceptAll(own).isEmpty()
    cut = Q.slices(spark, SF)
    order = ["tool", "dimension", "value"]
    assert spark.read.schema(cut.schema).json(f"{folder}/by_dimension").orderBy(*order).collect() == cut.orderBy(*order).collect()
    assert set(spark.read.json(f"{folder}/per_doc").columns) == set(u.columns)
    own.coalesce(1).write.json(f"{tmp_path}/plain")
    size = lambda path: sum(x.stat().st_size for x in Path(path).rglob("part-*"))
    assert size(f"{folder}/failures") < size(f"{tmp_path}/plain") / 5
