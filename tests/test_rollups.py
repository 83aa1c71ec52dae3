"""Questions answered from stored totals must equal those answered from the rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from fixtures import transactions, write_csv
from plumbline.model import columns_of
from plumbline.plans import report
from plumbline.plans.importing import load_import, profile_import
from plumbline.plans.report import SavedQuery, run_stored_query, store_resolver
from plumbline.plans.rollups import Rollup, cheapest, covers, definition_of, rolled_query, rolled_up
from plumbline.plans.spec import Dimension, Filter, Measure, QuerySpec
from plumbline.plans.structured import structured_query
from plumbline.sources.versions import VersionStore

ZONE = "America/New_York"
MEASURES = [
    Measure("count", "n"), Measure("sum", "s", "amount"), Measure("avg", "a", "amount"), Measure("min", "lo", "amount"),
    Measure("max", "hi", "qty"), Measure("count", "c", "qty"), Measure("sum", "q", "qty"),
]


@pytest.fixture(scope="module")
def facts(spark):
    return spark.range(3000).select(
        (F.timestamp_seconds(F.col("id") * 40_000 + 1_000_000_000)).alias("at"),
        F.expr("CASE WHEN id % 11 <> 0 THEN 'k' || id % 4 END").alias("kind"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'EUR' ELSE 'USD' END").alias("currency"),
        F.expr("CASE WHEN id % 7 <> 0 THEN CAST(id AS DECIMAL(18,2)) / 7 END").cast("decimal(18,2)").alias("amount"),
        F.expr("CASE WHEN id % 5 <> 0 THEN id END").alias("qty"),
    )


ROLLUP = Rollup("at", ("currency", "kind"), ("amount", "qty"), ZONE)


def test_every_covered_question_has_the_same_answer(spark, facts, tmp_path):
    rolled_up(facts, ROLLUP).write.parquet(f"{tmp_path}/r")
    rolled = spark.read.parquet(f"{tmp_path}/r")
    assert definition_of(rolled) == ROLLUP
    dimensions = [[], [Dimension("at", "month")], [Dimension("at", "quarter"), Dimension("kind")], [Dimension("kind"), Dimension("at", "year")], [Dimension("currency")]]
    filters = [[Filter("currency", "eq", "USD")], [Filter("currency", "eq", "?")], [Filter("currency", "in", ["EUR"]), Filter("kind", "neq", "k1")], [Filter("currency", "eq", "EUR"), Filter("kind", "is_null")]]
    for chosen, conditions, measures in itertools.product(dimensions, filters, (MEASURES[:4], MEASURES[4:])):
        spec = QuerySpec("d", chosen, measures, conditions)
        assert covers(ROLLUP, spec, ZONE, columns_of(facts.schema))
        slow, fast = structured_query(facts, spec, ZONE), rolled_query(rolled, facts, spec, ZONE)
        assert fast.dtypes == slow.dtypes
        assert fast.collect() == slow.collect(), spec
    empty = rolled_up(facts.limit(0), ROLLUP)
    assert rolled_query(empty, facts, QuerySpec("d", [], MEASURES[:1]), ZONE).first().n == 0


def test_other_questions_go_to_the_rows(facts):
    columns = columns_of(facts.schema)
    count = [Measure("count", "n")]
    refused = [
        (QuerySpec("d", [Dimension("at", "day")], count), ZONE),
        (QuerySpec("d", [Dimension("at", "month")], count), "UTC"),
        (QuerySpec("d", [Dimension("at")], count), ZONE),
        (QuerySpec("d", [Dimension("kind")], [Measure("count_distinct", "n", "qty")]), ZONE),
        (QuerySpec("d", [Dimension("kind")], count, [Filter("qty", "gt", 5)]), ZONE),
        (QuerySpec("d", [Dimension("kind")], count, [Filter("at", "gte", "2020-01-01")]), ZONE),
        (QuerySpec("d", [Dimension("kind")], []), ZONE),
    ]
    assert not any(covers(ROLLUP, spec, zone, columns) for spec, zone in refused)
    with pytest.raises(ValueError, match="needs an instant"):
        rolled_up(facts, Rollup("kind", (), ("amount",), ZONE))


def test_a_stored_version_answers_from_its_rollup(spark, tmp_path, monkeypatch):
    store = VersionStore(spark, str(tmp_path / "store"))
    proposed = profile_import(spark, write_csv(tmp_path / "t.csv", transactions()))
    made = [Rollup("created_at", ("currency",), ("amount",), ZONE), Rollup("created_at", ("currency", "plan"), ("amount",), ZONE)]
    names = set(proposed.scan.names)
    made = [r for r in made if {r.date, *r.keys, *r.fields} <= names]
    assert made
    load_import(store, proposed, "d", ZONE, rollups=made)
    ids = {f.name: f.metadata["column_id"] for f in store.read_version("d").schema}
    spec = QuerySpec("d", [Dimension(ids["created_at"], "month")], [Measure("sum", "value", ids["amount"]), Measure("count", "rows")], [Filter(ids["currency"], "eq", "USD")])
    dataset = store_resolver(store)("d")
    chosen = cheapest(dataset.rollups, spec, ZONE, dataset.columns)
    assert definition_of(chosen) == made[0]
    fast = run_stored_query(SavedQuery("q", "Monthly", spec), store, ZONE)
    plan = rolled_query(chosen, dataset.frame, spec, ZONE, dataset.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "_sum_amount" in plan and "_row_number" not in plan and "_issues" not in plan
    monkeypatch.setattr(report, "cheapest", lambda *_: None)
    slow = run_stored_query(SavedQuery("q", "Monthly", spec), store, ZONE)
    assert fast.rows == slow.rows and fast.rows and fast.columns == slow.columns
