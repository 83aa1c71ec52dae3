from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.errors import SchemaIncompatibleError
from plumbline.operators.charts import (
    bar_series,
    chart_spec,
    peak_row,
    ranked_by_measure,
    top_categories,
)
from plumbline.plans.report import (
    Dataset,
    SavedQuery,
    Widget,
    executions_frame,
    report_audit,
    report_pack,
    run_report,
    run_saved_query,
)
from plumbline.plans.spec import Dimension, Filter, Measure, OrderBy, QuerySpec
from plumbline.plans.structured import execute, limited_page, query_page

COUNT = Measure("count", "rows")


def grouped(spark, rows):
    return spark.createDataFrame(rows, "k long, value long, rows long")


def test_wording_of_what_is_left_out(spark):
    order = [F.col("value").desc_nulls_first(), F.col("k").asc()]
    many = grouped(spark, [(i, i, 1) for i in range(10_100)])
    for page, verb, total, dropped in (
        (limited_page(many, None, order, None), "top", "10,100", 10_050),
        (limited_page(many, None, order), "first", "10,000+", 9_950),
    ):
        shown = top_categories(page, verb == "top").orderBy("position").collect()
        assert [r.k for r in shown] == list(range(10_099, 10_049, -1))
        assert {(r.note, r.dropped_count) for r in shown} == {(f"Showing {verb} 50 of {total}", dropped)}
    few = top_categories(limited_page(many.limit(50), None, order, None), True).collect()
    assert {(r.note, r.dropped_count) for r in few} == {(None, 0)}


def test_the_peak_is_found_behind_ten_thousand_groups_without_value(spark):
    rows = [(i, None if i < 11_000 else i, 1) for i in range(12_000)]
    order = [F.col("value").desc_nulls_first(), F.col("k").asc()]
    page = limited_page(grouped(spark, rows), None, order, None)
    best = peak_row(bar_series(page, "k")).collect()
    assert [(r.label, r.value, r.position) for r in best] == [("11999", 11_999, 11_001)]
    assert page.agg(F.min("position"), F.max("position"), F.count_distinct("position")).first()[:] == (1, 12_000, 12_000)
    assert peak_row(bar_series(limited_page(grouped(spark, []), None, order, None), "k")).count() == 0


def test_only_a_descending_order_of_the_charted_measure_is_top():
    def spec(order):
        return QuerySpec("d", [Dimension("k")], [Measure("sum", "value", "v"), COUNT], order_by=order)

    assert ranked_by_measure(spec([]), "value") and not ranked_by_measure(spec([]), "rows")
    assert ranked_by_measure(spec([OrderBy("measure", "value", "desc")]), "value")
    assert not ranked_by_measure(spec([OrderBy("measure", "value", "asc")]), "value")
    assert not ranked_by_measure(spec([OrderBy("dimension", "k", "desc")]), "value")


def test_bars(spark):
    frame = spark.createDataFrame(
        [("a", Decimal(5)), ("b", Decimal(5)), (None, None), ("c", Decimal(1))], "k string, v decimal(10,2)"
    )
    spec = chart_spec("d", Dimension("k"), Measure("sum", "ignored", "v"))
    page = query_page(frame, spec)
    series = bar_series(page, "k")
    assert [(r.label, str(r.value), r.row_count) for r in series.orderBy("position").collect()] == [
        ("—", "0.00", 1), ("a", "5.00", 1), ("b", "5.00", 1), ("c", "1.00", 1)
    ]
    assert peak_row(series).first().label == "a"
    top = top_categories(page, ranked_by_measure(spec, "value"))
    assert {(r.dropped_count, r.note) for r in top.collect()} == {(0, None)}


def test_top_of_many(spark):
    page = query_page(
        spark.range(10_050).withColumnRenamed("id", "k"), chart_spec("d", Dimension("k"), Measure("max", "x", "k"))
    )
    rows = top_categories(page, True).orderBy("position").collect()
    assert len(rows) == 50 and rows[0].k == 10_049
    assert rows[0].note == "Showing top 50 of 10,000+" and rows[0].dropped_count == 9_950


@pytest.fixture
def dashboard(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v long")
    datasets = {"d": Dataset(frame, 4), "new": Dataset(None)}

    def widget(position, name, dataset, *dimensions):
        spec = QuerySpec(dataset, [Dimension(d) for d in dimensions], [COUNT])
        return Widget(position, SavedQuery(f"q-{name}", name, spec))

    widgets = [widget(2, "Broken", "d", "gone"), widget(0, "Good", "d", "k"), widget(1, "Empty", "new")]
    return widgets, datasets.get


def test_each_widget_fails_alone(spark, dashboard):
    widgets, resolve = dashboard
    log = []
    outcomes = run_report(widgets, resolve, "UTC", log)
    assert [(o.widget.query.name, o.code) for o in outcomes] == [
        ("Good", None), ("Empty", "SCHEMA_INCOMPATIBLE"), ("Broken", "SCHEMA_INCOMPATIBLE")
    ]
    assert outcomes[0].result.rows == ({"k": "a", "rows": "2"}, {"k": None, "rows": "1"})
    assert "no current version" in outcomes[1].message
    # What never resolved to a version leaves no audit row.
    rows = executions_frame(spark, log).orderBy("status").collect()
    assert [(r.saved_query_id, r.dataset_version, r.status, r.row_count, r.error_code) for r in rows] == [
        ("q-Broken", 4, "failed", None, "SCHEMA_INCOMPATIBLE"), ("q-Good", 4, "success", 2, None)
    ]
    with pytest.raises(SchemaIncompatibleError):
        run_saved_query(widgets[0].query, resolve, "UTC")


def test_pack_and_audit(spark, dashboard):
    widgets, resolve = dashboard
    pack = report_pack(spark, widgets, resolve, "UTC")
    rows = pack.orderBy("widget_position", "row_position").collect()
    assert [(r.widget, r.row_position, r.label, r.value, r.error_code) for r in rows] == [
        ("Good", 1, "a", "2", None),
        ("Good", 2, "—", "1", None),
        ("Empty", None, None, None, "SCHEMA_INCOMPATIBLE"),
        ("Broken", None, None, None, "SCHEMA_INCOMPATIBLE"),
    ]
    versions = spark.createDataFrame([("Good", 4), ("Broken", 4)], "widget string, dataset_version long")
    audited = {r.widget: (r.dataset_version, r.status, r.row_count) for r in report_audit(pack, versions, "UTC").collect()}
    assert audited == {"Good": (4, "success", 2), "Broken": (4, "failed", None), "Empty": (None, "failed", None)}
    assert pack.filter(F.col("error_code").isNull()).count() == 2


def test_widgets_of_one_dataset_share_a_scan(spark, tmp_path):
    frame = spark.range(4000).select(
        F.expr("CASE WHEN id % 9 <> 0 THEN 'k' || id % 7 END").alias("kind"), F.timestamp_seconds(F.col("id") * 50_000).alias("at"),
        F.expr("CASE WHEN id % 5 <> 0 THEN id END").alias("qty"), (F.col("id") % 100).cast("decimal(18,2)").alias("amount"),
    )
    frame.write.parquet(f"{tmp_path}/d")
    frame = spark.read.parquet(f"{tmp_path}/d")
    d, m = Dimension, Measure
    specs = [
        QuerySpec("d", [d("kind")], [m("sum", "s", "amount"), m("count", "n")]),
        QuerySpec("d", [d("at", "year"), d("kind")], [m("avg", "a", "qty")], [Filter("qty", "gt", 50)]),
        QuerySpec("d", [], [m("count_distinct", "c", "kind")], [Filter("kind", "eq", "k1")]),
        QuerySpec("d", [], [m("count", "n")], [Filter("kind", "eq", "nothing")]),
        QuerySpec("d", [], [m("max", "x", "amount")], [Filter("kind", "eq", "nothing")]),
        QuerySpec("d", [d("kind")], []),
        QuerySpec("d", [d("at", "month")], [m("min", "lo", "at"), m("count", "n", "qty")], order_by=[OrderBy("measure", "n", "asc"), OrderBy("dimension", "at", "desc")], limit=7),
        QuerySpec("d", [d("at", "year"), d("at", "month")], [m("count", "n")], [Filter("amount", "lt", 3)]),
    ]
    widgets = [Widget(10 * i, SavedQuery(f"q{i}", f"W{i}", s)) for i, s in enumerate(specs)]
    pack = report_pack(spark, widgets, lambda _: Dataset(frame, 1), "Europe/London")
    got = {}
    for r in pack.collect():
        got.setdefault(r.widget_position, []).append((r.row_position, r.label, r.value))
    for w in widgets:
        outcome = execute(frame, w.query.spec, "Europe/London")
        names = list(dict.fromkeys(x.column_id for x in w.query.spec.dimensions))
        value = w.query.spec.measures[0].alias if w.query.spec.measures else None
        rows = [(i, " / ".join("—" if r[n] is None else r[n] for n in names), r[value] if value else None) for i, r in enumerate(outcome.rows, 1)]
        assert got[w.position] == rows, w.query.spec
