import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.model import AGGREGATIONS_BY_TYPE, FILTERS_BY_TYPE
from plumbline.operators import audit, catalog, schema
from plumbline.operators.schema import broken_queries, references_of


@pytest.fixture(scope="module")
def tables(spark):
    datasets = spark.createDataFrame(
        [("o1", "d1", "Sales", 1, "v2"), ("o1", "d2", "Empty", 2, None), ("o2", "d3", "Other", 3, "v4")],
        "organization_id string, dataset_id string, dataset_name string, created_at int, current_version_id string",
    )
    versions = spark.createDataFrame(
        [("v1", "d1", 1, "COMPLETED", 5), ("v2", "d1", 2, "COMPLETED", 7), ("v3", "d1", 3, "FAILED", None),
         ("v4", "d3", 1, "COMPLETED", 100)],
        "version_id string, dataset_id string, version_number long, status string, row_count long",
    )
    return datasets, versions


def test_dataset_list(tables):
    rows = catalog.datasets_with_current_version(*tables).collect()
    assert [(r.dataset_id, r.version_number) for r in rows] == [("d3", 1), ("d2", None), ("d1", 2)]


def test_history(tables):
    rows = catalog.version_history(*tables).collect()
    assert [(r.version_id, r.is_current, r.is_superseded) for r in rows] == [
        ("v3", False, False), ("v2", True, False), ("v1", False, True), ("v4", True, False)
    ]


def test_next_numbers_and_totals(tables):
    numbers = {r.dataset_id: r.next_version_number for r in catalog.next_version_numbers(*tables).collect()}
    assert numbers == {"d1": 4, "d2": 1, "d3": 2}
    totals = {r.organization_id: tuple(r)[1:] for r in catalog.workspace_totals(*tables).collect()}
    assert totals == {"o1": (7, 1, 3), "o2": (100, 1, 1)}
    assert catalog.tenant_scope(tables[0], "o2").count() == 1


def test_latest_imports(spark):
    imports = spark.createDataFrame(
        [("i1", "d1", "FAILED", 1), ("i2", "d1", "COMPLETED", 2), ("i3", "d2", "COMPLETED", 1),
         ("i4", "d2", "FAILED", 2), ("i5", "d3", "CANCELLED", 1), ("i6", "d3", "CANCELLED", 1)],
        "import_id string, dataset_id string, status string, created_at int",
    )
    rows = {r.dataset_id: (r.import_id, r.is_open) for r in catalog.latest_imports(imports).collect()}
    assert rows == {"d1": ("i2", False), "d2": ("i4", True), "d3": ("i6", False)}
    plan = catalog.latest_imports(imports)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_admission(spark):
    requests = spark.createDataFrame(
        [(1, "a.csv", "d1", 5), (2, "a.csv", "d1", 3), (3, "a.csv", None, 1), (4, "b.csv", "d1", 9)],
        "import_id int, object_key string, dataset_id string, requested_at int",
    )
    rows = catalog.admit_imports(requests).collect()
    assert sorted((r.import_id, r.repeats) for r in rows) == [(2, 1), (3, 0), (4, 0)]
    earlier = requests.filter("import_id = 4").select(
        catalog.idempotency_key(F.col("object_key"), F.col("dataset_id")).alias("idempotency_key")
    )
    assert sorted(r.import_id for r in catalog.admit_imports(requests, earlier).collect()) == [2, 3]


def test_different_import_requests_have_different_keys(spark):
    parts = [("a", None), ("a", "new"), ("a", "\x1enew"), ("a\x1fb", "c"), ("a", "b\x1fc"), (None, "a"), ("", "a"), ("\x1e", "a"), ("a\x1e1b", "c"), (None, None)]
    requests = spark.createDataFrame([(i, *p, i) for i, p in enumerate(parts)], "import_id int, object_key string, dataset_id string, requested_at int")
    assert sorted(r.import_id for r in catalog.admit_imports(requests).collect()) == list(range(len(parts)))


def test_usage_and_widgets(spark, tables):
    queries = spark.createDataFrame(
        [("q1", "d1", "One", 1), ("q2", "d1", "Two", 2), ("q3", "gone", "Lost", 3)],
        "saved_query_id string, dataset_id string, saved_query_name string, updated_at int",
    )
    runs = spark.createDataFrame(
        [("q1", "failed"), ("q1", "success")], "saved_query_id string, status string"
    )
    usage = catalog.saved_query_usage(queries, tables[0], runs).collect()
    assert [(r.saved_query_id, r.dataset_name, r.runs, r.failed_runs) for r in usage] == [
        ("q2", "Sales", 0, 0), ("q1", "Sales", 2, 1)
    ]
    widgets = spark.createDataFrame(
        [("w1", "b", "q2", 1), ("w2", "b", "q1", 0)],
        "widget_id string, dashboard_id string, saved_query_id string, position int",
    )
    listed = catalog.widget_list(widgets, queries, *tables).collect()
    assert [(r.widget_id, r.version_number) for r in listed] == [("w2", 2), ("w1", 2)]


def columns(spark, version, **named):
    rows = [("d", version, i, n, t) for i, (n, t) in enumerate(named.items(), start=1)]
    return spark.createDataFrame(rows, "dataset_id string, version int, position int, name string, type string")


def test_continuity_and_diff(spark):
    first = columns(spark, 1, id="string", plan="string", amount="decimal", old="date")
    none = spark.createDataFrame([], "dataset_id string, name string, type string, column_id string")
    before = schema.column_continuity(first, none)
    second = columns(spark, 2, id="string", plan_name="string", amount="string", Plan="string")
    after = schema.column_continuity(second, before)
    old = {r.name: r.column_id for r in before.collect()}
    new = {r.name: r.column_id for r in after.collect()}
    assert new["id"] == old["id"]
    assert not {new["plan_name"], new["amount"], new["Plan"]} & set(old.values())
    states = {r.name: r.continuity for r in schema.schema_diff(second, first).collect()}
    assert states == {
        "id": "carried", "plan": "removed", "plan_name": "new", "amount": "revised", "old": "removed", "Plan": "new"
    }


def test_broken_queries(spark):
    current = spark.createDataFrame(
        [("d", "c1", "string"), ("d", "c2", "decimal"), ("d", "c3", "timestamptz")],
        "dataset_id string, column_id string, type string",
    )
    asked = [
        ("q1", "d", "c1", "dimension", None), ("q1", "d", "c1", "dimension", "month"),
        ("q2", "d", "c3", "dimension", "month"), ("q2", "d", "c1", "measure", "sum"),
        ("q2", "d", "c2", "measure", "sum"), ("q3", "d", "c1", "filter", "gt"),
        ("q3", "d", "c1", "filter", "eq"), ("q4", "d", "c9", "filter", "eq"), ("q5", "x", "c1", "measure", "count"),
    ]
    references = spark.createDataFrame(
        asked, "saved_query_id string, dataset_id string, column_id string, usage string, detail string"
    )
    rows = schema.broken_queries(references, current).collect()
    assert sorted((r.saved_query_id, r.usage, r.detail, r.issue_code) for r in rows) == [
        ("q1", "dimension", "month", "TYPE_INCOMPATIBLE"),
        ("q2", "measure", "sum", "TYPE_INCOMPATIBLE"),
        ("q3", "filter", "gt", "TYPE_INCOMPATIBLE"),
        ("q4", "filter", "eq", "COLUMN_REMOVED"),
        ("q5", "measure", "count", "COLUMN_REMOVED"),
    ]


def test_latency_by_brute_force(spark):
    rng = random.Random(3)
    rows = [
        (k, i, rng.choice([round(rng.uniform(0, 500), 3), 120.0, 0.004, 29_999.999]))
        for k, n in (("a", 1), ("b", 7), ("c", 180), (None, 1000))
        for i in range(n)
    ]
    frame = spark.createDataFrame(rows, "k string, at int, ms double")
    summary = audit.latency_summary(frame, "ms", ["at"], ["k"]).collect()
    assert {row.k for row in summary} == {"a", "b", "c", None}
    for row in summary:
        durations = [ms for k, _, ms in rows if k == row.k]
        ranked = sorted(durations)

        def hundredths(x):
            return int(x * 100 + 0.5) / 100

        def placed(p):
            return hundredths(ranked[min(len(ranked) - 1, int(p / 100 * len(ranked)))])

        assert tuple(row)[1:] == (
            len(ranked), hundredths(durations[0]), placed(50), placed(95), placed(0), placed(100)
        )
    whole = audit.latency_summary(frame, "ms", ["at"]).first()
    assert whole.runs == len(rows)


def test_counts_and_mode(spark):
    runs = spark.createDataFrame([("a", "failed"), ("a", "success"), ("b", "failed")], "q string, status string")
    assert audit.failed_count(runs).first().failed_count == 2
    values = spark.createDataFrame([("x",), ("y",), ("y",), ("x",), ("z",)], "c string")
    assert tuple(audit.modal_value(values, "c").first()) == ("x", 2)
    # Ten is more than nine, which a comparison of texts would deny.
    many = spark.createDataFrame([("x",)] * 10 + [("y",)] * 9, "c string")
    assert tuple(audit.modal_value(many, "c").first()) == ("x", 10)
    units = spark.createDataFrame([(1, "USD"), (1, "EUR"), (2, "USD"), (2, None)], "k int, unit string")
    assert [tuple(r) for r in schema.mixed_unit_groups(units, ["k"], "unit").collect()] == [(1, 2, 2)]


def test_a_hot_key_and_missing_references(spark):
    """A third of the rows under one key, a third under none: nothing may get lost."""
    rows = spark.range(9000).selectExpr(
        "id AS import_id",
        "CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN CAST(id AS STRING) END AS dataset_id",
        "'FAILED' AS status",
        "id % 100 AS created_at",
    )
    latest = catalog.latest_imports(rows)
    assert latest.count() == 3002
    best = max((i % 100, i) for i in range(0, 9000, 3))
    assert latest.filter("dataset_id = 'hot'").first().import_id == best[1]
    missing = max((i % 100, i) for i in range(2, 9000, 3))
    assert latest.filter("dataset_id IS NULL").first().import_id == missing[1]

    names = spark.range(9000).selectExpr("CAST(id AS STRING) AS dataset_id", "id AS n").union(
        spark.sql("SELECT 'hot', -1L")
    )
    joined = catalog.optional_lookup(rows, names, "dataset_id", "import_id")
    assert joined.count() == 9000 and set(joined.columns) == {*rows.columns, "n"}
    assert joined.filter("n = -1").count() == 3000 and joined.filter("n IS NULL").count() == 3000


def test_references_of_saved_questions(spark):
    spec = {
        "datasetId": "d",
        "dimensions": [{"columnId": "at", "granularity": "month"}, {"columnId": "gone"}],
        "measures": [{"field": None, "aggregation": "count", "alias": "n"}, {"field": "name", "aggregation": "sum", "alias": "s"}],
        "filters": [{"columnId": "name", "operator": "eq", "value": 1}],
        "orderBy": [{"kind": "measure", "ref": "n"}, {"kind": "measure", "ref": "other"}, {"kind": "dimension", "ref": "at"}],
    }
    saved = spark.createDataFrame([("q", json.dumps(spec)), ("empty", '{"datasetId":"d"}'), ("bad", "{"), ("null", None)], "saved_query_id string, spec string")
    references = references_of(saved)
    assert references.count() == 10
    columns = spark.createDataFrame([("d", "at", "timestamptz"), ("d", "name", "string")], "dataset_id string, column_id string, type string")
    found = {(r.column_id, r.usage, r.issue_code) for r in broken_queries(references, columns).collect()}
    assert found == {
        ("gone", "dimension", "COLUMN_REMOVED"),
        ("name", "measure", "TYPE_INCOMPATIBLE"),
        ("other", "order", "ORDER_BY_UNRESOLVED"),
        (None, "spec", "SPEC_UNREADABLE"),
    }


def test_questions_that_cannot_be_read_are_broken(spark):
    good = '{"datasetId": "d", "dimensions": [{"columnId": "a", "granularity": null}], "measures": [], "filters": []}'
    specs = {1: good, 2: None, 3: good[:-7], 4: "", 5: "[]", 6: "7", 7: "{}", 8: '{"datasetId": null}', 9: "no json", 10: '{"datasetId": "d", "dimensions": 4}'}
    saved = spark.createDataFrame(list(specs.items()), "saved_query_id long, spec string")
    columns = spark.createDataFrame([("d", "a", "string")], "dataset_id string, column_id string, type string")
    broken = broken_queries(references_of(saved), columns).collect()
    assert sorted(r.saved_query_id for r in broken) == list(range(2, 11))
    assert {(r.dataset_id, r.column_id, r.usage, r.issue_code) for r in broken} == {(None, None, "spec", "SPEC_UNREADABLE")}


ODD_IDS = [
    "", "a", "é" * 16, "x" * 31, "x" * 32, "x" * 33, "x" * 31 + "\0", "x" * 32 + "\0", "0" * 32, "0" * 64, "ab" * 32, "AB" * 32,
    "ab" * 31 + "a\n", "ab" * 31 + "g0", "é" * 64, "ab" * 33, "\0" * 32, "\0" * 33, None,
]


def test_ids_of_any_form_are_told_apart(spark):
    short, long = schema._id_forms(*[spark.createDataFrame([], "column_id string")] * 2)
    ids = spark.createDataFrame([(i,) for i in ODD_IDS], "column_id string").withColumn("short", short(F.col("column_id")))
    rows = ids.withColumn("again", long(F.col("short"))).collect()
    assert all(r.column_id == r.again for r in rows)
    assert len({r.short and bytes(r.short) for r in rows}) == len(ODD_IDS)
    assert {len(r.short) for r in rows if r.column_id in ("0" * 64, "ab" * 32)} == {32}


@pytest.mark.parametrize("numbered", [False, True])
def test_broken_queries_by_brute_force(spark, numbered):
    """Repeated and missing ids on either side; ids that are numbers are compared as they are."""
    known = list(range(len(ODD_IDS) - 1)) if numbered else ODD_IDS[:-1]
    kind = "long" if numbered else "string"
    columns = [(d, i, t) for d in ("d", None) for i, t in zip([*known[::2], None, known[0]], ["string", "decimal", "timestamptz"] * 9)]
    asks = [("dimension", None), ("dimension", "month"), ("measure", "sum"), ("measure", "count"), ("measure", None), ("filter", "gt"),
            ("order", None), ("order", "unresolved"), ("spec", None), (None, None)]
    references = [(n % 7, d, i, u, a) for n, (d, i, (u, a)) in enumerate((d, i, x) for d in ("d", "e", None) for i in [*known, None] for x in asks)] * 2

    def judged(d, i, u, a):
        if (u, a, i) == ("measure", "count", None) or u == "order" and a != "unresolved":
            return
        for t in [t for e, j, t in columns if e == d and j == i and None not in (d, i)] or [None]:
            if u in ("spec", "order"):
                yield "SPEC_UNREADABLE" if u == "spec" else "ORDER_BY_UNRESOLVED"
            elif t is None:
                yield "COLUMN_REMOVED"
            elif u == "dimension" and a and t != "timestamptz" or u == "measure" and a not in AGGREGATIONS_BY_TYPE[t]:
                yield "TYPE_INCOMPATIBLE"
            elif u in ("filter", None) and a not in FILTERS_BY_TYPE[t]:
                yield "TYPE_INCOMPATIBLE"

    frames = (
        spark.createDataFrame(references, f"saved_query_id long, dataset_id string, column_id {kind}, usage string, detail string"),
        spark.createDataFrame(columns, f"dataset_id string, column_id {kind}, type string"),
    )
    found = broken_queries(*frames)
    assert found.columns == ["saved_query_id", "dataset_id", "column_id", "usage", "detail", "issue_code"]
    assert dict(found.dtypes)["column_id"] == frames[0].schema["column_id"].dataType.simpleString()
    expected = [(*r, code) for r in references for code in judged(*r[1:])]
    assert Counter(tuple(r) for r in found.collect()) == Counter(expected)


def test_every_reference_is_moved_once(spark):
    references = spark.range(10).selectExpr("id AS saved_query_id", "'d' AS dataset_id", "sha2(CAST(id AS STRING), 256) AS column_id", "'filter' AS usage", "'eq' AS detail")
    columns = references.selectExpr("dataset_id", "column_id", "'string' AS type")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = broken_queries(references, columns)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = re.findall(r"Exchange hashpartitioning\((.*)", plan)
    assert len(dealt) == 2 and all("_share" in keys for keys in dealt)
