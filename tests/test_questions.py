from datetime import UTC, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.errors import SchemaIncompatibleError, ValidationError
from plumbline.model import FILTERS_BY_TYPE, Column
from plumbline.plans.spec import Dimension, Filter, Measure, OrderBy, QuerySpec, schema_issues, typed_value
from plumbline.plans.structured import (
    effective_limit,
    execute,
    query_page,
    result_columns,
    structured_query,
)

COUNT = Measure("count", "rows")


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(
        [
            (9, Decimal("12345678901234567890.12345"), "a", datetime(2024, 1, 1, 2, tzinfo=UTC)),
            (10, Decimal("0.00001"), "b", datetime(2024, 1, 15, tzinfo=UTC)),
            (100, None, None, None),
            (None, Decimal("1.00000"), "a", datetime(2024, 2, 1, 4, 59, tzinfo=UTC)),
        ],
        "qty long, amount decimal(38,5), label string, created timestamp",
    )


def values(frame):
    return [tuple(r) for r in frame.collect()]


def spec(dimensions=(), measures=(), filters=(), order=(), limit=None):
    return QuerySpec("d", dimensions, measures, filters, order, limit)


def test_month_is_local(facts):
    question = spec([Dimension("created", "month")], [COUNT], order=[OrderBy("dimension", "created")])
    rows = values(structured_query(facts, question, "America/New_York"))
    assert [(str(d), n) for d, n in rows] == [("2023-12-01", 1), ("2024-01-01", 2), ("None", 1)]


def test_decimals_keep_every_digit(facts):
    total = execute(facts, spec([], [Measure("sum", "total", "amount")], [Filter("label", "is_not_null")]))
    assert total.rows == ({"total": "12345678901234567891.12346"},)
    assert total.columns[0].type == "decimal"


def test_numbers_sort_as_numbers_and_nulls_as_documented(facts):
    by_qty = spec([Dimension("qty")], [], order=[OrderBy("dimension", "qty", "asc")])
    assert [r[0] for r in values(structured_query(facts, by_qty))] == [9, 10, 100, None]
    down = spec([Dimension("qty")], [], order=[OrderBy("dimension", "qty", "desc")])
    assert [r[0] for r in values(structured_query(facts, down))] == [None, 100, 10, 9]
    default = spec([Dimension("label")], [Measure("sum", "total", "qty")])
    assert [r[0] for r in values(structured_query(facts, default))] == [None, "b", "a"]


def test_integer_sums_do_not_overflow(spark):
    big = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,)], "n long")
    row = execute(big, spec([], [Measure("sum", "s", "n"), Measure("avg", "a", "n")])).rows[0]
    assert row == {"s": str(2**64 - 2), "a": f"{2**63 - 1}.0000000000"}


def test_average_is_exact(spark):
    frame = spark.createDataFrame([(1,), (1,), (2,)], "n long")
    assert execute(frame, spec([], [Measure("avg", "a", "n")])).rows[0]["a"] == "1.3333333333"


def test_nulls_never_match(facts):
    def kept(*conditions):
        return structured_query(facts, spec([Dimension("qty")], [], conditions)).count()

    assert kept(Filter("label", "neq", "a")) == 1
    assert kept(Filter("label", "eq", "a")) == 2
    assert kept(Filter("qty", "between", [9, 10])) == 2
    assert kept(Filter("qty", "in", [9, "100"])) == 2
    assert kept(Filter("amount", "gt", "12345678901234567890.12344")) == 1
    assert kept(Filter("amount", "lte", 1e30)) == 3
    assert kept(Filter("created", "gte", "2024-01-15T00:00:00Z"), Filter("label", "is_not_null")) == 2


def test_totals_over_nothing(facts):
    nothing = execute(facts, spec([], [COUNT, Measure("sum", "s", "amount")], [Filter("qty", "eq", -1)]))
    assert nothing.rows == ({"rows": "0", "s": None},)


def test_limits(spark):
    frame = spark.range(12).withColumnRenamed("id", "k")
    for limit, count, more in ((0, 0, True), (1, 1, True), (12, 12, False), (50, 12, False)):
        result = execute(frame, spec([Dimension("k")], [COUNT], limit=limit))
        assert (result.row_count, result.has_more, result.truncated) == (count, more, False)
    assert (effective_limit(None), effective_limit(0), effective_limit(10_000)) == (10_000, 0, 10_000)


def test_the_cap_truncates(spark):
    frame = spark.range(10_001).withColumnRenamed("id", "k")
    result = execute(frame, spec([Dimension("k")], []))
    assert (result.row_count, result.has_more, result.truncated) == (10_000, True, True)
    page = query_page(frame, spec([Dimension("k")], [])).agg(
        F.max("position"), F.bool_and("truncated"), F.max("k")
    )
    assert tuple(page.first()) == (10_000, True, 9_999)


def test_a_column_grouped_twice_is_named_by_its_last_grain(facts):
    twice = spec([Dimension("created", "day"), Dimension("created", "year")], [COUNT])
    frame = structured_query(facts, twice)
    assert frame.columns == ["created", "rows"] and frame.count() == 4


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.range(100).selectExpr(
        "id AS k", "CAST(id % 3 AS STRING) AS label", "id * 2 AS unused", "CAST(id AS DECIMAL(38,2)) AS amount"
    ).write.parquet(path)
    question = spec(
        [Dimension("label")], [Measure("sum", "s", "amount")], [Filter("label", "eq", "1"), Filter("amount", "gt", "5.5")]
    )
    frame = structured_query(spark.read.parquet(path), question, limit_rows=11)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,1)" in plan and "GreaterThan(amount,5.50)" in plan
    assert "unused" not in plan and "TakeOrderedAndProject" in plan


COLUMNS = [
    Column("c1", "label", "string"),
    Column("c2", "qty", "integer"),
    Column("c3", "amount", "decimal"),
    Column("c4", "ok", "boolean"),
    Column("c5", "day", "date"),
    Column("c6", "at", "timestamptz"),
    Column("c7", "Currency", "string"),
]


def test_every_mismatch_is_reported():
    question = spec(
        [Dimension("c1", "month"), Dimension("gone")],
        [Measure("sum", "s", "c1"), Measure("max", "m", "c4"), Measure("count", "n", "c4")],
        [Filter("c1", "gt", "a"), Filter("gone2", "eq", 1), Filter("c4", "in", [True])],
        [OrderBy("dimension", "c2"), OrderBy("measure", "x")],
    )
    found = [(i.code, i.ref) for i in schema_issues(question, COLUMNS)]
    assert found == [
        ("TYPE_INCOMPATIBLE", "c1"),
        ("COLUMN_REMOVED", "gone"),
        ("TYPE_INCOMPATIBLE", "c1"),
        ("TYPE_INCOMPATIBLE", "c4"),
        ("TYPE_INCOMPATIBLE", "c1"),
        ("COLUMN_REMOVED", "gone2"),
        ("TYPE_INCOMPATIBLE", "c4"),
        ("ORDER_BY_UNRESOLVED", "c2"),
        ("ORDER_BY_UNRESOLVED", "x"),
    ]
    assert {t: len(ops) for t, ops in FILTERS_BY_TYPE.items()} == {
        "string": 5, "integer": 10, "decimal": 10, "boolean": 4, "date": 10, "timestamptz": 10
    }


@pytest.mark.parametrize(
    "dimensions, filters, refused",
    [
        ([], [], True),
        ([Dimension("c7")], [], False),
        ([], [Filter("c7", "eq", "USD")], False),
        ([], [Filter("c7", "in", ["USD"])], False),
        ([], [Filter("c7", "in", ["USD", "EUR"])], True),
        ([], [Filter("c7", "neq", "USD")], True),
        ([Dimension("c1")], [], True),
    ],
)
def test_single_currency(dimensions, filters, refused):
    from plumbline.plans.spec import single_currency_refusal

    for aggregation in ("sum", "avg", "min", "max"):
        question = spec(dimensions, [Measure(aggregation, "v", "c3")], filters)
        assert (single_currency_refusal(question, COLUMNS) is not None) is refused
    for harmless in (COUNT, Measure("count", "n", "c3"), Measure("sum", "s", "c2")):
        assert single_currency_refusal(spec(dimensions, [harmless], filters), COLUMNS) is None


def test_refusals_come_from_running(facts):
    with pytest.raises(SchemaIncompatibleError, match="no longer exists"):
        structured_query(facts, spec([Dimension("gone")], []))
    with pytest.raises(ValidationError, match="pinning"):
        structured_query(facts.withColumn("currency", F.lit("USD")), spec([], [Measure("sum", "s", "amount")]))
    with pytest.raises(ValidationError):
        structured_query(facts, spec([Dimension("created", "day")], []), "EST")
    with pytest.raises(ValidationError):
        structured_query(facts, spec([Dimension("qty")], [], [Filter("qty", "eq", "abc")]))


@pytest.mark.parametrize(
    "raw, column_type",
    [("x", "integer"), (1.5, "integer"), (2**63, "integer"), (True, "integer"), ("", "decimal"),
     ("NaN", "decimal"), ("maybe", "boolean"), (1, "boolean"), ("2026-02-30", "date"), ("later", "timestamptz"), (5, "date")],
)
def test_filter_values_must_fit(raw, column_type):
    with pytest.raises(ValidationError):
        typed_value(raw, column_type)


def test_result_columns():
    question = spec(
        [Dimension("c6", "week"), Dimension("c1")],
        [Measure("avg", "a", "c2"), Measure("max", "m", "c5"), Measure("count_distinct", "n", "c1"), COUNT],
    )
    assert [(c.name, c.type) for c in result_columns(question, COLUMNS)] == [
        ("c6", "date"), ("c1", "string"), ("a", "decimal"), ("m", "date"), ("n", "integer"), ("rows", "integer")
    ]


def payload(**changes):
    base = {
        "version": 1,
        "datasetId": "d",
        "dimensions": [{"columnId": "c1"}],
        "measures": [{"field": None, "aggregation": "count", "alias": "rows"}],
        "filters": [],
    }
    return {**base, **changes}


def test_parsing():
    question = QuerySpec.from_dict(
        payload(
            dimensions=[{"columnId": "c6", "granularity": "week"}],
            filters=[
                {"columnId": "c1", "operator": "is_null"},
                {"columnId": "c2", "operator": "between", "value": [1, 2]},
                {"columnId": "c2", "operator": "in", "value": [1]},
            ],
            orderBy=[
                {"kind": "measure", "alias": "rows", "direction": "desc"},
                {"kind": "dimension", "columnId": "c6", "direction": "asc"},
            ],
            limit=0,
        )
    )
    assert question.limit == 0 and question.order_by[0] == OrderBy("measure", "rows", "desc")
    assert question.filters[1].value == (1, 2)


ONE = [{"columnId": "c1"}]


@pytest.mark.parametrize(
    "changes",
    [
        {"version": 2},
        {"version": "1"},
        {"datasetId": ""},
        {"extra": 1},
        {"dimensions": [], "measures": []},
        {"dimensions": ONE * 4},
        {"dimensions": [{"columnId": "c1", "granularity": "hour"}]},
        {"dimensions": [{"columnId": "c1", "name": "x"}]},
        {"measures": [{"field": None, "aggregation": "sum", "alias": "s"}]},
        {"measures": [{"field": "c1", "aggregation": "median", "alias": "s"}]},
        {"measures": [{"field": None, "aggregation": "count", "alias": "Rows"}]},
        {"measures": [{"field": None, "aggregation": "count", "alias": "a" * 31}]},
        {"measures": [{"field": None, "aggregation": "count", "alias": "c1"}]},
        {"measures": [{"field": None, "aggregation": "count", "alias": "a"}] * 2},
        {"measures": [{"field": "c1", "aggregation": "count", "alias": f"a{i}"} for i in range(6)]},
        {"filters": [{"columnId": "c1", "operator": "is_null"}] * 11},
        {"filters": [{"columnId": "c1", "operator": "is_null", "value": 1}]},
        {"filters": [{"columnId": "c1", "operator": "eq"}]},
        {"filters": [{"columnId": "c1", "operator": "like", "value": "x"}]},
        {"filters": [{"columnId": "c1", "operator": "between", "value": [1]}]},
        {"filters": [{"columnId": "c1", "operator": "in", "value": []}]},
        {"filters": [{"columnId": "c1", "operator": "eq", "value": None}]},
        {"filters": [{"columnId": "c1", "operator": "eq", "value": float("inf")}]},
        {"orderBy": [{"kind": "column", "columnId": "c1", "direction": "asc"}]},
        {"orderBy": [{"kind": "dimension", "columnId": "c1", "direction": "up"}]},
        {"limit": -1},
        {"limit": 10_001},
        {"limit": 1.5},
    ],
)
def test_bad_shapes_are_refused(changes):
    with pytest.raises(ValidationError):
        QuerySpec.from_dict(payload(**changes))


def test_averages_keep_six_places_more_than_their_column(spark):
    rows = [("0.000000000000123",), ("0.000000000000125",), (None,)]
    frame = spark.createDataFrame(rows, "v string").selectExpr("CAST(v AS DECIMAL(38,15)) AS v")
    spec = QuerySpec("d", [], [Measure("avg", "value", "v"), Measure("sum", "total", "v")])
    row = structured_query(frame, spec).first()
    assert (f"{row.value:f}", f"{row.total:f}") == ("0.000000000000124000000", "0.000000000000248")
    thirds = spark.createDataFrame([("1",), ("0",), ("1",)], "v string").selectExpr("CAST(v AS DECIMAL(38,5)) AS v")
    assert f"{structured_query(thirds, QuerySpec('d', [], [Measure('avg', 'value', 'v')])).first().value:f}" == "0.66666666667"
    none = structured_query(frame.where("v is null"), QuerySpec("d", [], [Measure("avg", "value", "v")])).first()
    assert none.value is None


@pytest.mark.parametrize(
    "operator, value, kept",
    [
        ("gt", "1e40", 0), ("lt", "1e40", 3), ("neq", "1e40", 3), ("eq", "1e40", 0), ("gte", "-1e40", 3),
        ("gt", "1.50000000000000000000000000000000000000001", 1), ("lte", "1.50000000000000000000000000000000000000001", 2),
        ("eq", "1.50000000000000000000000000000000000000001", 0), ("gte", "1.5", 2), ("lt", "1.4999999999999", 1),
        ("in", ["1e40", "1.5"], 1), ("in", ["1e40"], 0), ("between", ["-1e40", "1.50000000000000001"], 2),
    ],
)
def test_values_of_any_number_of_digits(spark, operator, value, kept):
    rows = [("-3",), ("1.5",), ("2",), (None,)]
    frame = spark.createDataFrame(rows, "v string").selectExpr("CAST(v AS DECIMAL(38,10)) AS v")
    spec = QuerySpec("d", [], [Measure("count", "rows")], [Filter("v", operator, value)])
    assert structured_query(frame, spec).first().rows == kept


def test_filters_and_columns_reach_the_scan_of_a_stored_version(spark, tmp_path):
    path = str(tmp_path / "typed")
    rows = [(i, f"p{i % 3}", f"{i}.25", "2026-01-02 03:04:05") for i in range(50)]
    typed = spark.createDataFrame(rows, "n long, plan string, amount string, at string").selectExpr(
        "n", "plan", "CAST(amount AS DECIMAL(38,10)) AS amount", "CAST(at AS TIMESTAMP) AS at"
    )
    typed.write.parquet(path)
    stored = spark.read.parquet(path)
    conditions = [
        Filter("amount", "gte", "10.5"), Filter("amount", "lt", "1e45"), Filter("plan", "in", ["p0", "p1"]),
        Filter("at", "between", ["2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z"]), Filter("n", "is_not_null", None),
    ]
    answer = structured_query(stored, QuerySpec("d", [Dimension("plan")], [Measure("count", "rows")], conditions))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = answer._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    for part in ("GreaterThanOrEqual(amount,", "In(plan,", "GreaterThanOrEqual(at,", "LessThanOrEqual(at,", "IsNotNull(n)"):
        assert part in pushed, pushed
    assert sum(r.rows for r in answer.collect()) == len([i for i in range(11, 50) if i % 3 < 2])
