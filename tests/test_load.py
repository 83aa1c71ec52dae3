from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.errors import ValidationError
from plumbline.functions.casting import CellType
from plumbline.operators.load import import_errors, issue_counts, load_summary, typed_load, typed_rows
from plumbline.operators.profile import column_profile, confirm_schema, infer_schema

CELLS = [
    CellType("name", "string"),
    CellType("n", "integer"),
    CellType("amount", "decimal"),
    CellType("flag", "boolean"),
    CellType("day", "date"),
    CellType("at", "timestamptz"),
]
ROWS = [
    (1, 6, " Ada ", "42", "1,234.56", "YES", "2026-01-15", "2026-09-01T09:15:00-04:00"),
    (2, 6, "", "", "", "", "", ""),
    (3, 6, None, None, None, None, None, None),
    (4, 5, "x", "12345678901234567890", "$5", "1", "2026-02-30", "2026-03-08 02:30:00"),
    (5, 6, "a\x00b", "1\x00", "1", "no", "2026-01-15", "2026-11-01 01:30:00"),
    (6, 6, "x", " 7 ", "0.12345678901", "no", "2026-01-15", "never"),
]


@pytest.fixture
def loaded(spark):
    raw = spark.createDataFrame(
        ROWS,
        "row_no long, fields long, name string, n string, amount string, flag string, day string, at string",
    )
    return typed_load(raw, CELLS, "America/New_York", F.col("row_no"), F.col("fields"))


def test_values(loaded):
    rows = {r.row_no: r for r in typed_rows(loaded).collect()}
    first = rows[1]
    assert (first.name, first.n, first.amount, first.flag) == (" Ada ", 42, Decimal("1234.56"), True)
    assert (str(first.day), str(first["at"])) == ("2026-01-15", "2026-09-01 13:15:00")
    for empty in (2, 3):
        assert list(rows[empty])[2:] == [None] * 6
    assert list(rows[4])[2:7] == ["x", None, None, None, None]
    assert str(rows[4]["at"]) == "2026-03-08 07:30:00"
    assert (rows[5].name, rows[5].n, rows[5].flag) == (None, None, False)
    assert str(rows[5]["at"]) == "2026-11-01 05:30:00"
    # A value that would have to be rounded is refused, not altered.
    assert (rows[6].n, rows[6].amount) == (7, None)


def test_issues(loaded):
    errors = [tuple(r) for r in import_errors(loaded).orderBy("row_number").collect()]
    assert [e[:3] for e in errors if e[0] == 4] == [
        (4, None, "FIELD_COUNT_MISMATCH"),
        (4, "n", "UNPARSEABLE_VALUE"),
        (4, "amount", "UNPARSEABLE_VALUE"),
        (4, "flag", "UNPARSEABLE_VALUE"),
        (4, "day", "UNPARSEABLE_VALUE"),
        (4, "at", "NONEXISTENT_LOCAL_TIME"),
    ]
    assert [e[:3] for e in errors if e[0] == 5] == [
        (5, "name", "ENCODING"),
        (5, "n", "ENCODING"),
        (5, "at", "AMBIGUOUS_LOCAL_TIME"),
    ]
    assert {e[0] for e in errors} == {4, 5, 6}
    messages = {(e[0], e[1]): e[3] for e in errors}
    assert messages[(4, None)] == "Row has 5 fields, expected 6."
    assert messages[(4, "n")] == 'Value in column "n" could not be parsed as integer.'
    assert "resolved to the earlier instant" in messages[(5, "at")]
    assert not any("$5" in e[3] for e in errors)


def test_summary_and_counts(loaded):
    summary = load_summary(loaded.drop("row_no", "fields")).first()
    assert (summary.rows_imported, summary.rows_rejected) == (6, 3)
    assert summary.nullable_columns == [c.name for c in CELLS]
    counts = {r.error_code: r.issue_count for r in issue_counts(import_errors(loaded)).collect()}
    assert counts == {
        "FIELD_COUNT_MISMATCH": 1,
        "UNPARSEABLE_VALUE": 6,
        "NONEXISTENT_LOCAL_TIME": 1,
        "AMBIGUOUS_LOCAL_TIME": 1,
        "ENCODING": 2,
    }


def test_a_filter_is_not_copied_into_the_parsing(loaded):
    plan = loaded.filter("amount > 5 AND at IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") < 12


def test_no_columns_is_refused(spark):
    with pytest.raises(ValidationError):
        typed_load(spark.range(1), [], "UTC")


def inferred(spark, values, name="c"):
    cells = spark.createDataFrame([(v,) for v in values], f"{name} string")
    return infer_schema(column_profile(cells)).first()


@pytest.mark.parametrize(
    "values, expected",
    [
        (["42", "100", "7", "-3"], "integer"),
        (["100"] * 96 + ["99.99"] * 4, "decimal"),
        (["0", "1", "0"], "integer"),
        (["0001234", "0005678"], "string"),
        (["1,234.56", "999.00"], "decimal"),
        (["$1.00", "$2.00"], "string"),
        (["true", "NO", "yes"], "boolean"),
        (["2026-01-15", "2026-12-31"], "date"),
        (["2026-01-15 10:00:00", "2026-01-15T10:00:00Z"], "timestamptz"),
        (["12345678901234567890"] * 5, "decimal"),
        (["", "", None], "string"),
        (["10.00"] * 19 + ["N/A"], "decimal"),
        (["10.00"] * 18 + ["N/A"], "string"),
        (["10.00"] * 19 + ["N/A"] + [""] * 50, "decimal"),
    ],
)
def test_inferred_type(spark, values, expected):
    assert inferred(spark, values).type == expected


def test_proposed_schema_details(spark):
    row = inferred(spark, ["2026-01-15 10:00:00", "2026-01-15T10:00:00Z"] * 10 + ["?", ""])
    assert (row.nullable, row.unparseable_count, row.datetime_offset) == (True, 1, "mixed")
    assert inferred(spark, ["   ", "x"]).nullable is False
    assert inferred(spark, ["1.5", "2.123456789012"]).decimal_scale == 12


def test_an_empty_frame_still_describes_every_column(spark):
    cells = spark.createDataFrame([], "id string, `odd name.x` string")
    rows = infer_schema(column_profile(cells)).collect()
    assert [(r.position, r.name, r.type, r.nullable) for r in rows] == [
        (1, "id", "string", False),
        (2, "odd name.x", "string", False),
    ]


def test_confirming(spark):
    cells = spark.createDataFrame([("1", "2.123456789012")], "id string, x string")
    proposed = infer_schema(column_profile(cells))
    assert confirm_schema(proposed, {1: "string"}) == [CellType("id", "string"), CellType("x", "decimal", 12)]
    with pytest.raises(ValidationError, match="unknown position 3"):
        confirm_schema(proposed, {3: "string"})
    with pytest.raises(ValidationError):
        confirm_schema(proposed, {1: "datetime"})
