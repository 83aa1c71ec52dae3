import pytest
from pyspark.sql import functions as F

from plumbline.functions import grammar


def judged(spark, values, check):
    frame = spark.createDataFrame([(v,) for v in values], "cell string")
    return {row.cell: row.answer for row in frame.select("cell", check(F.col("cell")).alias("answer")).collect()}


CASES = {
    grammar.is_integer: (
        ["58", "-6", "0", "-0", " 7 ", " 7﻿", "9223372036854775807", "-9223372036854775808"],
        ["", "0061", "3.0", "4,000", "+5", "2e7", "9223372036854775808", "6 1", "٣", "12x", None],
    ),
    grammar.is_decimal: (
        ["8731.25", "2,345.67", "98,765.00", "0.25", "-0.75", "31", "98765432109876543210.54321"],
        ["€2,345.67", "0004321", "2,34.5", "23,45", ".7", "7.", "2e7", "none", "", None],
    ),
    grammar.is_boolean: (
        ["true", "FALSE", "Yes", " no "],
        ["1", "0", "y", "n", "t", "on", "", None],
    ),
    grammar.is_date: (
        ["2026-01-15", " 2024-02-29 ", "0100-01-01"],
        ["2026-02-30", "2023-02-29", "2026-1-5", "0099-01-01", "2026-01-15T00:00:00", "", None],
    ),
}


@pytest.mark.parametrize("check", CASES, ids=lambda c: c.__name__)
def test_predicates(spark, check):
    accepted, refused = CASES[check]
    answers = judged(spark, accepted + refused, check)
    assert [v for v in accepted if not answers[v]] == []
    assert [v for v in refused if answers[v]] == []


def test_a_final_newline_is_only_white_space(spark):
    answers = judged(spark, ["12\n", "12\n3"], grammar.is_integer)
    assert answers == {"12\n": True, "12\n3": False}


def test_datetime_kind(spark):
    answers = judged(
        spark,
        [
            "2026-09-01T09:15:00Z",
            "2026-09-01 09:15:00",
            "2026-09-01T09:15:00.123Z",
            "  2026-09-01 09:15:00.5  ",
            "2026-09-01T09:15:00-04:00",
            "2026-09-01T09:15:00+23:59",
            "0099-01-01T00:00:00Z",
            "2026-09-01T25:00:00Z",
            "2026-09-01T09:60:00Z",
            "2026-09-01T09:15:60Z",
            "2026-02-30 09:15:00",
            "2026-09-01T09:15:00+24:00",
            "2026-09-01 09:15",
            "not a datetime",
        ],
        grammar.datetime_kind,
    )
    assert list(answers.values()) == ["explicit", "naive", "explicit", "naive"] + ["explicit"] * 2 + [None] * 8
