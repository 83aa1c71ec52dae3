"""What is in each text column, and the type it should therefore have."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.casting import CellType
from ..functions.grammar import (
    INTEGER_PATTERN,
    boolean_text,
    date_text,
    datetime_text,
    decimal_text,
    fits_bigint,
    has_offset,
    trimmed,
)
from ..model import BOOLEAN, COLUMN_TYPES, DATE, DECIMAL, INTEGER, STRING, TIMESTAMPTZ

# A type is taken when at least 19 of 20 non-empty cells match it.
THRESHOLD_MATCHES = 19
THRESHOLD_OF = 20

_COUNTS = (
    "empty_count",
    "non_empty_count",
    "integer_matches",
    "decimal_matches",
    "boolean_matches",
    "date_matches",
    "timestamptz_matches",
    "explicit_count",
    "naive_count",
    "max_scale",
)


def column_profile(cells: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per text column with its empty, non-empty and per-type match counts.

    Each record is turned into one row per cell without a shuffle, so the work of one
    cell is compiled once however many columns there are, and only one partial row
    per column and task crosses the network. A missing cell counts as empty, white
    space does not.
    """
    names = list(cells.columns if names is None else names)
    long = cells.select(*[F.col(f"`{n}`").cast("string").alias(n) for n in names]).unpivot(
        [], [f"`{n}`" for n in names], "name", "cell"
    )
    text = F.col("text")
    # Guards keep a cell from meeting a pattern it cannot match; the answers are the same.
    looked_at = (
        long.withColumn("text", trimmed(F.col("cell")))
        .withColumn("filled", F.coalesce(F.col("cell") != "", F.lit(False)))
        .withColumns(
            {
                "is_decimal": decimal_text(text),
                "is_boolean": F.when(F.length(text).between(2, 5), boolean_text(text)),
                "is_date": F.when(F.length(text) == 10, date_text(text)),
                "is_datetime": F.when(F.length(text) >= 19, datetime_text(text)),
            }
        )
    )

    whole = F.col("is_decimal") & text.rlike(INTEGER_PATTERN)
    explicit = has_offset(text)
    scale = F.when(
        F.col("is_decimal") & text.contains("."), F.length(F.substring_index(text, ".", -1))
    )
    counted = looked_at.groupBy("name").agg(
        F.count_if(~F.col("filled")).alias("empty_count"),
        F.count_if(F.col("filled")).alias("non_empty_count"),
        F.count_if(F.when(whole, fits_bigint(text))).alias("integer_matches"),
        F.count_if(F.col("is_decimal")).alias("decimal_matches"),
        F.count_if(F.col("is_boolean")).alias("boolean_matches"),
        F.count_if(F.col("is_date")).alias("date_matches"),
        F.count_if(F.col("is_datetime")).alias("timestamptz_matches"),
        F.count_if(F.col("is_datetime") & explicit).alias("explicit_count"),
        F.count_if(F.col("is_datetime") & ~explicit).alias("naive_count"),
        F.coalesce(F.max(scale), F.lit(0)).cast("bigint").alias("max_scale"),
    )
    # Every column is reported, also when there was no row to count.
    listed = cells.sparkSession.createDataFrame(
        [(i, n) for i, n in enumerate(names, start=1)], "position bigint, name string"
    )
    return (
        listed.join(counted, "name", "left")
        .select("position", "name", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _COUNTS])
        .orderBy("position")
    )


def _reached(matches: str) -> Column:
    enough = F.col(matches) * THRESHOLD_OF >= F.col("non_empty_count") * THRESHOLD_MATCHES
    return (F.col("non_empty_count") > 0) & enough


def decided_type() -> Column:
    """Column type from the counts of :func:`column_profile`.

    Every integer is also a decimal, so integer is taken only where the two counts
    tie: one fractional value makes the column decimal and loses nothing.
    """
    whole = F.col("integer_matches") == F.col("decimal_matches")
    return (
        F.when(whole & _reached("integer_matches"), F.lit(INTEGER))
        .when(_reached("decimal_matches"), F.lit(DECIMAL))
        .when(_reached("boolean_matches"), F.lit(BOOLEAN))
        .when(_reached("date_matches"), F.lit(DATE))
        .when(_reached("timestamptz_matches"), F.lit(TIMESTAMPTZ))
        .otherwise(F.lit(STRING))
    )


def infer_types(profile: DataFrame) -> DataFrame:
    return profile.select("position", "name", decided_type().alias("type"))


def infer_schema(profile: DataFrame) -> DataFrame:
    """Proposed schema: type, nullability, unparseable cells, offset kind, decimal scale."""
    typed = profile.withColumn("type", decided_type())
    matches = F.lit(0).cast("bigint")
    for name in (INTEGER, DECIMAL, BOOLEAN, DATE, TIMESTAMPTZ):
        matches = F.when(F.col("type") == name, F.col(f"{name}_matches")).otherwise(matches)
    matches = F.when(F.col("type") == STRING, F.col("non_empty_count")).otherwise(matches)
    unparseable = F.col("non_empty_count") - matches
    offset = F.when(
        F.col("type") == TIMESTAMPTZ,
        F.when((F.col("explicit_count") > 0) & (F.col("naive_count") > 0), F.lit("mixed"))
        .when(F.col("explicit_count") > 0, F.lit("explicit"))
        .otherwise(F.lit("naive")),
    )
    return typed.select(
        "position",
        "name",
        "type",
        ((F.col("empty_count") > 0) | (unparseable > 0)).alias("nullable"),
        unparseable.alias("unparseable_count"),
        offset.alias("datetime_offset"),
        F.when(F.col("type") == DECIMAL, F.col("max_scale")).alias("decimal_scale"),
    )


def confirm_schema(
    proposed: DataFrame,
    overrides: Mapping[int, str] | None = None,
    scales: Mapping[int, int] | None = None,
) -> list[CellType]:
    """The user's decision over a proposed schema: types by 1-based position.

    The result is small, one entry per column, and is what :func:`typed_load` takes.
    """
    overrides = dict(overrides or {})
    for column_type in overrides.values():
        if column_type not in COLUMN_TYPES:
            raise ValidationError(f'"{column_type}" is not a column type.')
    rows = proposed.select("position", "name", "type", "decimal_scale").orderBy("position").collect()
    known = {row.position for row in rows}
    for position in overrides:
        if position not in known:
            raise ValidationError(f"Column override references unknown position {position}.")
    confirmed = []
    for row in rows:
        cell_type = CellType(row.name, overrides.get(row.position, row.type))
        # The default scale is kept unless the profiled cells need more digits.
        wanted = (scales or {}).get(row.position, max(cell_type.scale, row.decimal_scale or 0))
        confirmed.append(CellType(cell_type.name, cell_type.type, min(wanted, 38)))
    return confirmed
