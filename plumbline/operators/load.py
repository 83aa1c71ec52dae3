"""Typed rows and the issues found while typing them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.casting import ISSUES, CellType, cast_cells


def typed_load(
    records: DataFrame,
    cells: Sequence[CellType],
    timezone: str,
    row_number: Column | None = None,
    field_count: Column | None = None,
) -> DataFrame:
    """Every record, typed, with its issues beside it; no record is dropped.

    Typed values and issues come out of one pass over the text. Write the result once
    (:func:`plumbline.sources.versions.write_version`) and read both parts from there,
    or split it with :func:`typed_rows` and :func:`import_errors`.
    """
    if not cells:
        raise ValidationError("The confirmed schema has no columns to load.")
    return cast_cells(records, cells, timezone, row_number, field_count)


def typed_rows(loaded: DataFrame) -> DataFrame:
    return loaded.drop(ISSUES)


def import_errors(loaded: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """One row per issue, after the columns ``kept``. Rows without one are skipped before anything is unnested."""
    return (
        loaded.filter(F.col(ISSUES).isNotNull())
        .select(*kept, F.explode(ISSUES).alias("issue"))
        .select(*kept, "issue.*")
    )


def issue_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_code").agg(F.count(F.lit(1)).alias("issue_count"))


def load_summary(loaded: DataFrame) -> DataFrame:
    """One row: rows loaded, rows with an issue (a subset, they load too), columns with a null."""
    names = [name for name in loaded.columns if name != ISSUES]
    flags = [F.max(F.col(f"`{n}`").isNull()).alias(f"_null_{i}") for i, n in enumerate(names)]
    totals = loaded.agg(
        F.count(F.lit(1)).alias("rows_imported"),
        F.count(ISSUES).alias("rows_rejected"),
        *flags,
    )
    nullable = F.array_compact(
        F.array(*[F.when(F.col(f"_null_{i}"), F.lit(n)) for i, n in enumerate(names)])
    )
    return totals.select("rows_imported", "rows_rejected", nullable.alias("nullable_columns"))
