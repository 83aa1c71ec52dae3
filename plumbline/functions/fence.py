"""Keeping Catalyst from copying a long expression into the filters above it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fence(column: Column) -> Column:
    """The same column, but evaluated where it stands.

    A filter is normally pushed below the projection it reads from, with every reference
    replaced by what it stands for. Over several stages that each use the one before
    many times, the copy grows beyond measure, and all parsing would be done twice. The
    partition id, which is never negative, makes the column depend on where it is
    evaluated, so it stays there.
    """
    return F.when(F.spark_partition_id() >= 0, column)
