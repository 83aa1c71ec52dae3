"""The six column types, what each one supports, and the fixed limits.

A dataset column is described by :class:`Column`. Inside Spark the same facts
live in the field metadata of a ``StructType``, so a version read back from
Parquet knows its own column ids.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from importlib import resources
from pathlib import Path

from pyspark.sql import types as T

from .errors import ValidationError

STRING = "string"
INTEGER = "integer"
DECIMAL = "decimal"
BOOLEAN = "boolean"
DATE = "date"
TIMESTAMPTZ = "timestamptz"
COLUMN_TYPES = (STRING, INTEGER, DECIMAL, BOOLEAN, DATE, TIMESTAMPTZ)

DECIMAL_PRECISION = 38
DEFAULT_DECIMAL_SCALE = 10

# The product-wide limits.
MAX_RESULT_ROWS = 10_000
MAX_PREVIEW_ROWS = 200
MAX_DIMENSIONS = 3
MAX_MEASURES = 5
MAX_FILTERS = 10
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_FILE_ROWS = 1_000_000
MAX_FILE_COLUMNS = 100
BAR_CATEGORY_CAP = 50

# Which filters and aggregations each type supports.
_ANY_FILTER = ("eq", "neq", "in", "is_null", "is_not_null")
_ORDERED_FILTER = ("gt", "gte", "lt", "lte", "between")
FILTERS_BY_TYPE = {
    STRING: _ANY_FILTER,
    INTEGER: _ANY_FILTER + _ORDERED_FILTER,
    DECIMAL: _ANY_FILTER + _ORDERED_FILTER,
    BOOLEAN: ("eq", "neq", "is_null", "is_not_null"),
    DATE: _ANY_FILTER + _ORDERED_FILTER,
    TIMESTAMPTZ: _ANY_FILTER + _ORDERED_FILTER,
}
AGGREGATIONS_BY_TYPE = {
    STRING: ("count", "count_distinct", "min", "max"),
    INTEGER: ("count", "count_distinct", "sum", "avg", "min", "max"),
    DECIMAL: ("count", "count_distinct", "sum", "avg", "min", "max"),
    BOOLEAN: ("count", "count_distinct"),
    DATE: ("count", "count_distinct", "min", "max"),
    TIMESTAMPTZ: ("count", "count_distinct", "min", "max"),
}
GRANULARITIES = ("day", "week", "month", "quarter", "year")
# The filter operators of a question.
FILTER_OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "between", "in", "is_null", "is_not_null")
AGGREGATIONS = AGGREGATIONS_BY_TYPE[INTEGER]


@dataclass(frozen=True)
class Column:
    """One column of a dataset version; ``id`` is opaque, ``name`` is what a person sees."""

    id: str
    name: str
    type: str
    nullable: bool = True
    position: int = 0

    def __post_init__(self):
        if self.type not in COLUMN_TYPES:
            raise ValidationError(f'"{self.type}" is not a column type.')


def spark_type(column_type: str, scale: int = DEFAULT_DECIMAL_SCALE) -> T.DataType:
    return {
        STRING: T.StringType(),
        INTEGER: T.LongType(),
        DECIMAL: T.DecimalType(DECIMAL_PRECISION, scale),
        BOOLEAN: T.BooleanType(),
        DATE: T.DateType(),
        TIMESTAMPTZ: T.TimestampType(),
    }[column_type]


def column_type_of(data_type: T.DataType) -> str:
    """The column type that holds a Spark type, for tables loaded by something else."""
    if isinstance(data_type, T.StringType):
        return STRING
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(data_type, T.DecimalType):
        return DECIMAL
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.DateType):
        return DATE
    if isinstance(data_type, T.TimestampType):
        return TIMESTAMPTZ
    raise ValidationError(
        f"{data_type.simpleString()} has no column type; cast doubles to decimal and "
        "timestamp_ntz to timestamp first."
    )


def columns_of(schema: T.StructType) -> list[Column]:
    """Columns of a frame, taking ids from field metadata and falling back to the name."""
    return [
        Column(
            id=field.metadata.get("column_id", field.name),
            name=field.name,
            type=column_type_of(field.dataType),
            nullable=field.metadata.get("nullable", field.nullable),
            position=position,
        )
        for position, field in enumerate(schema.fields, start=1)
    ]


@cache
def canonical_timezones() -> frozenset[str]:
    """Canonical IANA zone names: the rows of the tz database's ``zone1970.tab``, plus UTC.

    Aliases (``Asia/Calcutta``) and abbreviations (``EST``) are in no row of that
    file, although Spark itself would accept them.
    """
    names = {"UTC"}
    for line in _zone_table().splitlines():
        if line and not line.startswith("#"):
            names.add(line.split("\t")[2])
    return frozenset(names)


def _zone_table() -> str:
    try:
        return (resources.files("tzdata") / "zoneinfo" / "zone1970.tab").read_text("utf-8")
    except ModuleNotFoundError:
        return Path("/usr/share/zoneinfo/zone1970.tab").read_text("utf-8")


def require_timezone(name: str) -> str:
    if name not in canonical_timezones():
        raise ValidationError(f'"{name}" is not a recognized timezone.')
    return name
