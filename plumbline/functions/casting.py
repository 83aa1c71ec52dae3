"""Raw text cells to typed values, each with the reason it could not be taken as it is."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import (
    BOOLEAN,
    DATE,
    DECIMAL,
    DEFAULT_DECIMAL_SCALE,
    INTEGER,
    STRING,
    TIMESTAMPTZ,
    require_timezone,
    spark_type,
)
from .fence import fence
from .grammar import (
    DECIMAL_PATTERN,
    INTEGER_PATTERN,
    TRUE_LITERALS,
    boolean_text,
    date_text,
    datetime_text,
    has_offset,
    trimmed,
)
from .instants import AMBIGUOUS, NONEXISTENT, offset_seconds, resolve_wall_clocks, wall_seconds

# The issue codes and their message templates. A message never
# carries the offending value.
UNPARSEABLE_VALUE = "UNPARSEABLE_VALUE"
AMBIGUOUS_LOCAL_TIME = "AMBIGUOUS_LOCAL_TIME"
NONEXISTENT_LOCAL_TIME = "NONEXISTENT_LOCAL_TIME"
FIELD_COUNT_MISMATCH = "FIELD_COUNT_MISMATCH"
ENCODING = "ENCODING"
MESSAGES = {
    UNPARSEABLE_VALUE: 'Value in column "{name}" could not be parsed as {type}.',
    AMBIGUOUS_LOCAL_TIME: 'Value in column "{name}" is an ambiguous local time during a DST '
    "fall-back; resolved to the earlier instant.",
    NONEXISTENT_LOCAL_TIME: 'Value in column "{name}" is a local time that does not exist during '
    "a DST spring-forward; resolved forward.",
    FIELD_COUNT_MISMATCH: "Row has {actual} fields, expected {expected}.",
    ENCODING: 'Value in column "{name}" contains an invalid character and could not be loaded.',
}
ISSUE_TYPE = (
    "struct<row_number:bigint,column_name:string,error_code:string,message:string>"
)
ISSUES = "_issues"

_NUL = "\x00"


@dataclass(frozen=True)
class CellType:
    """How one raw column is to be read; ``scale`` matters for decimals only."""

    name: str
    type: str
    scale: int = DEFAULT_DECIMAL_SCALE


def cast_cells(
    df: DataFrame,
    cells: Sequence[CellType],
    timezone: str,
    row_number: Column | None = None,
    field_count: Column | None = None,
) -> DataFrame:
    """Replace raw text columns by typed ones and add the ``_issues`` of every row.

    An empty or missing cell is a null value and no issue. A cell that fails its
    grammar is null with an issue. A local time inside a gap or an overlap keeps the
    instant chosen for it *and* has an issue. ``field_count`` is the number of fields
    the record really had, where that is known. ``_issues`` is null for a clean row.
    Other columns pass through.
    """
    require_timezone(timezone)
    # One stage per step: every step uses the one before it more than once, and
    # nested into one expression the whole would be too large to compile.
    staged = df.withColumns(
        {f"_text_{i}": trimmed(_raw(c)) for i, c in enumerate(cells) if c.type != STRING}
    )
    instants = [i for i, c in enumerate(cells) if c.type == TIMESTAMPTZ]
    if instants:
        staged = staged.withColumns({f"_wall_{i}": _wall(F.col(f"_text_{i}")) for i in instants})
        staged = staged.withColumns(
            {
                f"_naive_{i}": F.when(~has_offset(F.col(f"_text_{i}")), F.col(f"_wall_{i}"))
                for i in instants
            }
        )
        staged = resolve_wall_clocks(staged, {f"_local_{i}": f"_naive_{i}" for i in instants}, timezone)
    staged = staged.withColumns({f"_value_{i}": _value(i, c) for i, c in enumerate(cells)})
    staged = staged.withColumns({f"_code_{i}": _code(i, c) for i, c in enumerate(cells)})

    raw_names = {c.name for c in cells}
    issues = _issues(cells, row_number, field_count)
    return staged.select(
        *[F.col(f"`{name}`") for name in df.columns if name not in raw_names],
        *[fence(F.col(f"_value_{i}")).alias(c.name) for i, c in enumerate(cells)],
        fence(issues).alias(ISSUES),
    )


def _raw(cell_type: CellType) -> Column:
    return F.col(f"`{cell_type.name}`")


def _wall(text: Column) -> Column:
    return F.when(datetime_text(text), wall_seconds(text))


def _value(i: int, cell_type: CellType) -> Column:
    cell, text = _raw(cell_type), F.col(f"_text_{i}")
    if cell_type.type == STRING:
        value = F.when(cell != "", cell)
    elif cell_type.type == INTEGER:
        value = F.when(text.rlike(INTEGER_PATTERN), text.try_cast("bigint"))
    elif cell_type.type == DECIMAL:
        value = F.when(text.rlike(DECIMAL_PATTERN), exact_decimal(text, cell_type.scale))
    elif cell_type.type == BOOLEAN:
        value = F.when(boolean_text(text), F.lower(text).isin(*TRUE_LITERALS))
    elif cell_type.type == DATE:
        value = F.when(date_text(text), text.try_cast("date"))
    else:
        explicit = F.timestamp_seconds(F.col(f"_wall_{i}") - offset_seconds(text))
        value = F.coalesce(F.col(f"_local_{i}")["instant"], explicit)
    return F.when(~cell.contains(_NUL), value)


def _code(i: int, cell_type: CellType) -> Column:
    cell = _raw(cell_type)
    code = F.when(cell.contains(_NUL), F.lit(ENCODING))
    if cell_type.type == STRING:
        return code
    code = code.when((cell != "") & F.col(f"_value_{i}").isNull(), F.lit(UNPARSEABLE_VALUE))
    if cell_type.type == TIMESTAMPTZ:
        kind = F.col(f"_local_{i}")["kind"]
        code = code.when(kind == AMBIGUOUS, F.lit(AMBIGUOUS_LOCAL_TIME))
        code = code.when(kind == NONEXISTENT, F.lit(NONEXISTENT_LOCAL_TIME))
    return code


def exact_decimal(text: Column, scale: int = DEFAULT_DECIMAL_SCALE) -> Column:
    """The decimal a grammatical text spells, or null if it would have to be altered.

    Spark's widest decimal has 38 digits. A text with more digits than fit, or with
    significant digits beyond ``scale``, is refused instead of being rounded.
    """
    plain = F.translate(text, ",", "")
    rounds = plain.rlike(rf"\.[0-9]{{{scale}}}[0-9]*[1-9]")
    return F.when(~rounds, plain.try_cast(spark_type(DECIMAL, scale)))


def _issues(
    cells: Sequence[CellType], row_number: Column | None, field_count: Column | None
) -> Column:
    number = (F.lit(None) if row_number is None else row_number).cast("bigint")
    none = F.array().cast(f"array<{ISSUE_TYPE}>")

    def one(name: str | None, code: Column, message: Column) -> Column:
        entry = F.struct(
            number.alias("row_number"),
            F.lit(name).cast("string").alias("column_name"),
            code.alias("error_code"),
            message.alias("message"),
        )
        return F.array(entry).cast(f"array<{ISSUE_TYPE}>")

    found = []
    signals = []
    if field_count is not None:
        template = MESSAGES[FIELD_COUNT_MISMATCH].format(actual="%d", expected=len(cells))
        mismatch = field_count != len(cells)
        message = F.format_string(template, field_count)
        found.append(F.when(mismatch, one(None, F.lit(FIELD_COUNT_MISMATCH), message)).otherwise(none))
        signals.append(F.when(mismatch, F.lit(FIELD_COUNT_MISMATCH)))
    for i, cell_type in enumerate(cells):
        code = F.col(f"_code_{i}")
        message = _cell_message(code, cell_type)
        found.append(F.when(code.isNotNull(), one(cell_type.name, code, message)).otherwise(none))
        signals.append(code)
    return F.when(F.coalesce(*signals).isNotNull(), F.concat(*found))


def _cell_message(code: Column, cell_type: CellType) -> Column:
    codes = [ENCODING]
    if cell_type.type != STRING:
        codes.append(UNPARSEABLE_VALUE)
    if cell_type.type == TIMESTAMPTZ:
        codes += [AMBIGUOUS_LOCAL_TIME, NONEXISTENT_LOCAL_TIME]
    message = F.lit(None).cast("string")
    for known in codes:
        text = MESSAGES[known].format(name=cell_type.name, type=cell_type.type)
        message = F.when(code == known, F.lit(text)).otherwise(message)
    return message
