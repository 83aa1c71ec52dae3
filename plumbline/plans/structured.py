"""A structured question as one lazy DataFrame over a dataset version.

Filters sit directly on the scan, only referenced columns are read, aggregation is
partial before its shuffle, and order plus limit become a distributed top-k.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from decimal import ROUND_FLOOR, ROUND_HALF_UP, Context, Decimal

import pandas as pd
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.instants import date_grain
from ..model import (
    DATE,
    DECIMAL,
    INTEGER,
    MAX_RESULT_ROWS,
    Column,
    columns_of,
    require_timezone,
)
from ..session import scratch_path
from .spec import Filter, Measure, OrderBy, QuerySpec, check_against, typed_value

#: Decimal places of an average: at least ten, and six more than its column has.
AVERAGE_SCALE, AVERAGE_EXTRA = 10, 6


@dataclass(frozen=True)
class ResultColumn:
    name: str
    type: str


@dataclass(frozen=True)
class QueryResult:
    """A finished page: at most the product cap of rows, and what is known about the rest."""

    columns: tuple[ResultColumn, ...]
    rows: tuple[dict, ...]
    row_count: int
    has_more: bool
    truncated: bool
    duration_ms: int
    executed_at: datetime


def effective_limit(limit: int | None, cap: int | None = MAX_RESULT_ROWS) -> int | None:
    """A limit of 0 is a legal existence probe, so only ``None`` means the cap; no cap, no limit."""
    given = [n for n in (limit, cap) if n is not None]
    return min(given) if given else None


def filter_condition(
    condition: Filter, column: SparkColumn, column_type: str, scale: int | None = None
) -> SparkColumn:
    """One filter as a predicate; a null cell satisfies none of them but ``is_null``.

    ``scale`` is that of a decimal column, when it is known. Values of any number of
    digits can then be compared: cells lie on a grid, so a value between two grid points
    parts the cells as the one below it does.
    """
    if condition.operator == "is_null":
        return column.isNull()
    if condition.operator == "is_not_null":
        return column.isNotNull()
    if condition.operator == "between":
        low, high = (typed_value(raw, column_type) for raw in condition.value)
        return _compared("gte", column, low, column_type, scale) & _compared("lte", column, high, column_type, scale)
    if condition.operator == "in":
        values = [typed_value(raw, column_type) for raw in condition.value]
        stored = [v for v in values if not isinstance(v, Decimal) or scale is None or _on_grid(v, scale)]
        return column.isin(*[_literal(v, column_type) for v in stored]) if stored else _always(False, column)
    return _compared(condition.operator, column, typed_value(condition.value, column_type), column_type, scale)


def _compared(
    operator: str, column: SparkColumn, value, column_type: str, scale: int | None
) -> SparkColumn:
    if isinstance(value, Decimal) and scale is not None and not _on_grid(value, scale):
        if operator in ("eq", "neq"):
            return _always(operator == "neq", column)
        if abs(value) >= Decimal(10) ** (38 - scale):
            return _always((value > 0) == (operator in ("lt", "lte")), column)
        value = value.quantize(Decimal(1).scaleb(-scale), context=Context(prec=400, rounding=ROUND_FLOOR))
        operator = "lte" if operator in ("lt", "lte") else "gt"
    literal = _literal(value, column_type)
    return {
        "eq": column == literal,
        "neq": column != literal,
        "gt": column > literal,
        "gte": column >= literal,
        "lt": column < literal,
        "lte": column <= literal,
    }[operator]


def _always(holds: bool, column: SparkColumn) -> SparkColumn:
    """The same answer for every cell that is not null."""
    return column.isNotNull() if holds else F.lit(False)


def _on_grid(value: Decimal, scale: int) -> bool:
    """Whether a decimal(38, scale) column can hold the value."""
    return value.normalize(Context(prec=400)).as_tuple().exponent >= -scale and abs(value) < Decimal(10) ** (38 - scale)


def _literal(value, column_type: str) -> SparkColumn:
    if isinstance(value, Decimal):
        return _decimal_literal(value)
    return F.lit(value).cast("bigint") if column_type == INTEGER else F.lit(value)


def _decimal_literal(value: Decimal) -> SparkColumn:
    """The narrowest exact decimal type, so that comparing does not widen the column away."""
    exponent = value.normalize().as_tuple().exponent
    scale = max(0, -exponent)
    digits = len(f"{abs(value):f}".replace(".", "").lstrip("0"))
    precision = min(38, max(digits, scale, 1))
    return F.lit(f"{value:f}").cast(T.DecimalType(precision, min(scale, precision)))


def measure_expression(
    measure: Measure, column: SparkColumn | None, column_type: str | None
) -> SparkColumn:
    """One aggregate, averages apart. Integer sums widen to decimal."""
    if measure.aggregation == "count":
        return F.count(F.lit(1)) if column is None else F.count(column)
    if measure.aggregation == "count_distinct":
        return F.count_distinct(column)
    if measure.aggregation in ("min", "max"):
        return (F.min if measure.aggregation == "min" else F.max)(column)
    return F.sum(column.cast("decimal(38,0)") if column_type == INTEGER else column)


def average_scale(scale: int) -> int:
    return min(max(AVERAGE_SCALE, scale + AVERAGE_EXTRA), 38)


def exact_average(total: SparkColumn, count: SparkColumn, scale: int = 0) -> SparkColumn:
    """``total / count``, rounded half up once, to ten places or six more than ``total`` has.

    Decimal division keeps no more than ten places beside 28 digits before the point, so
    averages with more are divided in batches over the grouped rows.
    """
    places = average_scale(scale)
    if places == AVERAGE_SCALE:
        return (total.cast("decimal(38,10)") / count.cast("decimal(20,0)")).cast("decimal(38,10)")

    def divided(totals: pd.Series, counts: pd.Series) -> pd.Series:
        context, unit = Context(prec=120, rounding=ROUND_HALF_UP), Decimal(1).scaleb(-places)
        whole = zip(totals, counts, strict=True)
        return pd.Series(
            [None if t is None else context.divide(t, Decimal(int(n))).quantize(unit, context=context) for t, n in whole],
            dtype=object,
        )

    return F.pandas_udf(divided, T.DecimalType(38, places))(total, count)


def structured_query(
    df: DataFrame,
    spec: QuerySpec,
    timezone: str = "UTC",
    columns: Sequence[Column] | None = None,
    limit_rows: int | None = None,
) -> DataFrame:
    """The question's full answer as a lazy frame, ordered, without the page limit.

    ``columns`` describes ``df`` and defaults to what its schema says. Pass
    ``limit_rows`` to keep only the first rows of that order.
    """
    columns = columns_of(df.schema) if columns is None else list(columns)
    require_timezone(timezone)
    check_against(spec, columns)
    grouped = _grouped(df, spec, timezone, {c.id: c for c in columns})
    ordered = grouped.orderBy(*_ordering(spec))
    if limit_rows is not None:
        ordered = ordered.limit(limit_rows)
    return ordered.select(*_projection(spec))


def _grouped(df: DataFrame, spec: QuerySpec, timezone: str, by_id: dict[str, Column]) -> DataFrame:
    def source(column_id: str) -> SparkColumn:
        return F.col(f"`{by_id[column_id].name}`")

    for condition in spec.filters:
        named = by_id[condition.column_id]
        scale = _scale_of(df, named.name)
        df = df.filter(filter_condition(condition, source(condition.column_id), named.type, scale))

    keys = []
    for i, dimension in enumerate(spec.dimensions):
        key = source(dimension.column_id)
        if dimension.granularity is not None:
            key = date_grain(key, dimension.granularity, timezone)
        keys.append(key.alias(f"_key_{i}"))
    if not spec.measures:
        return df.select(*keys).distinct()
    measures, averages = [], {}
    for i, m in enumerate(spec.measures):
        name = f"_measure_{i}"
        column = None if m.field is None else source(m.field)
        column_type = None if m.field is None else by_id[m.field].type
        measures.append(measure_expression(m, column, column_type).alias(name))
        if m.aggregation == "avg":
            scale = _scale_of(df, by_id[m.field].name) or 0
            measures.append(F.count(column).alias(f"_count_{i}"))
            averages[name] = exact_average(F.col(name), F.col(f"_count_{i}"), scale)
    grouped = df.groupBy(*keys).agg(*measures) if keys else df.agg(*measures)
    return grouped.withColumns(averages) if averages else grouped


def _scale_of(df: DataFrame, name: str) -> int | None:
    data_type = df.schema[name].dataType
    return data_type.scale if isinstance(data_type, T.DecimalType) else None


def _positions(spec: QuerySpec) -> tuple[dict[str, str], dict[str, str]]:
    # Where one column is grouped twice, its id names the last of the two.
    keys = {d.column_id: f"_key_{i}" for i, d in enumerate(spec.dimensions)}
    measures = {m.alias: f"_measure_{i}" for i, m in enumerate(spec.measures)}
    return keys, measures


def effective_order(spec: QuerySpec) -> Sequence[OrderBy]:
    """The given order, else the first measure descending, else the first dimension ascending."""
    if spec.order_by:
        return spec.order_by
    if spec.measures:
        return (OrderBy("measure", spec.measures[0].alias, "desc"),)
    return (OrderBy("dimension", spec.dimensions[0].column_id, "asc"),)


def _ordering(spec: QuerySpec) -> list[SparkColumn]:
    """Typed sort keys with nulls last ascending and first descending, then a tie-break.

    The tie-break on the remaining dimensions makes a page repeatable; it never
    outranks what was asked for.
    """
    keys, measures = _positions(spec)
    order = []
    used = set()
    for item in effective_order(spec):
        name = (keys if item.kind == "dimension" else measures)[item.ref]
        used.add(name)
        column = F.col(name)
        order.append(
            column.asc_nulls_last() if item.direction == "asc" else column.desc_nulls_first()
        )
    for i in range(len(spec.dimensions)):
        if f"_key_{i}" not in used:
            order.append(F.col(f"_key_{i}").asc_nulls_last())
    return order


def _projection(spec: QuerySpec) -> list[SparkColumn]:
    keys, measures = _positions(spec)
    return [F.col(name).alias(ref) for ref, name in {**keys, **measures}.items()]


def result_columns(spec: QuerySpec, columns: Sequence[Column]) -> tuple[ResultColumn, ...]:
    """Names and types of an answer: dimensions by column id, then measures by alias."""
    types = {c.id: c.type for c in columns}
    shape = {
        d.column_id: DATE if d.granularity is not None else types[d.column_id]
        for d in spec.dimensions
    }
    for measure in spec.measures:
        if measure.aggregation in ("count", "count_distinct"):
            shape[measure.alias] = INTEGER
        elif measure.aggregation == "avg":
            shape[measure.alias] = DECIMAL
        else:
            shape[measure.alias] = types[measure.field]
    return tuple(ResultColumn(name, column_type) for name, column_type in shape.items())


def limited_page(
    ordered: DataFrame,
    limit: int | None,
    order: Sequence[SparkColumn],
    cap: int | None = MAX_RESULT_ROWS,
) -> DataFrame:
    """The first rows of an order, each with its ``position`` and what lies beyond.

    One row more than the limit is fetched as a probe: ``has_more`` says that it was
    there, ``truncated`` that the product cap, not the caller, cut it off. The
    windows run over the probed page only, at most one row more than the limit. Without
    limit and cap all rows are the page, numbered by ``ranked``.
    """
    size = effective_limit(limit, cap)
    if size is None:
        nothing = F.lit(False)
        return ranked(ordered, order).withColumn("has_more", nothing).withColumn("truncated", nothing)
    probed = ordered.orderBy(*order).limit(size + 1)
    everything = Window.partitionBy(F.lit(0))
    more = F.count(F.lit(1)).over(everything) > size
    return (
        probed.withColumn("position", F.row_number().over(everything.orderBy(*order)))
        .withColumn("has_more", more)
        .withColumn("truncated", more & F.lit(size == cap))
        .filter(F.col("position") <= size)
    )


def ranked(df: DataFrame, order: Sequence[SparkColumn]) -> DataFrame:
    """Every row with its ``position`` in an order, without bringing the rows into one task.

    The sorted rows are written with their range and their place in it; what the ranges
    before hold is summed over one row per range.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = scratch_path(df.sparkSession, "ranked")
    sorted_rows = df.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_place": place})
    sorted_rows.write.parquet(stored)
    rows = df.sparkSession.read.schema(sorted_rows.schema).parquet(stored)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    ahead = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_ahead"))
    # One row for each partition of the sort, so it is small whatever the data.
    placed = rows.join(F.broadcast(ahead), "_range")
    return placed.withColumn("position", F.col("_ahead") + F.col("_place") + 1).drop("_range", "_place", "_ahead")


def query_page(
    df: DataFrame,
    spec: QuerySpec,
    timezone: str = "UTC",
    columns: Sequence[Column] | None = None,
    cap: int | None = MAX_RESULT_ROWS,
) -> DataFrame:
    """A question's page with ``position``, ``has_more`` and ``truncated``; ``cap=None`` for all rows."""
    columns = columns_of(df.schema) if columns is None else list(columns)
    require_timezone(timezone)
    check_against(spec, columns)
    grouped = _grouped(df, spec, timezone, {c.id: c for c in columns})
    page = limited_page(grouped, spec.limit, _ordering(spec), cap)
    return page.select(*_projection(spec), "position", "has_more", "truncated")


def execute(
    df: DataFrame,
    spec: QuerySpec,
    timezone: str = "UTC",
    columns: Sequence[Column] | None = None,
    as_text: bool = True,
    answer: DataFrame | None = None,
) -> QueryResult:
    """Run a question to a finished page. Values are text or None unless ``as_text`` is off.

    ``answer`` is the whole answer in its order where it does not come from ``df`` itself.
    """
    columns = columns_of(df.schema) if columns is None else list(columns)
    executed_at = datetime.now(UTC)
    size = effective_limit(spec.limit)
    if answer is None:
        answer = structured_query(df, spec, timezone, columns)
    answer = answer.limit(size + 1)
    shape = result_columns(spec, columns)
    if as_text:
        answer = render_text(answer)
    started = time.monotonic()
    fetched = answer.collect()  # bounded: the limit is at most the product cap plus the probe
    duration_ms = round((time.monotonic() - started) * 1000)
    rows = tuple(row.asDict() for row in fetched[:size])
    has_more = len(fetched) > size
    return QueryResult(
        columns=shape,
        rows=rows,
        row_count=len(rows),
        has_more=has_more,
        truncated=has_more and size == MAX_RESULT_ROWS,
        duration_ms=duration_ms,
        executed_at=executed_at,
    )


def text_of(column: SparkColumn, data_type: T.DataType) -> SparkColumn:
    """A value as text: decimals with every digit, instants as ISO date-times in UTC."""
    if isinstance(data_type, T.TimestampType):
        utc = F.to_utc_timestamp(column, F.current_timezone())
        return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return column.cast("string")


def render_text(df: DataFrame) -> DataFrame:
    """Every column as text; nulls stay null."""
    return df.select(
        *[text_of(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    )
