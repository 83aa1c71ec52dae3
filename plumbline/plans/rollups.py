"""Monthly totals kept beside a version, and the questions that can be answered from them.

A rollup has one row for each month and combination of key columns, with the count, sum, least and
greatest of some number columns. It is written with its version, from the rows just
stored, so it never differs from them. A question whose dimensions, filters and measures need no more
is answered from it, with the same values and types as from the rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.instants import date_grain
from ..model import DECIMAL, INTEGER, TIMESTAMPTZ, Column, columns_of, require_timezone
from .spec import Measure, QuerySpec, check_against
from .structured import _ordering, _projection, exact_average, filter_condition, measure_expression

MONTH, ROWS = "_month", "_rows"
#: What a month can be made part of.
GRAINS = ("month", "quarter", "year")
PARTS = ("sum", "count", "min", "max")


@dataclass(frozen=True)
class Rollup:
    """Which columns, by name: the instant, the keys, the numbers; and the zone its months are of."""

    date: str
    keys: tuple[str, ...]
    fields: tuple[str, ...]
    timezone: str


def _part(name: str, field: str) -> str:
    return f"_{name}_{field}"


def rolled_up(df: DataFrame, rollup: Rollup, columns: Sequence[Column] | None = None) -> DataFrame:
    """The rollup's table. Its definition is kept in the metadata of the month."""
    types = {c.name: c.type for c in (columns_of(df.schema) if columns is None else columns)}
    require_timezone(rollup.timezone)
    if types.get(rollup.date) != TIMESTAMPTZ or any(types.get(f) not in (INTEGER, DECIMAL) for f in rollup.fields):
        raise ValueError("A rollup needs an instant, and numbers to add up.")
    month = date_grain(F.col(f"`{rollup.date}`"), "month", rollup.timezone)
    definition = {"rollup": json.dumps(asdict(rollup))}
    totals = [F.count(F.lit(1)).alias(ROWS)]
    for field in rollup.fields:
        column = F.col(f"`{field}`")
        totals += [measure_expression(Measure(part, part, field), column, types[field]).alias(_part(part, field)) for part in PARTS]
    return df.groupBy(month.alias(MONTH, metadata=definition), *[F.col(f"`{k}`") for k in rollup.keys]).agg(*totals)


def definition_of(rolled: DataFrame) -> Rollup:
    kept = json.loads(rolled.schema[MONTH].metadata["rollup"])
    return Rollup(kept["date"], tuple(kept["keys"]), tuple(kept["fields"]), kept["timezone"])


def covers(rollup: Rollup, spec: QuerySpec, timezone: str, columns: Sequence[Column]) -> bool:
    """Whether a question can be answered from the rollup alone."""
    names = {c.id: c.name for c in columns}

    def kept(dimension) -> bool:
        name = names.get(dimension.column_id)
        if dimension.granularity is None:
            return name in rollup.keys
        return name == rollup.date and dimension.granularity in GRAINS and timezone == rollup.timezone

    return (
        all(kept(d) for d in spec.dimensions)
        and all(names.get(f.column_id) in rollup.keys for f in spec.filters)
        and bool(spec.measures)
        and all(m.aggregation != "count_distinct" and (m.field is None or names.get(m.field) in rollup.fields) for m in spec.measures)
    )


def rolled_query(
    rolled: DataFrame,
    df: DataFrame,
    spec: QuerySpec,
    timezone: str = "UTC",
    columns: Sequence[Column] | None = None,
    limit_rows: int | None = None,
) -> DataFrame:
    """The answer of ``structured_query(df, ...)`` from a rollup of ``df`` that covers it; no row of ``df`` is read."""
    columns = columns_of(df.schema) if columns is None else list(columns)
    require_timezone(timezone)
    check_against(spec, columns)
    by_id = {c.id: c for c in columns}
    for condition in spec.filters:
        named = by_id[condition.column_id]
        kind = df.schema[named.name].dataType
        scale = kind.scale if isinstance(kind, T.DecimalType) else None
        rolled = rolled.filter(filter_condition(condition, F.col(f"`{named.name}`"), named.type, scale))
    keys = []
    for i, d in enumerate(spec.dimensions):
        whole = F.col(f"`{by_id[d.column_id].name}`") if d.granularity is None else F.to_date(F.date_trunc(d.granularity, F.col(MONTH)))
        keys.append(whole.alias(f"_key_{i}"))
    measures, averages = [], {}
    for i, m in enumerate(spec.measures):
        name = f"_measure_{i}"
        field = None if m.field is None else by_id[m.field]
        measures.append(_total(m, field, df).alias(name))
        if m.aggregation == "avg":
            measures.append(_added(_part("count", field.name)).alias(f"_count_{i}"))
            kind = df.schema[field.name].dataType
            averages[name] = exact_average(F.col(name), F.col(f"_count_{i}"), kind.scale if isinstance(kind, T.DecimalType) else 0)
    grouped = rolled.groupBy(*keys).agg(*measures) if keys else rolled.agg(*measures)
    ordered = (grouped.withColumns(averages) if averages else grouped).orderBy(*_ordering(spec))
    return (ordered if limit_rows is None else ordered.limit(limit_rows)).select(*_projection(spec))


def _added(name: str) -> SparkColumn:
    return F.coalesce(F.sum(F.col(f"`{name}`")), F.lit(0)).cast("bigint")


def _total(measure: Measure, field: Column | None, df: DataFrame) -> SparkColumn:
    if measure.aggregation == "count":
        return _added(ROWS if field is None else _part("count", field.name))
    if measure.aggregation in ("min", "max"):
        return (F.min if measure.aggregation == "min" else F.max)(F.col(f"`{_part(measure.aggregation, field.name)}`"))
    kind = df.schema[field.name].dataType
    # Sums of sums are as wide as sums of rows.
    wide = T.DecimalType(min(38, kind.precision + 10), kind.scale) if isinstance(kind, T.DecimalType) else T.DecimalType(38, 0)
    return F.sum(F.col(f"`{_part('sum', field.name)}`")).cast(wide)


def cheapest(rollups: Sequence[DataFrame], spec: QuerySpec, timezone: str, columns: Sequence[Column]) -> DataFrame | None:
    """The rollup with the fewest keys that covers a question."""
    fit = [r for r in rollups if covers(definition_of(r), spec, timezone, columns)]
    return min(fit, key=lambda r: len(definition_of(r).keys), default=None)
