"""Running saved questions: one at a time, or a dashboard's worth as one frame."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlumblineError, SchemaIncompatibleError, error_code
from ..functions.instants import date_grain
from ..model import Column, columns_of, require_timezone
from ..operators.audit import EXECUTION_SCHEMA, FAILED, SUCCESS
from ..sources.versions import VersionStore
from .rollups import cheapest, rolled_query
from .spec import Measure, QuerySpec, SchemaIssue, check_against
from .structured import QueryResult, effective_order, exact_average, execute, filter_condition, measure_expression, ranked, text_of

NO_CURRENT_VERSION = "This dataset has no current version to run against."


@dataclass(frozen=True)
class Dataset:
    """The version a dataset currently points at; ``frame`` is None while it has none."""

    frame: DataFrame | None
    version: int | None = None
    columns: Sequence[Column] | None = None
    #: Smaller tables of the version, which answer what they cover.
    rollups: Sequence[DataFrame] = ()


@dataclass(frozen=True)
class SavedQuery:
    """A named question, bound to a dataset rather than to one of its versions."""

    id: str
    name: str
    spec: QuerySpec


@dataclass(frozen=True)
class Widget:
    position: int
    query: SavedQuery


@dataclass(frozen=True)
class Outcome:
    """What became of one widget: a result, or the code and message of its refusal."""

    widget: Widget
    result: QueryResult | None
    code: str | None = None
    message: str | None = None


Resolver = Callable[[str], Dataset]


def _resolved(resolve: Resolver, query: SavedQuery) -> Dataset:
    dataset = resolve(query.spec.dataset_id)
    if dataset.frame is None:
        issue = SchemaIssue("NO_CURRENT_VERSION", query.spec.dataset_id, NO_CURRENT_VERSION)
        raise SchemaIncompatibleError([issue])
    return dataset


def run_saved_query(
    query: SavedQuery, resolve: Resolver, timezone: str, log: list[tuple] | None = None
) -> QueryResult:
    """Run a saved question against its dataset's current version, and log the run.

    A dataset that does not resolve leaves no log row, as there is no version to name.
    """
    dataset = _resolved(resolve, query)
    columns = columns_of(dataset.frame.schema) if dataset.columns is None else dataset.columns
    started, clock = datetime.now(UTC), time.monotonic()

    def note(status: str, duration_ms: int, row_count: int | None, code: str | None) -> None:
        if log is not None:
            identity = (str(uuid.uuid4()), query.id, dataset.version, timezone, status)
            log.append((*identity, started, datetime.now(UTC), duration_ms, row_count, code))

    try:
        rolled = cheapest(dataset.rollups, query.spec, timezone, columns)
        answer = None if rolled is None else rolled_query(rolled, dataset.frame, query.spec, timezone, columns)
        result = execute(dataset.frame, query.spec, timezone, columns, answer=answer)
    except Exception as error:
        note(FAILED, round((time.monotonic() - clock) * 1000), None, error_code(error))
        raise
    note(SUCCESS, result.duration_ms, result.row_count, None)
    return result


def run_report(
    widgets: Sequence[Widget], resolve: Resolver, timezone: str, log: list[tuple] | None = None
) -> list[Outcome]:
    """Run widgets in position order. One that fails becomes an outcome, not an exception."""
    outcomes = []
    for widget in sorted(widgets, key=lambda w: w.position):
        try:
            result = run_saved_query(widget.query, resolve, timezone, log)
            outcomes.append(Outcome(widget, result))
        except Exception as error:
            known = isinstance(error, PlumblineError)
            message = str(error) if known else "Something went wrong."
            outcomes.append(Outcome(widget, None, error_code(error), message))
    return outcomes


def store_resolver(store: VersionStore) -> Resolver:
    """Datasets of a version store, each as its current version."""

    def resolve(dataset_id: str) -> Dataset:
        version = store.current_version_number(dataset_id)
        if version is None:
            return Dataset(None)
        described = store.version_columns(dataset_id, version)
        return Dataset(store.read_version(dataset_id, version), version, described, store.rollups(dataset_id, version))

    return resolve


def run_stored_query(query: SavedQuery, store: VersionStore, timezone: str) -> QueryResult:
    """Run a saved question on the store; its audit row is stored whether it succeeds or not."""
    log: list[tuple] = []
    try:
        return run_saved_query(query, store_resolver(store), timezone, log)
    finally:
        if log:
            store.append("executions", executions_frame(store.spark, log))


def stored_executions(store: VersionStore) -> DataFrame:
    return store.log("executions", EXECUTION_SCHEMA)


def executions_frame(spark: SparkSession, log: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(log), EXECUTION_SCHEMA)


def report_pack(
    spark: SparkSession, widgets: Sequence[Widget], resolve: Resolver, timezone: str
) -> DataFrame:
    """All widgets' answers as one frame, in the order of the dashboard.

    ``widget_position, widget, row_position, label, value, error_code``: label is the
    dimensions, value the first measure. A widget that cannot run is one row with its
    code. Answers are whole, unless a question has a limit of its own. All widgets of a dataset are
    answered by one scan, one aggregate and one sort, whose rows are written to number them.
    """
    parts, asked = [], {}
    for place, widget in enumerate(sorted(widgets, key=lambda w: w.position)):
        try:
            dataset = _resolved(resolve, widget.query)
            columns = columns_of(dataset.frame.schema) if dataset.columns is None else list(dataset.columns)
            require_timezone(timezone)
            check_against(widget.query.spec, columns)
            asked.setdefault(widget.query.spec.dataset_id, (dataset, columns, []))[2].append((place, widget))
        except PlumblineError as error:
            parts.append(_refusal(spark, widget, error.code))
    parts += [_answers(dataset.frame, columns, placed, timezone) for dataset, columns, placed in asked.values()]
    return reduce(DataFrame.unionByName, parts).orderBy("widget_position", "row_position")


def _answers(df: DataFrame, columns: Sequence[Column], placed: Sequence[tuple[int, Widget]], timezone: str) -> DataFrame:
    """The answers of several widgets over one dataset, from one pass over its rows.

    A row goes once to every widget whose filters it meets, with the keys of that widget and nulls for
    the keys of others, as with grouping sets. Keys and measures that widgets share are worked out once.
    """
    by_id = {c.id: c for c in columns}
    source = lambda column_id: F.col(f"`{by_id[column_id].name}`")
    scale = lambda column_id: getattr(df.schema[by_id[column_id].name].dataType, "scale", None)
    specs = {place: widget.query.spec for place, widget in placed}
    keys = list(dict.fromkeys((d.column_id, d.granularity) for s in specs.values() for d in s.dimensions))
    totals = list(dict.fromkeys((m.aggregation, m.field) for s in specs.values() for m in s.measures))
    fields = list(dict.fromkeys(f for _, f in totals if f is not None))
    conditions = {
        place: reduce(and_, [filter_condition(f, source(f.column_id), by_id[f.column_id].type, scale(f.column_id)) for f in spec.filters], F.lit(True))
        for place, spec in specs.items()
    }
    if all(spec.filters for spec in specs.values()):
        df = df.filter(reduce(or_, conditions.values()))
    rows = df.select(
        *[(source(c) if g is None else date_grain(source(c), g, timezone)).alias(f"_key_{i}") for i, (c, g) in enumerate(keys)],
        *[source(f).alias(f"_field_{i}") for i, f in enumerate(fields)],
        *[F.coalesce(condition, F.lit(False)).alias(f"_meets_{place}") for place, condition in conditions.items()],
        F.lit(1).alias("_real"),
    )
    # A question without dimensions has an answer also where no row meets its filters.
    kinds = {field.name: field.dataType for field in rows.schema.fields}
    alone = [place for place, spec in specs.items() if not spec.dimensions]
    if alone:
        met = {f"_meets_{place}" for place in alone}
        empty = [(F.lit(n in met) if n.startswith("_meets_") else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()]
        rows = rows.unionByName(df.sparkSession.range(1).select(*empty))

    def arm(place: int) -> SparkColumn:
        own = {(d.column_id, d.granularity) for d in specs[place].dimensions}
        values = [F.col(f"_key_{i}") if key in own else F.lit(None).cast(kinds[f"_key_{i}"]) for i, key in enumerate(keys)]
        return F.when(F.col(f"_meets_{place}"), F.struct(F.lit(place).alias("_widget"), *[v.alias(f"_key_{i}") for i, v in enumerate(values)]))

    arms = F.filter(F.array(*[arm(place) for place in specs]), lambda a: a.isNotNull())
    spread = rows.select(F.explode(arms).alias("_arm"), *[f"_field_{i}" for i in range(len(fields))], "_real").select("_arm.*", *[f"_field_{i}" for i in range(len(fields))], "_real")
    measures, averages = [], {}
    for i, (aggregation, field) in enumerate(totals):
        column = F.col("_real") if field is None else F.col(f"_field_{fields.index(field)}")
        measures.append(measure_expression(Measure(aggregation, "m", field), column, None if field is None else by_id[field].type).alias(f"_measure_{i}"))
        if aggregation == "avg":
            measures.append(F.count(column).alias(f"_count_{i}"))
            averages[f"_measure_{i}"] = exact_average(F.col(f"_measure_{i}"), F.col(f"_count_{i}"), scale(field) or 0)
    grouped = spread.groupBy("_widget", *[f"_key_{i}" for i in range(len(keys))]).agg(*(measures or [F.count(F.lit(1)).alias("_rows")]))
    grouped = grouped.withColumns(averages) if averages else grouped
    kinds = {field.name: field.dataType for field in grouped.schema.fields}

    def place_of(spec: QuerySpec, kind: str, ref: str) -> str:
        if kind == "dimension":
            # Where one column is grouped twice, its id names the last of the two.
            last = [d for d in spec.dimensions if d.column_id == ref][-1]
            return f"_key_{keys.index((last.column_id, last.granularity))}"
        named = next(m for m in spec.measures if m.alias == ref)
        return f"_measure_{totals.index((named.aggregation, named.field))}"

    order = [F.col("_widget").asc()]
    label = value = F.lit(None).cast("string")
    position, name, limit = F.lit(None).cast("bigint"), F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for place, widget in placed:
        spec, mine = widget.query.spec, F.col("_widget") == place
        wanted = [(place_of(spec, o.kind, o.ref), o.direction) for o in effective_order(spec)]
        used = {n for n, _ in wanted}
        wanted += [(n, "asc") for d in spec.dimensions if (n := f"_key_{keys.index((d.column_id, d.granularity))}") not in used]
        for n, direction in wanted:
            column = F.when(mine, F.col(n))
            order.append(column.asc_nulls_last() if direction == "asc" else column.desc_nulls_first())
        shown = dict.fromkeys(place_of(spec, "dimension", d.column_id) for d in spec.dimensions)
        text = F.concat_ws(" / ", *[F.coalesce(text_of(F.col(n), kinds[n]), F.lit("—")) for n in shown])
        label = F.when(mine, text).otherwise(label)
        if spec.measures:
            first = place_of(spec, "measure", spec.measures[0].alias)
            value = F.when(mine, text_of(F.col(first), kinds[first])).otherwise(value)
        position, name = F.when(mine, F.lit(widget.position).cast("bigint")).otherwise(position), F.when(mine, F.lit(widget.query.name)).otherwise(name)
        limit = F.when(mine, F.lit(spec.limit).cast("bigint")).otherwise(limit)
    numbered = ranked(grouped, order)
    # One row a widget.
    starts = numbered.groupBy("_widget").agg(F.min("position").alias("_start"))
    own = F.col("position") - F.col("_start") + 1
    return numbered.join(F.broadcast(starts), "_widget").filter(limit.isNull() | (own <= limit)).select(
        position.alias("widget_position"), name.alias("widget"), own.cast("bigint").alias("row_position"),
        label.alias("label"), value.alias("value"), F.lit(None).cast("string").alias("error_code"),
    )


def _refusal(spark: SparkSession, widget: Widget, code: str) -> DataFrame:
    return spark.range(1).select(
        F.lit(widget.position).cast("bigint").alias("widget_position"),
        F.lit(widget.query.name).alias("widget"),
        F.lit(None).cast("bigint").alias("row_position"),
        F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("string").alias("value"),
        F.lit(code).alias("error_code"),
    )


def report_audit(pack: DataFrame, versions: DataFrame, timezone: str) -> DataFrame:
    """One audit row per widget of a pack: version, zone, status, row count, code.

    ``versions`` has ``widget, dataset_version``. The row count of a failed run is null.
    """
    failed = F.max("error_code")
    runs = pack.groupBy("widget_position", "widget").agg(
        failed.alias("error_code"), F.count("row_position").alias("rows")
    )
    ok = F.col("error_code").isNull()
    return runs.join(versions, "widget", "left").select(
        "widget_position",
        "widget",
        "dataset_version",
        F.lit(timezone).alias("timezone"),
        F.when(ok, F.lit(SUCCESS)).otherwise(F.lit(FAILED)).alias("status"),
        F.when(ok, F.col("rows")).alias("row_count"),
        "error_code",
    )
