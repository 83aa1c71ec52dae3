"""Shaping an ordered answer for a bar chart, without overstating what it shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import BAR_CATEGORY_CAP
from ..plans.spec import Dimension, Filter, Measure, QuerySpec
from ..plans.structured import effective_order, text_of

NO_LABEL = "—"


def chart_spec(
    dataset_id: str,
    dimension: Dimension | None,
    measure: Measure | None,
    condition: Filter | None = None,
) -> QuerySpec:
    """A one-dimension question in chart shape: ``value`` first, and a count of its rows."""
    measures = []
    if measure is not None:
        measures = [Measure(measure.aggregation, "value", measure.field), Measure("count", "rows")]
    return QuerySpec(
        dataset_id,
        [] if dimension is None else [dimension],
        measures,
        [] if condition is None else [condition],
    )


def ranked_by_measure(spec: QuerySpec, alias: str) -> bool:
    """Whether the rows come largest first by the charted measure."""
    first = effective_order(spec)[0]
    return first.kind == "measure" and first.ref == alias and first.direction == "desc"


def top_categories(page: DataFrame, ranked: bool) -> DataFrame:
    """The first 50 rows of a page with what was dropped and the note to print.

    ``page`` comes from :func:`plumbline.plans.structured.query_page`; the highest position in
    it is the number of groups, of a truncated page a lower bound. "top" needs rows that
    are ranked by the charted measure.
    """
    total = page.agg(F.max("position")).scalar()
    verb = "top" if ranked else "first"
    shown = F.concat(F.format_number(total, 0), F.when(F.col("truncated"), "+").otherwise(""))
    note = F.concat(F.lit(f"Showing {verb} {BAR_CATEGORY_CAP} of "), shown)
    dropped = F.greatest(total - BAR_CATEGORY_CAP, F.lit(0))
    first = page.filter(F.col("position") <= BAR_CATEGORY_CAP)
    return (
        first.withColumn("dropped_count", dropped)
        .withColumn("note", F.when(F.col("dropped_count") > 0, note))
        .drop("has_more", "truncated")
    )


def bar_series(page: DataFrame, dimension: str, value: str = "value", rows: str = "rows") -> DataFrame:
    """``position, label, value, row_count``: null labels as a dash, null values as zero."""
    label = text_of(F.col(f"`{dimension}`"), page.schema[dimension].dataType)
    return page.select(
        "position",
        F.coalesce(label, F.lit(NO_LABEL)).alias("label"),
        F.coalesce(F.col(f"`{value}`"), F.lit(0)).alias("value"),
        F.coalesce(F.col(f"`{rows}`"), F.lit(0)).alias("row_count"),
    )


def peak_row(series: DataFrame) -> DataFrame:
    """The row with the largest value; of equal ones the first by position. None of no rows."""
    row = F.struct(*[f"`{name}`" for name in series.columns])
    best = series.agg(F.max_by(row, F.struct("value", -F.col("position"))).alias("row"))
    return best.filter("row is not null").select("row.*")
