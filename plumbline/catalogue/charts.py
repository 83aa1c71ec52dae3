"""Chart-ready results and report packs over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.charts import bar_series, chart_spec, peak_row, ranked_by_measure, top_categories
from ..plans.report import Dataset, SavedQuery, Widget, report_audit, report_pack
from ..plans.spec import Dimension, Filter, Measure, QuerySpec
from ..plans.structured import query_page
from .tables import SALES, ZONE, local_grain, portable, sales

QUERIES = {}
ORACLES = {}

_TOTAL = Measure("sum", "total", "paid")


def _charted(spark, sf_dir, dimension):
    # Without its currency column the dataset has amounts of one kind only.
    frame = sales(spark, sf_dir).drop("currency")
    spec = chart_spec("sales", Dimension(dimension), _TOTAL)
    return query_page(frame, spec, ZONE, cap=None), spec


def _top(spark, sf_dir):
    page, spec = _charted(spark, sf_dir, "customer_id")
    return portable(top_categories(page, ranked_by_measure(spec, "value")))


_GROUPED = """grouped AS (SELECT {0} AS key, sum(paid) AS value, count(*) AS n FROM sales GROUP BY 1),
    placed AS (SELECT *, row_number() OVER (ORDER BY value DESC NULLS FIRST, key ASC NULLS LAST)
               AS position, count(*) OVER () AS total FROM grouped)"""

QUERIES["top_categories"] = _top
ORACLES["top_categories"] = f"""WITH {SALES}, {_GROUPED.format("customer_id")}
    SELECT key AS customer_id, CAST(value AS VARCHAR) AS value, n AS rows, position,
      greatest(total - 50, 0) AS dropped_count,
      CASE WHEN total > 50 THEN 'Showing top 50 of ' || format('{{:,}}', total) END AS note
    FROM placed WHERE position <= 50"""


def _bars(spark, sf_dir):
    page, _ = _charted(spark, sf_dir, "plan")
    return portable(bar_series(page, "plan"))


QUERIES["bar_series"] = _bars
ORACLES["bar_series"] = f"""WITH {SALES}, {_GROUPED.format("plan")}
    SELECT position, coalesce(key, '—') AS label, CAST(coalesce(value, 0) AS VARCHAR) AS value,
      n AS row_count FROM placed"""


def _peak(spark, sf_dir):
    page, _ = _charted(spark, sf_dir, "customer_id")
    return portable(peak_row(bar_series(page, "customer_id")))


QUERIES["peak_row"] = _peak
ORACLES["peak_row"] = f"""WITH {SALES}, {_GROUPED.format("customer_id")}
    SELECT position, CAST(key AS VARCHAR) AS label, CAST(coalesce(value, 0) AS VARCHAR) AS value,
      n AS row_count FROM placed
    ORDER BY coalesce(value, 0) DESC, position LIMIT 1"""

# A dashboard: two good widgets, one whose column is gone, one that mixes currencies,
# one whose dataset has no version.
_WIDGETS = [
    Widget(
        0,
        SavedQuery(
            "q1",
            "Monthly",
            QuerySpec(
                "sales",
                [Dimension("created_at", "month")],
                [Measure("sum", "value", "amount"), Measure("count", "rows")],
                [Filter("currency", "eq", "F")],
            ),
        ),
    ),
    Widget(
        1,
        SavedQuery(
            "q2",
            "By plan",
            QuerySpec("sales", [Dimension("plan"), Dimension("currency")], [Measure("count", "rows")]),
        ),
    ),
    Widget(
        2, SavedQuery("q3", "Gone", QuerySpec("sales", [Dimension("region")], [Measure("count", "rows")]))
    ),
    Widget(
        3, SavedQuery("q4", "Mixed", QuerySpec("sales", [], [Measure("sum", "value", "amount")]))
    ),
    Widget(
        4, SavedQuery("q5", "Empty", QuerySpec("new", [], [Measure("count", "rows")]))
    ),
]
_PACK_SQL = f"""{SALES}, monthly AS (SELECT {local_grain("month", "created_at")} AS label,
      sum(amount) AS value FROM sales WHERE currency = 'F' GROUP BY 1),
    plans AS (SELECT plan, currency, count(*) AS value FROM sales GROUP BY plan, currency),
    pack AS (
      SELECT CAST(0 AS BIGINT) AS widget_position, 'Monthly' AS widget,
        row_number() OVER (ORDER BY value DESC, label) AS row_position, label,
        CAST(value AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error_code FROM monthly
      UNION ALL SELECT 1, 'By plan',
        row_number() OVER (ORDER BY value DESC, plan ASC NULLS LAST, currency ASC NULLS LAST),
        coalesce(plan, '—') || ' / ' || coalesce(currency, '—'), CAST(value AS VARCHAR), NULL FROM plans
      UNION ALL SELECT 2, 'Gone', NULL, NULL, NULL, 'SCHEMA_INCOMPATIBLE'
      UNION ALL SELECT 3, 'Mixed', NULL, NULL, NULL, 'VALIDATION'
      UNION ALL SELECT 4, 'Empty', NULL, NULL, NULL, 'SCHEMA_INCOMPATIBLE')"""


def _pack(spark, sf_dir):
    frame = sales(spark, sf_dir)
    datasets = {"sales": Dataset(frame, 1), "new": Dataset(None)}
    return report_pack(spark, _WIDGETS, datasets.get, ZONE)


QUERIES["report_pack"] = _pack
ORACLES["report_pack"] = f"WITH {_PACK_SQL} SELECT * FROM pack"


def _audit(spark, sf_dir):
    versions = spark.createDataFrame(
        [(w.query.name, 1 if w.query.spec.dataset_id == "sales" else None) for w in _WIDGETS],
        "widget string, dataset_version bigint",
    )
    return report_audit(_pack(spark, sf_dir), versions, ZONE).withColumn(
        "dataset_version", F.coalesce("dataset_version", F.lit(0))
    )


QUERIES["report_audit"] = _audit
ORACLES["report_audit"] = f"""WITH {_PACK_SQL}
    SELECT widget_position, widget, CASE WHEN widget = 'Empty' THEN 0 ELSE 1 END AS dataset_version,
      '{ZONE}' AS timezone, CASE WHEN max(error_code) IS NULL THEN 'success' ELSE 'failed' END AS status,
      CASE WHEN max(error_code) IS NULL THEN count(row_position) END AS row_count,
      max(error_code) AS error_code
    FROM pack GROUP BY widget_position, widget"""
