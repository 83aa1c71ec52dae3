"""Structured questions: filters, grouping, grains, measures, order, limit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GRANULARITIES
from ..plans.rollups import Rollup, rolled_query, rolled_up
from ..plans.spec import Dimension as D
from ..plans.spec import Filter as Where
from ..plans.spec import Measure as M
from ..plans.spec import OrderBy, QuerySpec
from ..plans.structured import query_page, render_text, structured_query
from ..session import scratch_path
from .tables import SALES, ZONE, activity, local_grain, portable, sales

QUERIES = {}
ORACLES = {}

_COUNT = M("count", "rows")
_TOTAL = M("sum", "total", "amount")
_BY_CURRENCY = [D("currency")]


def _ask(spec: QuerySpec):
    def query(spark, sf_dir):
        return portable(structured_query(sales(spark, sf_dir), spec, ZONE))

    return query


def _page(spec: QuerySpec, cap: int | None = None):
    def query(spark, sf_dir):
        return portable(query_page(sales(spark, sf_dir), spec, ZONE, cap=cap))

    return query


def _register(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = f"WITH {SALES} {sql}"


# The flagship: everything at once.
FLAGSHIP = QuerySpec(
    "sales",
    [D("created_at", "month")],
    [M("sum", "value", "amount"), _COUNT],
    [Where("currency", "eq", "F"), Where("amount", "gt", 1000)],
)


def structured_flagship(spark, sf_dir):
    return render_text(query_page(sales(spark, sf_dir), FLAGSHIP, ZONE, cap=None))


_month = local_grain("month", "created_at")
_register(
    "structured_query",
    structured_flagship,
    f""", grouped AS (
      SELECT {_month} AS created_at, sum(amount) AS value, count(*) AS n FROM sales
      WHERE currency = 'F' AND amount > 1000 GROUP BY 1)
    SELECT created_at, CAST(value AS VARCHAR) AS value, CAST(n AS VARCHAR) AS rows,
           CAST(row_number() OVER (ORDER BY value DESC NULLS FIRST, created_at NULLS LAST) AS VARCHAR)
             AS position,
           'false' AS has_more, 'false' AS truncated
    FROM grouped""",
)

# One filter operator each.
_FILTERS = {
    "filter_eq": ([Where("currency", "eq", "F")], "currency = 'F'"),
    "filter_neq": ([Where("plan", "neq", "5-LOW")], "plan <> '5-LOW'"),
    "filter_range": (
        [
            Where("amount", "gte", "50000.50"),
            Where("amount", "lt", 400000),
            Where("day", "gt", "1996-03-01"),
            Where("created_at", "lte", "2000-06-30T12:00:00Z"),
        ],
        "amount >= 50000.50 AND amount < 400000 AND day > DATE '1996-03-01' "
        "AND created_at <= TIMESTAMP '2000-06-30 12:00:00'",
    ),
    "filter_between": (
        [
            Where("day", "between", ["1997-01-01", "1999-12-31"]),
            Where("amount", "between", [1000, "250000.25"]),
        ],
        "day BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND amount BETWEEN 1000 AND 250000.25",
    ),
    "filter_in": (
        [Where("plan", "in", ["1-URGENT", "5-LOW"]), Where("currency", "in", ["O", "P"])],
        "plan IN ('1-URGENT', '5-LOW') AND currency IN ('O', 'P')",
    ),
    "filter_and": (
        [
            Where("currency", "neq", "P"),
            Where("amount", "gt", 100000),
            Where("plan", "is_not_null"),
            Where("customer_id", "gte", 10),
        ],
        "currency <> 'P' AND amount > 100000 AND plan IS NOT NULL AND customer_id >= 10",
    ),
}
for _name, (_filters, _sql) in _FILTERS.items():
    _register(
        _name,
        _ask(QuerySpec("sales", [D("currency"), D("plan")], [_COUNT, _TOTAL], _filters)),
        f"""SELECT currency, plan, count(*) AS rows, CAST(sum(amount) AS VARCHAR) AS total
            FROM sales WHERE {_sql} GROUP BY currency, plan""",
    )


def filter_null(spark, sf_dir):
    """Null and not-null side by side: the two halves of one dataset."""
    frame = sales(spark, sf_dir)
    halves = [
        structured_query(
            frame, QuerySpec("sales", [D("currency"), D("plan")], [_COUNT], [Where("plan", check)])
        )
        for check in ("is_null", "is_not_null")
    ]
    return halves[0].unionByName(halves[1])


_register(
    "filter_null",
    filter_null,
    """SELECT currency, plan, count(*) AS rows FROM sales WHERE plan IS NULL GROUP BY ALL
       UNION ALL
       SELECT currency, plan, count(*) AS rows FROM sales WHERE plan IS NOT NULL GROUP BY ALL""",
)

_register(
    "group_by",
    _ask(QuerySpec("sales", [D("currency"), D("plan"), D("customer_id")], [_COUNT, _TOTAL])),
    """SELECT currency, plan, customer_id, count(*) AS rows, CAST(sum(amount) AS VARCHAR) AS total
       FROM sales GROUP BY currency, plan, customer_id""",
)


def _grain(granularity):
    spec = QuerySpec(
        "activity",
        [D("ts", granularity), D("event_type")],
        [_COUNT, M("sum", "total", "amount")],
    )

    def query(spark, sf_dir):
        return portable(structured_query(activity(spark, sf_dir), spec, ZONE))

    return query


for _granularity in GRANULARITIES:
    QUERIES[f"grain_{_granularity}"] = _grain(_granularity)
    ORACLES[f"grain_{_granularity}"] = f"""
        SELECT {local_grain(_granularity, "ts")} AS ts, event_type, count(*) AS rows,
               CAST(sum(CAST(value AS DECIMAL(18,2))) AS VARCHAR) AS total
        FROM events GROUP BY 1, 2"""

_register(
    "agg_count_all",
    _ask(QuerySpec("sales", [D("plan")], [_COUNT])),
    "SELECT plan, count(*) AS rows FROM sales GROUP BY plan",
)
_register(
    "agg_count",
    _ask(QuerySpec("sales", _BY_CURRENCY, [M("count", "plans", "plan"), M("count", "paid_rows", "paid")])),
    "SELECT currency, count(plan) AS plans, count(paid) AS paid_rows FROM sales GROUP BY currency",
)
_register(
    "agg_count_distinct",
    _ask(
        QuerySpec(
            "sales",
            _BY_CURRENCY,
            [
                M("count_distinct", "customers", "customer_id"),
                M("count_distinct", "plans", "plan"),
                M("count_distinct", "days", "day"),
            ],
        )
    ),
    """SELECT currency, count(DISTINCT customer_id) AS customers, count(DISTINCT plan) AS plans,
              count(DISTINCT day) AS days FROM sales GROUP BY currency""",
)
_register(
    "agg_sum",
    _ask(
        QuerySpec(
            "sales",
            _BY_CURRENCY,
            [_TOTAL, M("sum", "ids", "sale_id"), M("sum", "paid_total", "paid")],
        )
    ),
    """SELECT currency, CAST(sum(amount) AS VARCHAR) AS total,
              CAST(sum(CAST(sale_id AS HUGEINT)) AS VARCHAR) AS ids,
              CAST(sum(paid) AS VARCHAR) AS paid_total FROM sales GROUP BY currency""",
)


def _exact_average(value: str, scale: int) -> str:
    """SQL for a non-negative average to ten places, half up, in whole-number arithmetic."""
    units = f"sum(CAST({value} * {10**scale} AS HUGEINT))"
    tenths = f"((2 * {units} * {10 ** (10 - scale)} + count({value})) // (2 * count({value})))"
    return (
        f"CAST({tenths} // 10000000000 AS VARCHAR) || '.' || "
        f"lpad(CAST({tenths} % 10000000000 AS VARCHAR), 10, '0')"
    )


_register(
    "agg_avg",
    _ask(
        QuerySpec(
            "sales",
            [D("currency"), D("plan")],
            [M("avg", "average", "amount"), M("avg", "mean_id", "sale_id"), M("avg", "mean_paid", "paid")],
        )
    ),
    f"""SELECT currency, plan, {_exact_average("amount", 2)} AS average,
               {_exact_average("sale_id", 0)} AS mean_id,
               CASE WHEN count(paid) > 0 THEN {_exact_average("paid", 2)} END AS mean_paid
        FROM sales GROUP BY currency, plan""",
)
_register(
    "agg_min_max",
    _ask(
        QuerySpec(
            "sales",
            _BY_CURRENCY,
            [
                M("min", "lowest", "amount"),
                M("max", "highest", "amount"),
                M("min", "first_plan", "plan"),
                M("max", "last_day", "day"),
                M("max", "last_id", "sale_id"),
            ],
        )
    ),
    """SELECT currency, CAST(min(amount) AS VARCHAR) AS lowest, CAST(max(amount) AS VARCHAR) AS highest,
              min(plan) AS first_plan, CAST(max(day) AS VARCHAR) AS last_day, max(sale_id) AS last_id
       FROM sales GROUP BY currency""",
)


def agg_total(spark, sf_dir):
    """One row without grouping, over all rows and over none."""
    frame = sales(spark, sf_dir)
    pinned = [Where("currency", "in", ["F"])]
    measures = [_COUNT, _TOTAL, M("max", "last_day", "day")]
    some = structured_query(frame, QuerySpec("sales", [], measures, pinned))
    none = structured_query(frame, QuerySpec("sales", [], measures, [Where("currency", "eq", "?")]))
    return portable(some.unionByName(none))


_total_sql = """SELECT count(*) AS rows, CAST(sum(amount) AS VARCHAR) AS total,
                       CAST(max(day) AS VARCHAR) AS last_day FROM sales WHERE currency = """
_register("agg_total", agg_total, f"{_total_sql}'F' UNION ALL {_total_sql}'?'")

_register(
    "distinct_values",
    _ask(QuerySpec("sales", [D("plan"), D("created_at", "quarter")])),
    f"SELECT DISTINCT plan, {local_grain('quarter', 'created_at')} AS created_at FROM sales",
)

_paged = """, grouped AS ({grouped}),
    placed AS (SELECT *, row_number() OVER (ORDER BY {order}) AS position, count(*) OVER () AS n
               FROM grouped)
    SELECT {columns}, position, n > {limit} AS has_more, false AS truncated
    FROM placed WHERE position <= {limit}"""
_whole = _paged.replace("n > {limit} AS has_more", "false AS has_more").replace(" WHERE position <= {limit}", "")
_by_plan_and_day = "SELECT plan, day, count(*) AS rows FROM sales GROUP BY plan, day"
_register(
    "order_explicit",
    _page(
        QuerySpec(
            "sales",
            [D("plan"), D("day")],
            [_COUNT],
            order_by=[
                OrderBy("dimension", "plan", "desc"),
                OrderBy("measure", "rows", "asc"),
                OrderBy("dimension", "day", "asc"),
            ],
        )
    ),
    _whole.format(
        grouped=_by_plan_and_day,
        order="plan DESC NULLS FIRST, rows ASC NULLS LAST, day ASC NULLS LAST",
        columns="plan, CAST(day AS VARCHAR) AS day, rows",
    ),
)
_UNPAID_FIRST = QuerySpec(
    "orders", [D("customer_id")], [M("sum", "value", "paid"), _COUNT]
)


def order_default(spark, sf_dir):
    """First measure descending, nulls first, on a dataset without a currency column."""
    frame = sales(spark, sf_dir).drop("currency")
    return portable(query_page(frame, _UNPAID_FIRST, ZONE, cap=None))


_register(
    "order_default",
    order_default,
    _whole.format(
        grouped="SELECT customer_id, sum(paid) AS value, count(*) AS rows FROM sales GROUP BY 1",
        order="value DESC NULLS FIRST, customer_id ASC NULLS LAST",
        columns="customer_id, CAST(value AS VARCHAR) AS value, rows",
    ),
)
_register(
    "limit_probe",
    _page(QuerySpec("sales", [D("customer_id")], [_COUNT], limit=25)),
    _paged.format(
        grouped="SELECT customer_id, count(*) AS rows FROM sales GROUP BY customer_id",
        order="rows DESC NULLS FIRST, customer_id ASC NULLS LAST",
        columns="customer_id, rows",
        limit=25,
    ),
)


def result_shape(spark, sf_dir):
    """Dimensions then measures, named by column id and alias, every value as text."""
    spec = QuerySpec(
        "sales",
        [D("created_at", "year"), D("currency")],
        [
            M("max", "latest", "created_at"),
            M("count_distinct", "customers", "customer_id"),
            M("avg", "average", "amount"),
            _TOTAL,
        ],
    )
    return render_text(structured_query(sales(spark, sf_dir), spec, ZONE))


_register(
    "result_shape",
    result_shape,
    f"""SELECT {local_grain("year", "created_at")} AS created_at, currency,
               strftime(max(created_at), '%Y-%m-%dT%H:%M:%S.%gZ') AS latest,
               CAST(count(DISTINCT customer_id) AS VARCHAR) AS customers,
               {_exact_average("amount", 2)} AS average, CAST(sum(amount) AS VARCHAR) AS total
        FROM sales GROUP BY 1, 2""",
)

_ROLLUP = Rollup("created_at", ("currency", "plan"), ("amount", "customer_id"), ZONE)
_ROLLED = (
    QuerySpec("sales", [D("created_at", "month")], FLAGSHIP.measures, [Where("currency", "eq", "F")]),
    QuerySpec("sales", [D("created_at", "quarter")], [M("avg", "value", "amount"), _COUNT], [Where("currency", "eq", "O"), Where("plan", "is_not_null")]),
    QuerySpec("sales", [D("created_at", "year")], [M("sum", "value", "customer_id"), M("max", "rows", "customer_id")]),
)


def rollup_query(spark, sf_dir):
    """Three questions answered from stored totals by month, currency and plan."""
    frame = sales(spark, sf_dir)
    stored = scratch_path(spark, "rollup")
    rolled_up(frame, _ROLLUP).write.parquet(stored)
    rolled = spark.read.parquet(stored)
    answers = [portable(rolled_query(rolled, frame, spec, ZONE)) for spec in _ROLLED]
    return reduce(DataFrame.union, [a.withColumn("value", F.col("value").cast("string")) for a in answers])


_register(
    "rollup_query",
    rollup_query,
    f"""SELECT {_month} AS created_at, CAST(sum(amount) AS VARCHAR) AS value, count(*) AS rows
        FROM sales WHERE currency = 'F' GROUP BY 1
        UNION ALL SELECT {local_grain("quarter", "created_at")}, {_exact_average("amount", 2)}, count(*)
        FROM sales WHERE currency = 'O' AND plan IS NOT NULL GROUP BY 1
        UNION ALL SELECT {local_grain("year", "created_at")}, CAST(sum(customer_id) AS VARCHAR), max(customer_id)
        FROM sales GROUP BY 1""",
)
