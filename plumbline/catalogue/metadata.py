"""Catalog, schema comparison and audit queries, on tables shaped like a catalog.

Customers stand for datasets (nation: tenant), orders for their versions and for the
saved queries on them, line items for executions, widgets and columns, events for imports.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, catalog, schema
from .tables import SALES, portable, sales, table

QUERIES = {}
ORACLES = {}

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END"
_IMPORT_STATUS = """CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED'
    WHEN 'signup' THEN 'CANCELLED' WHEN 'view' THEN 'RUNNING' ELSE 'QUEUED' END"""


def _datasets(spark, sf_dir):
    per_customer = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("dataset_id"))
        .agg(
            F.min("o_orderdate").cast("timestamp").alias("created_at"),
            F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("current_version_id"),
        )
    )
    return (
        table(spark, sf_dir, "customer")
        .select(
            F.col("c_nationkey").alias("organization_id"),
            F.col("c_custkey").alias("dataset_id"),
            F.col("c_name").alias("dataset_name"),
        )
        .join(per_customer, "dataset_id", "left")
    )


_DATASETS = """datasets AS (SELECT c_nationkey AS organization_id, c_custkey AS dataset_id,
      c_name AS dataset_name, created_at, current_version_id
    FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at,
      max(o_orderkey) FILTER (o_orderstatus = 'F') AS current_version_id
      FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""


def _versions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("version_id"),
        F.col("o_custkey").alias("dataset_id"),
        F.col("o_orderkey").alias("version_number"),
        F.expr(_STATUS).alias("status"),
        F.floor("o_totalprice").alias("row_count"),
    )


_VERSIONS = f"""versions AS (SELECT o_orderkey AS version_id, o_custkey AS dataset_id,
      o_orderkey AS version_number, {_STATUS} AS status, CAST(floor(o_totalprice) AS BIGINT) AS row_count
    FROM orders)"""


def _saved_queries(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("saved_query_id"),
        F.col("o_custkey").alias("dataset_id"),
        F.col("o_orderpriority").alias("saved_query_name"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )


def _join_left(spark, sf_dir):
    joined = catalog.datasets_with_current_version(_datasets(spark, sf_dir), _versions(spark, sf_dir))
    return portable(joined)


QUERIES["join_left"] = _join_left
ORACLES["join_left"] = f"""WITH {_DATASETS}, {_VERSIONS}
    SELECT current_version_id, d.dataset_id, organization_id, dataset_name,
      strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, version_number, status, row_count
    FROM datasets d LEFT JOIN versions v ON v.version_id = d.current_version_id"""


def _join_inner(spark, sf_dir):
    executions = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("saved_query_id"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END").alias("status"),
    )
    return portable(
        catalog.saved_query_usage(_saved_queries(spark, sf_dir), _datasets(spark, sf_dir), executions)
    )


QUERIES["join_inner"] = _join_inner
ORACLES["join_inner"] = """SELECT o_orderkey AS saved_query_id, o_orderpriority AS saved_query_name,
      c_custkey AS dataset_id, c_name AS dataset_name,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS updated_at,
      coalesce(runs, 0) AS runs, coalesce(failed_runs, 0) AS failed_runs
    FROM orders JOIN customer ON c_custkey = o_custkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS runs, count(*) FILTER (l_returnflag = 'R') AS failed_runs
      FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""


def _join_chain(spark, sf_dir):
    widgets = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("dashboard_id"),
        F.col("l_linenumber").alias("position"),
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_partkey")).alias("widget_id"),
        F.col("l_orderkey").alias("saved_query_id"),
    )
    return catalog.widget_list(
        widgets, _saved_queries(spark, sf_dir), _datasets(spark, sf_dir), _versions(spark, sf_dir)
    )


QUERIES["join_chain"] = _join_chain
ORACLES["join_chain"] = f"""WITH {_DATASETS}, {_VERSIONS}
    SELECT l_suppkey AS dashboard_id, l_linenumber AS position,
      l_orderkey || '-' || l_partkey AS widget_id, l_orderkey AS saved_query_id,
      o_orderpriority AS saved_query_name, dataset_name, version_number
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    JOIN datasets d ON d.dataset_id = o_custkey
    LEFT JOIN versions v ON v.version_id = d.current_version_id"""


def _latest(spark, sf_dir):
    imports = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("import_id"),
        F.col("user_id").alias("dataset_id"),
        F.expr(_IMPORT_STATUS).alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    return portable(catalog.latest_imports(imports).drop("created_at"))


QUERIES["latest_per_key"] = _latest
ORACLES["latest_per_key"] = f"""SELECT user_id AS dataset_id, event_id AS import_id,
      {_IMPORT_STATUS} AS status, event_type NOT IN ('purchase', 'signup') AS is_open
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


def _totals(spark, sf_dir):
    return portable(catalog.workspace_totals(_datasets(spark, sf_dir), _versions(spark, sf_dir)))


QUERIES["workspace_totals"] = _totals
ORACLES["workspace_totals"] = f"""WITH {_DATASETS}, {_VERSIONS}, registered AS (
      SELECT organization_id, count(*) AS n FROM datasets JOIN versions USING (dataset_id) GROUP BY 1)
    SELECT organization_id, CAST(coalesce(sum(row_count), 0) AS VARCHAR) AS total_rows,
      count(row_count) AS datasets_with_version, coalesce(max(n), 0) AS registered_versions
    FROM datasets d LEFT JOIN versions v ON v.version_id = d.current_version_id
    LEFT JOIN registered USING (organization_id) GROUP BY organization_id"""


def _history(spark, sf_dir):
    return catalog.version_history(_datasets(spark, sf_dir), _versions(spark, sf_dir))


QUERIES["version_history"] = _history
ORACLES["version_history"] = f"""WITH {_DATASETS}, {_VERSIONS}
    SELECT v.dataset_id, version_id, version_number, status, row_count,
      current_version_id IS NOT NULL AS is_current,
      current_version_id IS NULL AND status = 'COMPLETED' AS is_superseded
    FROM versions v LEFT JOIN datasets d ON d.current_version_id = v.version_id"""


def _next(spark, sf_dir):
    return catalog.next_version_numbers(_datasets(spark, sf_dir), _versions(spark, sf_dir))


QUERIES["next_version"] = _next
ORACLES["next_version"] = """SELECT c_custkey AS dataset_id,
      coalesce(max(o_orderkey), 0) + 1 AS next_version_number
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""


def _scope(spark, sf_dir):
    return catalog.tenant_scope(_datasets(spark, sf_dir), 7).select("dataset_id", "dataset_name")


QUERIES["tenant_scope"] = _scope
ORACLES["tenant_scope"] = (
    "SELECT c_custkey AS dataset_id, c_name AS dataset_name FROM customer WHERE c_nationkey = 7"
)


def _dedup(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("import_id"),
        F.col("props").alias("object_key"),
        F.expr("NULLIF(event_type, 'view')").alias("dataset_id"),
        F.col("ts").cast("timestamp").alias("requested_at"),
    )
    earlier = table(spark, sf_dir, "customer").select(
        catalog.idempotency_key(
            F.concat(F.lit('{"k": '), F.col("c_custkey"), F.lit("}")), F.lit("click")
        ).alias("idempotency_key")
    )
    return catalog.admit_imports(requests, earlier).select("idempotency_key", "import_id", "repeats")


QUERIES["import_dedup"] = _dedup
ORACLES["import_dedup"] = """WITH keyed AS (SELECT *, sha256(props || chr(31) ||
      CASE WHEN event_type = 'view' THEN 'new' ELSE event_type END) AS idempotency_key FROM events)
    SELECT idempotency_key, arg_min(event_id, (ts, event_id)) AS import_id, count(*) - 1 AS repeats
    FROM keyed WHERE idempotency_key NOT IN (
      SELECT sha256('{"k": ' || c_custkey || '}' || chr(31) || 'click') FROM customer)
    GROUP BY idempotency_key"""

# Two versions of a schema per supplier: its open lines, then its closed ones. A part is
# a column, typed by its lowest return flag.
_TYPE = "CASE {0} WHEN 'A' THEN 'timestamptz' WHEN 'N' THEN 'decimal' ELSE 'string' END"


def _columns(spark, sf_dir, status, version):
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == status)
    return lines.groupBy(
        F.col("l_suppkey").alias("dataset_id"),
        F.concat(F.lit("c"), F.col("l_partkey")).alias("name"),
    ).agg(
        F.expr(_TYPE.format("min(l_returnflag)")).alias("type"),
        F.min("l_linenumber").alias("position"),
        F.lit(version).alias("version"),
    )


_COLUMNS = f"""(SELECT l_suppkey AS dataset_id, 'c' || l_partkey AS name,
      {_TYPE.format("min(l_returnflag)")} AS type, min(l_linenumber) AS position
    FROM lineitem WHERE l_linestatus = '{{0}}' GROUP BY ALL)"""
_SCHEMAS = f"before AS {_COLUMNS.format('O')}, after AS {_COLUMNS.format('F')}"
_ID = "sha256({0} || chr(31) || '{1}' || chr(31) || {2})"


def _continued(spark, sf_dir):
    previous = _columns(spark, sf_dir, "O", 1)
    previous = previous.withColumn(
        "column_id",
        schema.fresh_column_id(F.col("dataset_id").cast("string"), F.col("version"), F.col("name")),
    )
    return schema.column_continuity(_columns(spark, sf_dir, "F", 2), previous)


_CONTINUED = f"""{_SCHEMAS}, continued AS (SELECT a.dataset_id, 2 AS version, a.position, a.name, a.type,
      CASE WHEN b.type = a.type THEN {_ID.format("a.dataset_id", 1, "a.name")}
           ELSE {_ID.format("a.dataset_id", 2, "a.name")} END AS column_id
    FROM after a LEFT JOIN before b ON b.dataset_id = a.dataset_id AND b.name = a.name)"""

QUERIES["column_continuity"] = _continued
ORACLES["column_continuity"] = f"WITH {_CONTINUED} SELECT * FROM continued"


def _diff(spark, sf_dir):
    return schema.schema_diff(_columns(spark, sf_dir, "F", 2), _columns(spark, sf_dir, "O", 1))


QUERIES["schema_diff"] = _diff
ORACLES["schema_diff"] = f"""WITH {_SCHEMAS}
    SELECT dataset_id, name, b.type AS previous_type, a.type AS new_type,
      CASE WHEN b.type IS NULL THEN 'new' WHEN a.type IS NULL THEN 'removed'
           WHEN a.type = b.type THEN 'carried' ELSE 'revised' END AS continuity
    FROM after a FULL JOIN before b USING (dataset_id, name)"""

_USAGE = "CASE l_linenumber % 3 WHEN 0 THEN 'dimension' WHEN 1 THEN 'measure' ELSE 'filter' END"
_DETAIL = """CASE l_linenumber % 3
    WHEN 0 THEN CASE WHEN l_linestatus = 'O' THEN 'month' END
    WHEN 1 THEN CASE l_returnflag WHEN 'N' THEN 'sum' WHEN 'R' THEN 'min' ELSE 'count' END
    ELSE CASE l_returnflag WHEN 'N' THEN 'gt' WHEN 'R' THEN 'eq' ELSE 'between' END END"""


def _broken(spark, sf_dir):
    dataset, name = F.col("l_suppkey"), F.concat(F.lit("c"), F.col("l_partkey"))
    references = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("saved_query_id"),
        dataset.alias("dataset_id"),
        schema.fresh_column_id(dataset.cast("string"), F.lit(1), name).alias("column_id"),
        F.expr(_USAGE).alias("usage"),
        F.expr(_DETAIL).alias("detail"),
    )
    return schema.broken_queries(references, _continued(spark, sf_dir))


QUERIES["broken_queries"] = _broken
ORACLES["broken_queries"] = f"""WITH {_CONTINUED}, refs AS (SELECT l_orderkey AS saved_query_id,
      l_suppkey AS dataset_id, {_ID.format("l_suppkey", 1, "'c' || l_partkey")} AS column_id,
      {_USAGE} AS usage, {_DETAIL} AS detail FROM lineitem),
    judged AS (SELECT r.*, CASE WHEN c.type IS NULL THEN 'COLUMN_REMOVED'
      WHEN usage = 'dimension' AND detail IS NOT NULL AND c.type <> 'timestamptz' THEN 'TYPE_INCOMPATIBLE'
      WHEN usage = 'measure' AND detail = 'sum' AND c.type <> 'decimal' THEN 'TYPE_INCOMPATIBLE'
      WHEN usage = 'filter' AND detail IN ('gt', 'between') AND c.type = 'string'
        THEN 'TYPE_INCOMPATIBLE' END AS issue_code
      FROM refs r LEFT JOIN continued c ON c.dataset_id = r.dataset_id AND c.column_id = r.column_id)
    SELECT * FROM judged WHERE issue_code IS NOT NULL"""


# Every order stands for a saved question, kept as JSON.
_SPEC = """'{"datasetId":"sales","dimensions":[{"columnId":"' ||
    CASE o_orderstatus WHEN 'F' THEN 'plan' WHEN 'O' THEN 'gone' ELSE 'at' END ||
    '"}],"measures":[{"field":null,"aggregation":"count","alias":"n"},{"field":"' ||
    CASE WHEN o_orderkey % 2 = 0 THEN 'amount' ELSE 'plan' END ||
    '","aggregation":"sum","alias":"s"}],"filters":[{"columnId":"at","operator":"gt","value":"1996-01-01"}],' ||
    '"orderBy":[{"kind":"measure","ref":"' || CASE WHEN o_orderkey % 3 = 0 THEN 'n' ELSE 'x' END || '"}]}'"""


# One in eleven is missing, one in seven is cut off.
_STORED_SPEC = f"""CASE WHEN o_orderkey % 11 = 0 THEN NULL
    WHEN o_orderkey % 7 = 0 THEN left({_SPEC}, length({_SPEC}) - 9) ELSE {_SPEC} END"""


def _broken_saved(spark, sf_dir):
    saved = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("saved_query_id"), F.expr(_STORED_SPEC).alias("spec"))
    columns = spark.createDataFrame(
        [("sales", "plan", "string"), ("sales", "amount", "decimal"), ("sales", "at", "timestamptz")],
        "dataset_id string, column_id string, type string",
    )
    return schema.broken_queries(schema.references_of(saved), columns)


QUERIES["broken_saved_queries"] = _broken_saved
ORACLES["broken_saved_queries"] = """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0)
    SELECT o_orderkey AS saved_query_id, 'sales' AS dataset_id, 'gone' AS column_id, 'dimension' AS usage,
      NULL AS detail, 'COLUMN_REMOVED' AS issue_code FROM o WHERE o_orderstatus = 'O'
    UNION ALL SELECT o_orderkey, 'sales', 'plan', 'measure', 'sum', 'TYPE_INCOMPATIBLE' FROM o WHERE o_orderkey % 2 <> 0
    UNION ALL SELECT o_orderkey, 'sales', 'x', 'order', 'unresolved', 'ORDER_BY_UNRESOLVED' FROM o WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT o_orderkey, NULL, NULL, 'spec', NULL, 'SPEC_UNREADABLE' FROM orders
      WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 = 0"""


def _mixed(spark, sf_dir):
    return schema.mixed_unit_groups(sales(spark, sf_dir), ["customer_id"], "currency")


QUERIES["mixed_unit_groups"] = _mixed
ORACLES["mixed_unit_groups"] = f"""WITH {SALES}
    SELECT customer_id, count(DISTINCT currency) AS units, count(*) AS rows FROM sales
    GROUP BY customer_id HAVING count(DISTINCT currency) > 1"""


# The audit: an event is a run, its value the duration.
def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        F.col("value").alias("duration_ms"),
        F.expr("CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END").alias("status"),
    )


QUERIES["failed_count"] = lambda spark, sf_dir: audit.failed_count(_runs(spark, sf_dir))
ORACLES["failed_count"] = (
    "SELECT count(*) FILTER (event_type = 'error') AS failed_count FROM events"
)
QUERIES["failed_count_by_user"] = lambda spark, sf_dir: audit.failed_count(
    _runs(spark, sf_dir), ["user_id"]
)
ORACLES["failed_count_by_user"] = """SELECT user_id,
    count(*) FILTER (event_type = 'error') AS failed_count FROM events GROUP BY user_id"""


def _latency_sql(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    named = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""

    def placed(p: str) -> str:
        return f"max(cell) FILTER (i = least(n - 1, CAST(floor({p}::DOUBLE * n) AS BIGINT))) / 100.0::DOUBLE"

    return f"""WITH cells AS (SELECT *, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cell FROM events),
      placed AS (SELECT *, row_number() OVER ({part} ORDER BY cell) - 1 AS i,
        count(*) OVER ({part}) AS n FROM cells)
      SELECT {named}count(*) AS runs, arg_min(cell, (ts, event_id)) / 100.0::DOUBLE AS cold_ms,
        {placed("0.5")} AS p50_ms, {placed("0.95")} AS p95_ms,
        min(cell) / 100.0::DOUBLE AS min_ms, max(cell) / 100.0::DOUBLE AS max_ms FROM placed {group}"""


for _name, _by in (("latency_summary", "event_type"), ("latency_overall", "")):
    QUERIES[_name] = lambda spark, sf_dir, by=_by: audit.latency_summary(
        _runs(spark, sf_dir), started=["ts", "event_id"], by=[by] if by else []
    )
    QUERIES[_name].__name__ = _name
    ORACLES[_name] = _latency_sql(_by)

QUERIES["modal_value"] = lambda spark, sf_dir: audit.modal_value(
    table(spark, sf_dir, "orders"), "o_orderpriority"
)
ORACLES["modal_value"] = """SELECT o_orderpriority AS value, count(*) AS n FROM orders
    GROUP BY 1 ORDER BY n DESC, value LIMIT 1"""
