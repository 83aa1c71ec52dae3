"""CSV round trips: tables written out as files, then scanned, profiled and loaded."""

from __future__ import annotations

from contextlib import suppress
from dataclasses import replace

from pyspark.sql import functions as F

from ..errors import PlumblineError
from ..functions.casting import CellType
from ..operators.load import typed_load
from ..plans.importing import load_import, profile_import, stored_imports
from ..plans.report import SavedQuery, run_stored_query, stored_executions
from ..plans.spec import Dimension, Measure, QuerySpec
from ..session import scratch_path
from ..sources.csv import FIELD_COUNT, ROW_NUMBER, Ceilings, preview_rows, scan_csv
from ..sources.versions import VersionStore
from .tables import ZONE, portable, table

QUERIES = {}
ORACLES = {}


def _exported(spark, frame, name):
    """A frame as a folder of CSV files with a header each, quoting what needs it."""
    target = scratch_path(spark, name)
    frame.write.csv(
        target,
        header=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return target


def _csv_scan(spark, sf_dir):
    """Documents, most of which hold line breaks, some quotes."""
    path = _exported(spark, table(spark, sf_dir, "documents"), "documents-csv")
    return scan_csv(spark, path).cells()


QUERIES["csv_scan"] = _csv_scan
ORACLES["csv_scan"] = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source,
    CAST(n_chars AS VARCHAR) AS n_chars FROM documents"""

# Nations as columns named after their region: most names repeat, one is blank, one is quoted.
_CELL = """CASE n_nationkey WHEN 7 THEN ' ' WHEN 3 THEN 'Total, all'
    ELSE r_name || CASE WHEN n_nationkey % 2 = 0 THEN ' ' ELSE '' END END"""


def _csv_headers(spark, sf_dir):
    """The header of many files, resolved; and in how many rows of them each column is filled."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    cells = nations.select("n_nationkey", F.expr(_CELL).alias("cell")).orderBy("n_nationkey").collect()  # 25 nations
    header = ",".join(f'"{c.cell}"' if "," in c.cell else c.cell for c in cells)
    row = f"concat_ws(',', transform(sequence(0, {len(cells) - 1}), i -> if(i = c_nationkey, c_mktsegment, '')))"
    target = scratch_path(spark, "nations-csv")
    table(spark, sf_dir, "customer").repartition(4).select(F.expr(row).alias(header)).write.csv(
        target, header=True, sep="\x01", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    scan = scan_csv(spark, target)
    filled = scan.cells().agg(*[F.count_if(F.col(f"`{h.name}`") != "").alias(str(h.position)) for h in scan.header])
    counts = filled.unpivot([], list(filled.columns), "position", "filled").withColumn("position", F.col("position").cast("bigint"))
    names = spark.createDataFrame([(h.position, h.name, ",".join(h.issues)) for h in scan.header], "position bigint, name string, issues string")
    # As every file has it, not as the first one has it.
    found = scan.header_records().select(F.posexplode("cells").alias("place", "original_header")).distinct()
    found = found.select((F.col("place") + 1).cast("bigint").alias("position"), "original_header")
    return found.join(names, "position").join(counts, "position")


QUERIES["csv_headers"] = _csv_headers
ORACLES["csv_headers"] = f"""WITH h AS (
      SELECT n_nationkey + 1 AS position, {_CELL} AS cell, trim({_CELL}) AS name
      FROM nation JOIN region ON n_regionkey = r_regionkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY position) AS n FROM h)
    SELECT CAST(position AS BIGINT) AS position, cell AS original_header,
      CASE WHEN name = '' THEN 'column_' || position WHEN n > 1 THEN name || '_' || position ELSE name END AS name,
      CASE WHEN name = '' THEN 'blank_header' WHEN n > 1 THEN 'duplicate_header' ELSE '' END AS issues,
      (SELECT count(*) FROM customer WHERE c_nationkey + 1 = position) AS filled
    FROM r"""

# Customers as raw lines: one in eleven lacks its last field, one in eleven has one more.
_LINE = """c_custkey || ',' || c_name || ',' || c_nationkey || ',' || CAST(c_acctbal AS DECIMAL(18,2)) ||
    CASE c_custkey % 11 WHEN 3 THEN '' WHEN 5 THEN ',' || c_mktsegment || ',surplus'
    ELSE ',' || c_mktsegment END"""
_HEADER = "id,name,nation,balance,segment"


def _ragged(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").select(F.expr(_LINE).alias(_HEADER))
    target = scratch_path(spark, "customers-csv")
    # One column whose name is the header line and which is never split or quoted.
    lines.write.csv(target, header=True, sep="\x01", quote="")
    return scan_csv(spark, target)


def _field_count_check(spark, sf_dir):
    records = _ragged(spark, sf_dir).records()
    wrong = records.filter((F.col(FIELD_COUNT) != 5) & (F.col(ROW_NUMBER) >= 1))
    return wrong.select("id", "name", "segment", F.col(FIELD_COUNT).alias("actual"))


QUERIES["field_count_check"] = _field_count_check
ORACLES["field_count_check"] = """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
      CASE WHEN c_custkey % 11 = 5 THEN c_mktsegment END AS segment,
      CASE WHEN c_custkey % 11 = 3 THEN 4 ELSE 6 END AS actual
    FROM customer WHERE c_custkey % 11 IN (3, 5)"""

QUERIES["file_profile"] = lambda spark, sf_dir: _ragged(spark, sf_dir).file_profile().drop("bytes")
ORACLES["file_profile"] = """SELECT 5 AS column_count, count(*) AS rows_read,
    count(*) FILTER (c_custkey % 11 IN (3, 5)) AS rows_with_bad_field_count FROM customer"""

def _ceilings(spark, sf_dir):
    """Each bound at what the file has, which is allowed, and one below, which is refused."""
    lines = table(spark, sf_dir, "customer").select(F.expr(_LINE).alias(_HEADER))
    target = scratch_path(spark, "bounded-csv")
    lines.coalesce(1).write.csv(target, header=True, sep="\x01", quote="")
    scan = scan_csv(spark, target)
    measured = {"max_bytes": scan.size_bytes, "max_rows": scan.row_count, "max_columns": len(scan.header)}
    rows = []
    for name, value in measured.items():
        for bound in (value, value - 1):
            try:
                replace(scan, ceilings=Ceilings(**(dict.fromkeys(measured) | {name: bound}))).enforce_ceilings()
                rows.append((name, bound, None))
            except PlumblineError as error:
                rows.append((name, bound, str(error)))
    return spark.createDataFrame(rows, "ceiling string, bound bigint, refusal string")


QUERIES["ceilings"] = _ceilings
ORACLES["ceilings"] = f"""WITH m AS (
      SELECT 'max_bytes' AS ceiling, 'byte' AS unit, {len(_HEADER) + 1} + sum(strlen({_LINE}) + 1) AS measured FROM customer
      UNION ALL SELECT 'max_rows', 'row', count(*) FROM customer
      UNION ALL SELECT 'max_columns', 'column', 5)
    SELECT ceiling, CAST(measured - below AS BIGINT) AS bound, CASE below WHEN 1 THEN
      'File exceeds the ' || (measured - 1)::BIGINT || '-' || unit || ' limit (measured ' || measured::BIGINT || ' ' || unit || 's).' END AS refusal
    FROM m, (VALUES (0), (1)) b(below)"""

_CUSTOMER_TYPES = [
    CellType("id", "integer"),
    CellType("name", "string"),
    CellType("nation", "integer"),
    CellType("balance", "decimal", 2),
    CellType("segment", "string"),
]


def _stored(spark, sf_dir):
    """Customers loaded as a version, twice: the retry must end in the same rows."""
    store = VersionStore(spark, scratch_path(spark, "versions"))
    loaded = typed_load(
        _ragged(spark, sf_dir).records(),
        _CUSTOMER_TYPES,
        ZONE,
        F.col(ROW_NUMBER),
        F.col(FIELD_COUNT),
    )
    for repeated in (False, True):
        store.write_version("customers", 1, loaded, _CUSTOMER_TYPES, ZONE, replace=repeated)
    return store


QUERIES["version_write"] = lambda spark, sf_dir: portable(
    _stored(spark, sf_dir).read_version("customers")
)
ORACLES["version_write"] = """SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation,
      CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS balance,
      CASE WHEN c_custkey % 11 <> 3 THEN c_mktsegment END AS segment FROM customer"""


def _version_catalog(spark, sf_dir):
    store = _stored(spark, sf_dir)
    return store.versions().select(
        "dataset_id", "version_number", "status", "row_count", "rows_rejected", "column_count", "timezone"
    )


QUERIES["version_catalog"] = _version_catalog
ORACLES["version_catalog"] = f"""SELECT 'customers' AS dataset_id, CAST(1 AS BIGINT) AS version_number,
      'COMPLETED' AS status, count(*) AS row_count,
      count(*) FILTER (c_custkey % 11 IN (3, 5)) AS rows_rejected, CAST(5 AS BIGINT) AS column_count,
      '{ZONE}' AS timezone FROM customer"""


def _preview(spark, sf_dir):
    """The first 200 rows of the file, in its order."""
    return portable(preview_rows(_stored(spark, sf_dir).read_version("customers", with_source=True), 200))


QUERIES["preview_rows"] = _preview
ORACLES["preview_rows"] = f"{ORACLES['version_write']} ORDER BY c_custkey LIMIT 200"

# Events in two files: late ones have decimals of twelve places and ids that are no numbers.
_VALUE = "CASE WHEN event_id % 2 = 0 THEN CAST(CAST(value AS DECIMAL(18,2)) AS STRING) ELSE '0.111111111111' END"


def _end_to_end(spark, sf_dir):
    """Two CSV files, profiled, confirmed with an override, loaded, asked; and what the logs say."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS STRING) ELSE 'u' || user_id END AS user",
        "event_type AS kind", f"{_VALUE} AS amount", "event_id % 2 AS half",
    )
    folder = scratch_path(spark, "events-csv")
    for half in (0, 1):
        part = rows.where(f"half = {half}").drop("half")
        part.write.mode("append").csv(folder, header=True)
    store = VersionStore(spark, scratch_path(spark, "store"))
    proposed = profile_import(spark, folder)
    load_import(store, proposed, "events", ZONE, overrides={1: "string"})
    measures = [Measure("sum", "total", "amount"), Measure("count_distinct", "users", "user"), Measure("count", "rows")]
    ids = {f.name: f.metadata["column_id"] for f in store.read_version("events").schema}
    asked = [Measure(m.aggregation, m.alias, ids[m.field] if m.field else None) for m in measures]
    good = SavedQuery("q1", "By kind", QuerySpec("events", [Dimension(ids["kind"])], asked))
    bad = SavedQuery("q2", "Gone", QuerySpec("events", [Dimension("gone")], asked[2:]))
    answer = spark.createDataFrame(
        [(r[ids["kind"]], r["total"], int(r["users"]), int(r["rows"])) for r in run_stored_query(good, store, ZONE).rows],
        "kind string, total string, users bigint, rows bigint",
    )  # a handful of kinds of event
    with suppress(PlumblineError):
        run_stored_query(bad, store, ZONE)
    runs = stored_executions(store).select("saved_query_id", "status", "dataset_version", "row_count", "error_code")
    loads = stored_imports(store).select(F.lit("import"), "status", "version_number", "row_count", "error_code")
    logged = runs.union(loads).select(
        F.concat_ws(":", "saved_query_id", "status", "error_code").alias("kind"), F.lit(None).cast("string").alias("total"),
        F.col("dataset_version").alias("users"), F.col("row_count").alias("rows"),
    )
    return answer.unionByName(logged)


QUERIES["import_end_to_end"] = _end_to_end
ORACLES["import_end_to_end"] = """WITH e AS (
      SELECT CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'u' || user_id END AS user,
        event_type AS kind, CASE WHEN event_id % 2 = 0 THEN CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(38,12))
          ELSE 0.111111111111 END AS amount
      FROM events)
    SELECT kind, CAST(sum(amount) AS VARCHAR) AS total, count(DISTINCT user) AS users, count(*) AS rows FROM e GROUP BY kind
    UNION ALL SELECT 'q1:success', NULL, 1, count(DISTINCT kind) FROM e
    UNION ALL SELECT 'q2:failed:SCHEMA_INCOMPATIBLE', NULL, 1, NULL
    UNION ALL SELECT 'import:success', NULL, 1, count(*) FROM e"""
