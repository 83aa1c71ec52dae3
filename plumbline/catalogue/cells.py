"""Grammar, profiling and typed load over events written out as dirty text.

Each event becomes a row of text cells, some spoiled in a fixed rhythm. The cells are
SQL that Spark and the oracle both read, so both start from the same text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grammar
from ..functions.casting import CellType
from ..functions.instants import explicit_instant, naive_wall, resolve_wall_clocks
from ..operators.load import import_errors, issue_counts, load_summary, typed_load, typed_rows
from ..operators.profile import column_profile, infer_schema, infer_types
from .tables import ZONE, instant_text, portable, table

QUERIES = {}
ORACLES = {}

_SPOIL = "CASE event_id % 37"
_SECONDS = "substr(CAST(ts AS STRING), 1, 19)"
_CELLS = {
    "qty": f"""{_SPOIL} WHEN 3 THEN 'N/A' WHEN 5 THEN '' WHEN 7 THEN '007' WHEN 11 THEN ' 42 '
        WHEN 13 THEN '9223372036854775808' WHEN 17 THEN '-0' WHEN 19 THEN '-9223372036854775808'
        ELSE CAST(user_id AS STRING) END""",
    "whole": "CAST(event_id AS STRING)",
    "amount": f"""{_SPOIL} WHEN 3 THEN 'N/A' WHEN 5 THEN '' WHEN 11 THEN '1,234.56'
        WHEN 13 THEN '1,234,567' WHEN 17 THEN '12' WHEN 19 THEN ' 7.5 '
        ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END""",
    "price": f"""{_SPOIL} WHEN 3 THEN '$1,234.56' WHEN 5 THEN '1e5' WHEN 7 THEN '0001234'
        WHEN 11 THEN '12,34.5' WHEN 13 THEN '.5' WHEN 17 THEN '5.' WHEN 19 THEN '+1'
        ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END""",
    "flag": f"""{_SPOIL} WHEN 3 THEN '1' WHEN 5 THEN '' ELSE CASE event_type
        WHEN 'view' THEN 'true' WHEN 'click' THEN 'NO' WHEN 'signup' THEN ' Yes '
        ELSE 'False' END END""",
    "day": f"""{_SPOIL} WHEN 3 THEN '2024-02-30' WHEN 5 THEN '' WHEN 7 THEN ' 2024-02-29 '
        ELSE CAST(CAST(ts AS DATE) AS STRING) END""",
    "moment": f"""{_SPOIL} WHEN 3 THEN '2024-03-10 02:30:00' WHEN 5 THEN '2024-11-03 01:30:00'
        WHEN 11 THEN '2024-02-30 10:00:00' WHEN 13 THEN {_SECONDS} || '.5'
        WHEN 17 THEN replace({_SECONDS}, ' ', 'T') || '-04:00'
        WHEN 19 THEN {_SECONDS} || '+05:30' WHEN 23 THEN '' ELSE
        CASE WHEN event_id % 2 = 0 THEN {_SECONDS}
             ELSE replace({_SECONDS}, ' ', 'T') || 'Z' END END""",
    "stamp": f"""{_SPOIL} WHEN 3 THEN '0099-01-01T00:00:00Z' WHEN 5 THEN '2024-01-01T24:00:00Z'
        WHEN 7 THEN 'not a time' WHEN 11 THEN '2024-01-01T10:60:00Z'
        WHEN 13 THEN '2024-01-01T10:00:00+24:00' WHEN 17 THEN '2024-01-01 10:00'
        ELSE replace({_SECONDS}, ' ', 'T') || 'Z' END""",
    "note": f"""{_SPOIL} WHEN 3 THEN '' WHEN 5 THEN '   ' ELSE props END""",
}
_NAMES = list(_CELLS)
_RAW = "raw AS (SELECT event_id, {} FROM events)".format(
    ", ".join(f"{sql} AS {name}" for name, sql in _CELLS.items())
)


def raw_cells(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", *[F.expr(sql).alias(name) for name, sql in _CELLS.items()]
    )


# The grammars again, in the oracle's words. All blanks in these cells are spaces.
_INTEGER = "regexp_full_match(trim({0}), '-?(0|[1-9][0-9]*)') AND TRY_CAST(trim({0}) AS BIGINT) IS NOT NULL"
_DECIMAL = (
    "regexp_full_match(trim({0}), '-?(0|[1-9][0-9]{{0,2}}(,[0-9]{{3}})*|[1-9][0-9]*)(\\.[0-9]+)?')"
)
_BOOLEAN = "lower(trim({0})) IN ('true', 'false', 'yes', 'no')"
_REAL_DAY = "TRY_CAST(substr(trim({0}), 1, 10) AS DATE) IS NOT NULL AND substr(trim({0}), 1, 2) <> '00'"
_DATE = "regexp_full_match(trim({0}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND " + _REAL_DAY
_DATETIME = (
    "regexp_full_match(trim({0}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ]([01][0-9]|2[0-3])"
    "(:[0-5][0-9]){{2}}(\\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?') AND " + _REAL_DAY
)
_OFFSET = "regexp_matches(trim({0}), '(Z|[+-][0-9][0-9]:[0-9][0-9])$')"
_GRAMMARS = {
    "integer": _INTEGER,
    "decimal": _DECIMAL,
    "boolean": _BOOLEAN,
    "date": _DATE,
    "timestamptz": _DATETIME,
}


def _predicate(name, cells, check):
    def query(spark, sf_dir):
        raw = raw_cells(spark, sf_dir)
        return raw.select("event_id", *[check(F.col(c)).alias(c) for c in cells])

    QUERIES[name] = query


for _type, _check in (
    ("integer", grammar.is_integer),
    ("decimal", grammar.is_decimal),
    ("boolean", grammar.is_boolean),
    ("date", grammar.is_date),
):
    _predicate(f"parse_{_type}", _NAMES, _check)
    ORACLES[f"parse_{_type}"] = "WITH {} SELECT event_id, {} FROM raw".format(
        _RAW, ", ".join(f"{_GRAMMARS[_type].format(c)} AS {c}" for c in _NAMES)
    )

_predicate("datetime_kind", ["moment", "stamp", "day", "note"], grammar.datetime_kind)
ORACLES["datetime_kind"] = "WITH {} SELECT event_id, {} FROM raw".format(
    _RAW,
    ", ".join(
        f"CASE WHEN {_DATETIME.format(c)} THEN CASE WHEN {_OFFSET.format(c)} "
        f"THEN 'explicit' ELSE 'naive' END END AS {c}"
        for c in ("moment", "stamp", "day", "note")
    ),
)


# Profile, type decision, proposed schema.
def _profile(spark, sf_dir):
    return column_profile(raw_cells(spark, sf_dir), _NAMES)


def _profile_row(position: int, name: str) -> str:
    def counted(condition):
        return f"count(*) FILTER ({condition.format(name)})"

    return f"""SELECT CAST({position} AS BIGINT) AS position, '{name}' AS name,
        {counted("{0} = ''")} AS empty_count, {counted("{0} <> ''")} AS non_empty_count,
        {counted(_INTEGER)} AS integer_matches, {counted(_DECIMAL)} AS decimal_matches,
        {counted(_BOOLEAN)} AS boolean_matches, {counted(_DATE)} AS date_matches,
        {counted(_DATETIME)} AS timestamptz_matches,
        {counted(_DATETIME + " AND " + _OFFSET)} AS explicit_count,
        {counted(_DATETIME + " AND NOT " + _OFFSET)} AS naive_count,
        coalesce(max(CASE WHEN {_DECIMAL.format(name)}
            THEN length(regexp_extract(trim({name}), '\\.([0-9]+)$', 1)) END), 0) AS max_scale
        FROM raw"""


_PROFILE = "{}, profile AS ({})".format(
    _RAW, " UNION ALL ".join(_profile_row(i, n) for i, n in enumerate(_NAMES, start=1))
)
_REACHED = "(non_empty_count > 0 AND {0}_matches * 20 >= non_empty_count * 19)"
_TYPED = f"""{_PROFILE}, typed AS (SELECT *, CASE
    WHEN integer_matches = decimal_matches AND {_REACHED.format("integer")} THEN 'integer'
    WHEN {_REACHED.format("decimal")} THEN 'decimal' WHEN {_REACHED.format("boolean")} THEN 'boolean'
    WHEN {_REACHED.format("date")} THEN 'date' WHEN {_REACHED.format("timestamptz")} THEN 'timestamptz'
    ELSE 'string' END AS type FROM profile)"""

QUERIES["column_profile"] = _profile
ORACLES["column_profile"] = f"WITH {_PROFILE} SELECT * FROM profile"

QUERIES["infer_types"] = lambda spark, sf_dir: infer_types(_profile(spark, sf_dir))
ORACLES["infer_types"] = f"WITH {_TYPED} SELECT position, name, type FROM typed"

QUERIES["infer_schema"] = lambda spark, sf_dir: infer_schema(_profile(spark, sf_dir))
ORACLES["infer_schema"] = f"""WITH {_TYPED}, missed AS (SELECT *, non_empty_count - CASE type
        WHEN 'integer' THEN integer_matches WHEN 'decimal' THEN decimal_matches
        WHEN 'boolean' THEN boolean_matches WHEN 'date' THEN date_matches
        WHEN 'timestamptz' THEN timestamptz_matches ELSE non_empty_count END AS unparseable FROM typed)
    SELECT position, name, type, empty_count > 0 OR unparseable > 0 AS nullable,
        unparseable AS unparseable_count,
        CASE WHEN type = 'timestamptz' THEN CASE WHEN explicit_count > 0 AND naive_count > 0 THEN 'mixed'
            WHEN explicit_count > 0 THEN 'explicit' ELSE 'naive' END END AS datetime_offset,
        CASE WHEN type = 'decimal' THEN max_scale END AS decimal_scale FROM missed"""


# Typed load.
_TYPES = {
    "qty": "integer",
    "whole": "integer",
    "amount": "decimal",
    "price": "decimal",
    "flag": "boolean",
    "day": "date",
    "moment": "timestamptz",
    "stamp": "timestamptz",
    "note": "string",
}
_CELL_TYPES = [CellType(name, _TYPES[name]) for name in _NAMES]


def _loaded(spark, sf_dir):
    return typed_load(raw_cells(spark, sf_dir), _CELL_TYPES, ZONE, F.col("event_id"))


# Every naive cell is in January 2024 (offset -5h) but for the two spoiled ones, whose
# instants and classes are written out.
def _instant(cell: str) -> str:
    text = f"trim({cell})"
    wall = f"CAST(replace(substr({text}, 1, 19), 'T', ' ') AS TIMESTAMP)"
    sign = f"CASE WHEN substr({text}, -6, 1) = '-' THEN 1 ELSE -1 END"
    shift = (
        f"to_minutes({sign} * (60 * CAST(substr({text}, -5, 2) AS INTEGER) "
        f"+ CAST(substr({text}, -2, 2) AS INTEGER)))"
    )
    return f"""CASE WHEN NOT ({_DATETIME.format(cell)}) THEN NULL
        WHEN {text} LIKE '%Z' THEN {wall}
        WHEN {_OFFSET.format(cell)} THEN {wall} + {shift}
        WHEN {text} LIKE '2024-03-10 02:30:00%' THEN TIMESTAMP '2024-03-10 07:30:00'
        WHEN {text} LIKE '2024-11-03 01:30:00%' THEN TIMESTAMP '2024-11-03 05:30:00'
        ELSE {wall} + INTERVAL 5 HOUR END"""


def _exact(cell: str) -> str:
    number = f"CAST(replace(trim({cell}), ',', '') AS DECIMAL(38,10))"
    return f"CASE WHEN {_DECIMAL.format(cell)} THEN CAST({number} AS VARCHAR) END"


QUERIES["typed_cast"] = lambda spark, sf_dir: portable(typed_rows(_loaded(spark, sf_dir)))
ORACLES["typed_cast"] = f"""WITH {_RAW} SELECT event_id,
    CASE WHEN {_INTEGER.format("qty")} THEN CAST(trim(qty) AS BIGINT) END AS qty,
    CAST(whole AS BIGINT) AS whole, {_exact("amount")} AS amount, {_exact("price")} AS price,
    CASE WHEN {_BOOLEAN.format("flag")} THEN lower(trim(flag)) IN ('true', 'yes') END AS flag,
    CASE WHEN {_DATE.format("day")} THEN trim(day) END AS day,
    {instant_text(_instant("moment"))} AS moment, {instant_text(_instant("stamp"))} AS stamp,
    NULLIF(note, '') AS note FROM raw"""

_MISSED = {
    "qty": _INTEGER,
    "amount": _DECIMAL,
    "price": _DECIMAL,
    "flag": _BOOLEAN,
    "day": _DATE,
    "moment": _DATETIME,
    "stamp": _DATETIME,
}
_ISSUE_ROWS = [
    f"""SELECT event_id AS row_number, '{c}' AS column_name, 'UNPARSEABLE_VALUE' AS error_code,
        'Value in column "{c}" could not be parsed as {_TYPES[c]}.' AS message
        FROM raw WHERE {c} <> '' AND NOT ({check.format(c)})"""
    for c, check in _MISSED.items()
] + [
    """SELECT event_id, 'moment', 'NONEXISTENT_LOCAL_TIME', 'Value in column "moment" is a local time
that does not exist during a DST spring-forward; resolved forward.'
       FROM raw WHERE moment = '2024-03-10 02:30:00'""".replace("time\nthat", "time that"),
    """SELECT event_id, 'moment', 'AMBIGUOUS_LOCAL_TIME', 'Value in column "moment" is an ambiguous
local time during a DST fall-back; resolved to the earlier instant.'
       FROM raw WHERE moment = '2024-11-03 01:30:00'""".replace("ambiguous\nlocal", "ambiguous local"),
]
_ISSUES = f"{_RAW}, issues AS ({' UNION ALL '.join(_ISSUE_ROWS)})"

QUERIES["import_errors"] = lambda spark, sf_dir: import_errors(_loaded(spark, sf_dir))
ORACLES["import_errors"] = f"WITH {_ISSUES} SELECT * FROM issues"

QUERIES["issue_counts"] = lambda spark, sf_dir: issue_counts(import_errors(_loaded(spark, sf_dir)))
ORACLES["issue_counts"] = (
    f"WITH {_ISSUES} SELECT error_code, count(*) AS issue_count FROM issues GROUP BY error_code"
)


def _summary(spark, sf_dir):
    summary = load_summary(_loaded(spark, sf_dir).drop("event_id"))
    return summary.withColumn("nullable_columns", F.concat_ws(",", "nullable_columns"))


QUERIES["load_summary"] = _summary
ORACLES["load_summary"] = f"""WITH {_ISSUES}, nulls AS (
      SELECT 1 AS i, 'qty' AS name, bool_or(qty = '' OR NOT ({_INTEGER.format("qty")})) AS has FROM raw
      UNION ALL SELECT 3, 'amount', bool_or(amount = '' OR NOT ({_DECIMAL.format("amount")})) FROM raw
      UNION ALL SELECT 4, 'price', bool_or(NOT ({_DECIMAL.format("price")})) FROM raw
      UNION ALL SELECT 5, 'flag', bool_or(flag = '' OR NOT ({_BOOLEAN.format("flag")})) FROM raw
      UNION ALL SELECT 6, 'day', bool_or(day = '' OR NOT ({_DATE.format("day")})) FROM raw
      UNION ALL SELECT 7, 'moment', bool_or(moment = '' OR NOT ({_DATETIME.format("moment")})) FROM raw
      UNION ALL SELECT 8, 'stamp', bool_or(NOT ({_DATETIME.format("stamp")})) FROM raw
      UNION ALL SELECT 9, 'note', bool_or(note = '') FROM raw)
    SELECT (SELECT count(*) FROM raw) AS rows_imported,
           (SELECT count(DISTINCT row_number) FROM issues) AS rows_rejected,
           (SELECT string_agg(name, ',' ORDER BY i) FROM nulls WHERE has) AS nullable_columns"""


# Instants, on event times moved into the weeks of both transitions of 2024.
def _explicit(spark, sf_dir):
    raw = raw_cells(spark, sf_dir)
    return portable(
        raw.select("event_id", *[explicit_instant(F.col(c)).alias(c) for c in ("moment", "stamp")])
    )


QUERIES["explicit_instant"] = _explicit
ORACLES["explicit_instant"] = "WITH {} SELECT event_id, {} FROM raw".format(
    _RAW,
    ", ".join(
        f"CASE WHEN {_OFFSET.format(c)} THEN {instant_text(_instant(c))} END AS {c}"
        for c in ("moment", "stamp")
    ),
)

_SHIFTS = {"spring": 60, "fall": 285}


def naive_instant(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    moved = events.select(
        "event_id",
        *[
            F.expr(f"substr(CAST(ts + INTERVAL {days} DAY AS STRING), 1, 19)").alias(name)
            for name, days in _SHIFTS.items()
        ],
    )
    walls = moved.withColumns({f"{n}_wall": naive_wall(F.col(n)) for n in _SHIFTS})
    resolved = resolve_wall_clocks(walls, {f"{n}_local": f"{n}_wall" for n in _SHIFTS}, ZONE)
    return portable(
        resolved.select(
            "event_id",
            *[F.col(f"{n}_local.instant").alias(f"{n}_instant") for n in _SHIFTS],
            *[F.col(f"{n}_local.kind").alias(f"{n}_kind") for n in _SHIFTS],
        )
    )


QUERIES["naive_instant"] = naive_instant
ORACLES["naive_instant"] = f"""WITH moved AS (SELECT event_id,
        date_trunc('second', ts + INTERVAL 60 DAY) AS spring,
        date_trunc('second', ts + INTERVAL 285 DAY) AS fall FROM events)
    SELECT event_id,
      {instant_text('''spring + CASE WHEN spring < TIMESTAMP '2024-03-10 03:00:00' THEN INTERVAL 5 HOUR
        ELSE INTERVAL 4 HOUR END''')} AS spring_instant,
      {instant_text('''fall + CASE WHEN fall < TIMESTAMP '2024-11-03 02:00:00' THEN INTERVAL 4 HOUR
        ELSE INTERVAL 5 HOUR END''')} AS fall_instant,
      CASE WHEN spring >= TIMESTAMP '2024-03-10 02:00:00' AND spring < TIMESTAMP '2024-03-10 03:00:00'
        THEN 'nonexistent' ELSE 'ok' END AS spring_kind,
      CASE WHEN fall >= TIMESTAMP '2024-11-03 01:00:00' AND fall < TIMESTAMP '2024-11-03 02:00:00'
        THEN 'ambiguous' ELSE 'ok' END AS fall_kind
    FROM moved"""
