"""Redaction over whole documents and over event properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.redaction import redact_json, redact_text
from .tables import dealt_out, table

QUERIES = {}
ORACLES = {}

# Every document gets a tail that holds one of each secret, made from its own columns.
_SECRETS = (
    "text || ' via https://u' || doc_id || ':p@host/x and postgres://db' || doc_id || '/main, "
    "Authorization: bearer ' || lang || '.tok-' || doc_id || ' from analytical.dv_' || n_chars || "
    "' or dv_' || n_chars || 'f, GET /a?api_key=' || source || doc_id || '&page=2 "
    "/reset-password/' || doc_id || lang || '?next=1'"
)
# The patterns of the library's rules in the oracle's spelling.
_S = r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_STEPS = (
    (rf"\b\w+://[^{_S}:@/]+:[^{_S}@]+@[^{_S}]+", "[REDACTED:connection-string]"),
    (
        rf"\b(jdbc:)?(postgres(ql)?|mysql|mongodb(\+srv)?|redis|amqp|mssql|mariadb)://[^{_S}]+",
        "[REDACTED:connection-string]",
    ),
    (rf"\bBearer[{_S}]+[A-Za-z0-9\-._~+/]+=*", "[REDACTED:bearer-token]"),
    (r"\banalytical\.[a-zA-Z_][a-zA-Z0-9_]*\b", "[REDACTED:analytical-schema]"),
    (r"\bdv_[0-9a-f]+\b", "[REDACTED:physical-id]"),
    (
        r"\b(api[_-]?key|token|secret|password|access[_-]?key|x-amz-signature|x-amz-credential"
        rf"|signature|sig)=[^&{_S}]+",
        r"\1=[REDACTED]",
    ),
    (rf"/reset-password/[^/?#{_S}]+", "/reset-password/[REDACTED]"),
)
_SPACED = (
    r"\b(api[_-]?key|token|secret|password|access[_-]?key|signature|sig)"
    rf"[{_S}]*=[{_S}]*\"[^\"]*\"",
    r'\1="[REDACTED]"',
)


def _chain(steps) -> str:
    sql = _SECRETS
    for pattern, replacement in steps:
        sql = f"regexp_replace({sql}, '{pattern}', '{replacement}', 'gi')"
    return sql


def _documents(spaced: bool):
    def query(spark, sf_dir):
        # Every text matches every rule here, so nothing is gained by looking before.
        text = F.expr(_SECRETS)
        return table(spark, sf_dir, "documents").select(
            "doc_id", redact_text(text, spaced_secrets=spaced).alias("text")
        )

    return query


QUERIES["redact_text"] = _documents(False)
ORACLES["redact_text"] = f"SELECT doc_id, {_chain(_STEPS)} AS text FROM documents"
QUERIES["redact_text_spaced"] = _documents(True)
ORACLES["redact_text_spaced"] = f"SELECT doc_id, {_chain((*_STEPS, _SPACED))} AS text FROM documents"

_PROPS = """'{"token": "t' || user_id || '", "rowCount": ' || (event_id % 10) || ', "rows": [' || user_id ||
    '], "kind": "' || event_type || '", "hint": "in dv_' || (event_id % 100) || '", "props": ' || props ||
    ', "list": [{"apiKey": ' || event_id || '}, ' || user_id || ', null, true]}'"""


def _props(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", redact_json(F.expr(_PROPS)).alias("props"))


QUERIES["redact_props"] = _props
ORACLES["redact_props"] = """SELECT event_id, '{"hint":"in [REDACTED:physical-id]","kind":"' || event_type ||
    '","list":[{"apiKey":"[REDACTED:credential]"},' || user_id || ',null,true],"props":' ||
    replace(props, ': ', ':') || ',"rowCount":' || (event_id % 10) ||
    ',"rows":"[REDACTED:dataset-content]","token":"[REDACTED:credential]"}' AS props FROM events"""

# Nested deeper than any parser follows, and longer than any column value that is parsed at once.
_DEEP = """repeat('{"l":', 1500) || '{"password":"hunter' || event_id || '"}' || repeat('}', 1500)"""
_LONG = """'{"note":"' || repeat('no secrets here, ', 500) || '","password":"hunter' || event_id || '","n":1.50}'"""
_BROKEN = """'{"kind":"' || event_type || '","token":"t' || event_id || '"'"""


def _extreme(spark, sf_dir):
    # A small file, from each of whose rows many times its size is made: read in one task, made in many.
    events = dealt_out(table(spark, sf_dir, "events").select("event_id", "event_type"))
    columns = {"deep": _DEEP, "long": _LONG, "broken": _BROKEN}
    return events.select("event_id", *[redact_json(F.expr(sql)).alias(n) for n, sql in columns.items()])


QUERIES["redact_extreme_props"] = _extreme
ORACLES["redact_extreme_props"] = """SELECT event_id,
    repeat('{"l":', 9) || '"[REDACTED:max-depth-exceeded]"' || repeat('}', 9) AS deep,
    '{"n":1.50,"note":"' || repeat('no secrets here, ', 500) || '","password":"[REDACTED:credential]"}' AS long,
    '{"kind":"' || event_type || '","token":"[REDACTED:credential]"' AS broken
    FROM events"""
