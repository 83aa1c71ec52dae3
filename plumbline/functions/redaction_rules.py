"""What redaction looks for and what replaces it."""

from __future__ import annotations

# Markers.
CONNECTION_STRING = "[REDACTED:connection-string]"
BEARER_TOKEN = "[REDACTED:bearer-token]"
TABLE_SCHEMA = "[REDACTED:analytical-schema]"
PHYSICAL_ID = "[REDACTED:physical-id]"
DATASET_CONTENT = "[REDACTED:dataset-content]"
CREDENTIAL = "[REDACTED:credential]"
DEPTH_EXCEEDED = "[REDACTED:max-depth-exceeded]"
MAX_DEPTH = 8

# The class ECMAScript calls \s, and its ASCII word boundary, spelled
# out because Java and Python mean other characters by both.
_S = "\\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_NOT_AFTER_WORD = "(?<![A-Za-z0-9_])"
_NOT_BEFORE_WORD = "(?![A-Za-z0-9_])"

# What is looked for, in the order it is looked for, and what replaces it.
TEXT_RULES = (
    # any scheme with user:password@ in it
    (rf"{_NOT_AFTER_WORD}\w++://[^{_S}:@/]+:[^{_S}@]+@[^{_S}]+", CONNECTION_STRING),
    # a database scheme, with or without credentials
    (
        rf"{_NOT_AFTER_WORD}(?:jdbc:)?(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|mssql"
        rf"|mariadb)://[^{_S}]+",
        CONNECTION_STRING,
    ),
    (rf"{_NOT_AFTER_WORD}Bearer[{_S}]+[A-Za-z0-9\-._~+/]+=*", BEARER_TOKEN),
    # schema-qualified and bare physical table ids
    (rf"{_NOT_AFTER_WORD}analytical\.[a-zA-Z_][a-zA-Z0-9_]*{_NOT_BEFORE_WORD}", TABLE_SCHEMA),
    (rf"{_NOT_AFTER_WORD}dv_[0-9a-f]+{_NOT_BEFORE_WORD}", PHYSICAL_ID),
    # key=value, as in a query string
    (
        rf"{_NOT_AFTER_WORD}(api[_-]?key|token|secret|password|access[_-]?key|x-amz-signature"
        rf"|x-amz-credential|signature|sig)=[^&{_S}]+",
        "$1=[REDACTED]",
    ),
    # a one-time token that is a path segment
    (rf"/reset-password/[^/?#{_S}]+", "/reset-password/[REDACTED]"),
)
# The form documents carry: token = "..." with blanks around the sign and quotes.
SPACED_SECRET_RULE = (
    rf"{_NOT_AFTER_WORD}(api[_-]?key|token|secret|password|access[_-]?key|signature|sig)"
    rf"[{_S}]*=[{_S}]*\"[^\"]*\"",
    '$1="[REDACTED]"',
)

# Words of a key that name dataset content, words beside them that make
# the key harmless (rowCount), and pieces of a key that name a credential.
CONTENT_WORDS = ("row", "rows", "value", "values", "csv", "cell", "cells", "data", "payload")
HARMLESS_WORDS = (
    "count",
    "index",
    "idx",
    "id",
    "ids",
    "at",
    "timestamp",
    "url",
    "uri",
    "name",
    "label",
    "type",
    "kind",
    "status",
    "code",
    "number",
    "num",
    "total",
    "size",
    "length",
    "version",
    "ms",
    "seconds",
    "duration",
)
CREDENTIAL_PIECES = (
    "password",
    "passwd",
    "secret",
    "token",
    "apikey",
    "cookie",
    "authorization",
    "dsn",
    "bearer",
    "accesskey",
    "privatekey",
    "connectionstring",
)
