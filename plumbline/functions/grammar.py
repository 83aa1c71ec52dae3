"""Which strings count as a number, a flag, a day or a date-time.

The same predicates decide the type of a column and gate every cell at load, so
a value counted as a match is always loadable. All of them are Column
expressions; every one is false, never null, for a null cell. The ``*_text``
forms take a text that is trimmed already, the ``is_*`` forms a raw cell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted grammars. ``\A``/``\z`` because Java's ``$`` also
# matches before a final newline.
INTEGER_PATTERN = r"\A-?(?:0|[1-9][0-9]*)\z"
DECIMAL_PATTERN = r"\A-?(?:0|[1-9][0-9]{0,2}(?:,[0-9]{3})*|[1-9][0-9]*)(?:\.[0-9]+)?\z"
DATE_PATTERN = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DATETIME_PATTERN = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"
    r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?"
    r"(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?\z"
)
TRUE_LITERALS = ("true", "yes")
FALSE_LITERALS = ("false", "no")
# What ECMAScript's trim() removes, wider than Spark's single space.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trimmed(cell: Column) -> Column:
    return F.trim(cell, F.lit(WHITESPACE))


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _real_day(text: Column) -> Column:
    """The first ten characters name a day on the calendar, in year 100 or later."""
    day = F.substring(text, 1, 10)
    return day.try_cast("date").isNotNull() & (F.substring(text, 1, 2) != "00")


def fits_bigint(digits: Column) -> Column:
    """Whether a whole number fits 64 bits. Only long ones are converted to find out,
    since a conversion that fails is many times dearer than one that does not."""
    return (F.length(digits) <= 18) | digits.try_cast("bigint").isNotNull()


def integer_text(text: Column) -> Column:
    return _holds(text.rlike(INTEGER_PATTERN) & fits_bigint(text))


def decimal_text(text: Column) -> Column:
    return _holds(text.rlike(DECIMAL_PATTERN))


def boolean_text(text: Column) -> Column:
    return _holds(F.lower(text).isin(*TRUE_LITERALS, *FALSE_LITERALS))


def date_text(text: Column) -> Column:
    return _holds(text.rlike(DATE_PATTERN) & _real_day(text))


def datetime_text(text: Column) -> Column:
    return _holds(text.rlike(DATETIME_PATTERN) & _real_day(text))


def has_offset(text: Column) -> Column:
    """Whether a string already known to be a date-time names its own offset."""
    return text.endswith("Z") | F.substring(text, -6, 1).isin("+", "-")


def is_integer(cell: Column) -> Column:
    return integer_text(trimmed(cell))


def is_decimal(cell: Column) -> Column:
    return decimal_text(trimmed(cell))


def is_boolean(cell: Column) -> Column:
    return boolean_text(trimmed(cell))


def is_date(cell: Column) -> Column:
    return date_text(trimmed(cell))


def datetime_kind(cell: Column) -> Column:
    """``explicit``, ``naive``, or null for anything that is not a date-time."""
    text = trimmed(cell)
    return F.when(
        datetime_text(text),
        F.when(has_offset(text), F.lit("explicit")).otherwise(F.lit("naive")),
    )
