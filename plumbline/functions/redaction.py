"""Taking secrets, physical table ids and dataset content out of text and JSON columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.json_text import json_redacted, marker_of
from plumbline.functions.redaction_rules import MAX_DEPTH, SPACED_SECRET_RULE, TEXT_RULES

#: For each rule, strings of which its matches hold one, in lower case. Looking for a plain
#: string is many times cheaper than looking for a pattern.
_NEEDED = (
    ("://",),
    ("://",),
    ("bearer",),
    ("analytical.",),
    ("dv_",),
    ("key=", "token=", "secret=", "password=", "signature=", "credential=", "sig="),
    ("/reset-password/",),
)

def redact_text(text: Column, spaced_secrets: bool = False) -> Column:
    """A text with every rule applied to all of it, in order.

    One chain of replacements, which compiles. :func:`redact_columns` is faster on a frame, as
    it passes over the rules that a text cannot match.
    """
    return reduce(lambda done, rule: _replaced(done, rule[0]), _rules(spaced_secrets), text)


def _rules(spaced_secrets: bool) -> list:
    rules = list(zip(TEXT_RULES, _NEEDED, strict=True))
    return [*rules, (SPACED_SECRET_RULE, ('"',))] if spaced_secrets else rules


def _replaced(text: Column, rule: tuple[str, str]) -> Column:
    return F.regexp_replace(text, f"(?i){rule[0]}", rule[1])


def redacted_texts(df: DataFrame, names: Sequence[str], spaced_secrets: bool = False) -> DataFrame:
    """The named text columns redacted in place, rule by rule in stages of their own.

    What a rule's matches hold is looked for in the text first, as a plain string. A rule puts in
    nothing that a later one needs, so the text is looked at once.
    """
    rules = _rules(spaced_secrets)
    staged = df.withColumns({f"_lowered_{i}": F.lower(F.col(f"`{n}`")) for i, n in enumerate(names)})
    staged = staged.withColumns(
        {
            f"_suspect_{i}_{j}": reduce(or_, [F.col(f"_lowered_{i}").contains(part) for part in needed])
            for i in range(len(names))
            for j, (_, needed) in enumerate(rules)
        }
    )
    for j, (rule, _) in enumerate(rules):
        staged = staged.withColumns(
            {
                name: F.when(F.col(f"_suspect_{i}_{j}"), _replaced(F.col(f"`{name}`"), rule)).otherwise(F.col(f"`{name}`"))
                for i, name in enumerate(names)
            }
        )
    return staged.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def key_marker(key: Column) -> Column:
    """The marker that replaces whatever is under a key, or null to look at the value."""

    def run(keys: pd.Series) -> pd.Series:
        return pd.Series([None if k is None else marker_of(k) for k in keys], dtype=object)

    return F.pandas_udf(run, "string")(key)


def redact_json(text: Column, max_depth: int = MAX_DEPTH) -> Column:
    """A JSON text with its keys and values redacted at every level, as JSON again.

    A value under a credential or content key is replaced whole, whatever it is; every
    other string is treated like free text. Below ``max_depth`` levels nothing is looked
    at, so nothing is let through, however deep or large the text is. Object keys come back in
    alphabetical order, of a repeated key the last value; numbers keep their digits.

    A text that is not JSON is free text, but closed: from the first quoted key on whose
    value would be replaced, the rest of it goes, as nothing tells where the value ends.
    """

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else json_redacted(t, max_depth) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


def redact_columns(
    df: DataFrame, text: tuple[str, ...] = (), json: tuple[str, ...] = ()
) -> DataFrame:
    """A frame with the named text and JSON columns redacted in place."""
    return redacted_texts(df, text).withColumns({n: redact_json(F.col(f"`{n}`")) for n in json})
