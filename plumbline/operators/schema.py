"""Comparing the columns of dataset versions, and saved questions against them.

Column tables have one row per column: ``dataset_id, name, type`` and, where it is
known, ``column_id``. All datasets are compared in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fence import fence
from ..model import AGGREGATIONS_BY_TYPE, FILTERS_BY_TYPE, TIMESTAMPTZ


def fresh_column_id(dataset: Column, version: Column, name: Column) -> Column:
    """A new opaque id. Derived, not random, so a retried load mints the same one."""
    return F.sha2(F.concat_ws("\x1f", dataset, version.cast("string"), name), 256)


def column_continuity(new: DataFrame, previous: DataFrame) -> DataFrame:
    """Give the new version's columns their ids.

    A column keeps its id only while its exact name and its type are unchanged;
    otherwise it gets a fresh one. ``new`` carries ``dataset_id, version, position,
    name, type``.
    """
    before = previous.select(
        "dataset_id", "name", F.col("type").alias("_type"), F.col("column_id").alias("_column_id")
    )
    kept = F.when(F.col("_type") == F.col("type"), F.col("_column_id"))
    fresh = fresh_column_id(F.col("dataset_id"), F.col("version"), F.col("name"))
    return (
        new.join(before, ["dataset_id", "name"], "left")
        .withColumn("column_id", F.coalesce(kept, fresh))
        .select("dataset_id", "version", "position", "name", "type", "column_id")
    )


def schema_diff(new: DataFrame, previous: DataFrame) -> DataFrame:
    """What became of every column between two versions: carried, new, revised or removed."""
    after = new.select("dataset_id", "name", F.col("type").alias("new_type"))
    before = previous.select("dataset_id", "name", F.col("type").alias("previous_type"))
    state = (
        F.when(F.col("previous_type").isNull(), F.lit("new"))
        .when(F.col("new_type").isNull(), F.lit("removed"))
        .when(F.col("new_type") == F.col("previous_type"), F.lit("carried"))
        .otherwise(F.lit("revised"))
    )
    return after.join(before, ["dataset_id", "name"], "full").select(
        "dataset_id", "name", "previous_type", "new_type", state.alias("continuity")
    )


def broken_queries(references: DataFrame, columns: DataFrame) -> DataFrame:
    """Every reference of every saved question that its dataset can no longer serve.

    ``references`` has ``saved_query_id, dataset_id, column_id, usage, detail`` with
    usage ``dimension`` (detail: granularity or null), ``measure`` (detail:
    aggregation) or ``filter`` (detail: operator). ``columns`` are the current ones.

    Every reference meets its column in one join. Only what can be broken is moved for it, with
    ids as short as they can be without loss; a reference that names no column, or no dataset,
    is dealt out, as it meets nothing. Hot columns are left to adaptive execution.
    """
    ask = ["dataset_id", "column_id", "usage", "detail"]
    # A count of all rows names no column; an order names something that the question itself has.
    counts_all = (F.col("usage") == "measure") & (F.col("detail") == "count") & F.col("column_id").isNull()
    ordering = F.col("usage") == "order"
    fine = counts_all | (ordering & ~F.col("detail").eqNullSafe(UNRESOLVED))
    code = (
        F.when(F.col("usage") == SPEC, F.lit("SPEC_UNREADABLE"))
        .when(ordering, F.lit("ORDER_BY_UNRESOLVED"))
        .when(F.col("_type").isNull(), F.lit("COLUMN_REMOVED"))
        .when(~_supported(), F.lit("TYPE_INCOMPATIBLE"))
    )
    short, long = _id_forms(references, columns)
    nowhere = F.col("dataset_id").isNull() | F.col("column_id").isNull()
    asked = references.filter(~F.coalesce(fine, F.lit(False))).select(
        "saved_query_id",
        "dataset_id",
        short(F.col("column_id")).alias("column_id"),
        F.when(nowhere, F.xxhash64("saved_query_id")).otherwise(F.lit(0).cast("bigint")).alias("_share"),
        "usage",
        "detail",
    )
    # The ids are fenced, as a filter on them would mint them all again.
    current = columns.select(
        "dataset_id", fence(short(F.col("column_id"))).alias("column_id"), F.col("type").alias("_type")
    )
    # A plain zero would be folded out of the join's keys.
    nothing = F.when(F.col("column_id").isNotNull(), F.lit(0).cast("bigint"))
    current = current.withColumn("_share", nothing)
    return (
        asked.join(current, ["dataset_id", "column_id", "_share"], "left")
        .withColumn("issue_code", code)
        .filter(F.col("issue_code").isNotNull())
        .withColumn("column_id", long(F.col("column_id")))
        .select("saved_query_id", *ask, "issue_code")
    )


def _id_forms(*frames: DataFrame) -> tuple:
    """How column ids are put shorter to be moved, and back. No two ids have the same short form.

    The ids this library mints (:func:`fresh_column_id`) are 64 hexadecimal digits, which are 32
    bytes. Any other text keeps its bytes, one more if it has 32 or more of them.
    """
    if any(frame.schema["column_id"].dataType != T.StringType() for frame in frames):
        return (lambda column_id: column_id,) * 2

    def short(column_id: Column) -> Column:
        minted = (F.length(column_id) == 64) & (F.lower(F.hex(F.unhex(column_id))) == column_id)
        plain = column_id.cast("binary")
        other = F.when(F.octet_length(plain) < 32, plain).otherwise(F.concat(plain, F.lit(b"\0")))
        return F.when(minted, F.unhex(column_id)).otherwise(other)

    def long(packed: Column) -> Column:
        size = F.octet_length(packed)
        plain = F.when(size < 32, packed).otherwise(F.substring(packed, F.lit(1), size - 1))
        return F.when(size == 32, F.lower(F.hex(packed))).otherwise(plain.cast("string"))

    return short, long


_SPEC = (
    "struct<datasetId: string, dimensions: array<struct<columnId: string, granularity: string>>, "
    "measures: array<struct<field: string, aggregation: string, alias: string>>, "
    "filters: array<struct<columnId: string, operator: string>>, "
    "orderBy: array<struct<kind: string, ref: string>>, _unread: string>"
)
_READING = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"}


def references_of(saved_queries: DataFrame) -> DataFrame:
    """What each saved question asks of which column, as ``broken_queries`` wants it.

    ``saved_queries`` has ``saved_query_id`` and ``spec``, the question as JSON. An order whose
    ``ref`` is neither a grouped column nor a measure's alias has the detail ``unresolved``. A
    question that is missing, cut off or names no dataset is one reference of the usage ``spec``.
    """
    read = saved_queries.select("saved_query_id", F.from_json("spec", _SPEC, _READING).alias("q"))
    asked = read.select("saved_query_id", "q.*")
    unread = F.col("_unread").isNotNull() | F.col("datasetId").isNull()

    def entry(usage: str, column_id: Column, detail: Column) -> Column:
        return F.struct(column_id.alias("column_id"), F.lit(usage).alias("usage"), detail.alias("detail"))

    def listed(items: str, each) -> Column:
        return F.coalesce(F.transform(items, each), F.array().cast(ENTRIES))

    groups = F.transform(F.coalesce("dimensions", F.array().cast("array<struct<columnId:string,granularity:string>>")), lambda d: d["columnId"])
    measures = F.coalesce("measures", F.array().cast("array<struct<field:string,aggregation:string,alias:string>>"))
    aliases = F.transform(measures, lambda m: m["alias"])

    def resolved(order: Column) -> Column:
        known = F.when(order["kind"] == "measure", F.array_contains(aliases, order["ref"])).otherwise(
            F.array_contains(groups, order["ref"])
        )
        return F.when(~F.coalesce(known, F.lit(False)), F.lit(UNRESOLVED))

    entries = F.concat(
        listed("dimensions", lambda d: entry("dimension", d["columnId"], d["granularity"])),
        listed("measures", lambda m: entry("measure", m["field"], m["aggregation"])),
        listed("filters", lambda f: entry("filter", f["columnId"], f["operator"])),
        listed("orderBy", lambda o: entry("order", o["ref"], resolved(o))),
    )
    nothing = F.lit(None).cast("string")
    entries = F.when(unread, F.array(entry(SPEC, nothing, nothing))).otherwise(entries)
    return asked.withColumn("datasetId", F.when(~unread, F.col("datasetId"))).select("saved_query_id", F.col("datasetId").alias("dataset_id"), F.explode(entries).alias("e")).select(
        "saved_query_id", "dataset_id", "e.*"
    )


def _supported() -> Column:
    """Whether the joined column type supports what the reference asks of it."""
    usage, detail, column_type = F.col("usage"), F.col("detail"), F.col("_type")

    def allowed(table) -> Column:
        pairs = [f"{t}:{name}" for t, names in table.items() for name in names]
        return F.concat_ws(":", column_type, detail).isin(*pairs)

    return (
        F.when(usage == "dimension", detail.isNull() | (column_type == TIMESTAMPTZ))
        .when(usage == "measure", allowed(AGGREGATIONS_BY_TYPE))
        .otherwise(allowed(FILTERS_BY_TYPE))
    )


#: The usage of a question that cannot be read.
SPEC = "spec"
#: The detail of an order by something that the question does not have.
UNRESOLVED = "unresolved"
ENTRIES = "array<struct<column_id:string,usage:string,detail:string>>"


def mixed_unit_groups(table: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Groups whose rows are in more than one unit, so that no total over them holds.

    The data-level companion of the single-currency refusal. Rows are folded to one per
    group and unit before a group is looked at as a whole.
    """
    return (
        table.groupBy(*keys)
        .agg(F.count_distinct(F.col(unit)).alias("units"), F.count(F.lit(1)).alias("rows"))
        .filter(F.col("units") > 1)
    )
