"""Questions about datasets, versions, imports and saved queries, for all tenants at once.

Frames carry these columns:

* datasets: ``organization_id, dataset_id, dataset_name, created_at, current_version_id``
* versions: ``version_id, dataset_id, version_number, status, row_count``
* imports: ``import_id, dataset_id, status, created_at``
* saved queries: ``saved_query_id, dataset_id, saved_query_name, updated_at``
* widgets: ``widget_id, dashboard_id, saved_query_id, position``
* executions: see :mod:`plumbline.operators.audit`

Extra columns pass through where a result keeps its left side whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLETED = "COMPLETED"
CANCELLED = "CANCELLED"

_NULL_SHARES = 1024


def optional_lookup(left: DataFrame, right: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join on a reference that may be missing in many rows.

    Rows without a reference match nothing, yet a join sends them all to one task. Here
    they are dealt out by another column. Hot references are left to adaptive execution,
    which splits the partitions they make too large.
    """
    share = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(_NULL_SHARES)))
    dealt = left.withColumn("_share", F.coalesce(share, F.lit(0)))
    return dealt.join(right.withColumn("_share", F.lit(0).cast("bigint")), [key, "_share"], "left").drop(
        "_share"
    )


def tenant_scope(table: DataFrame, organization_id, column: str = "organization_id") -> DataFrame:
    """Only one tenant's rows. On a table partitioned by tenant this prunes directories."""
    return table.filter(F.col(column) == F.lit(organization_id))


def datasets_with_current_version(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """Every dataset, newest first, with its current version; null where it has none yet."""
    current = versions.select(
        F.col("version_id").alias("current_version_id"), "version_number", "status", "row_count"
    )
    return optional_lookup(datasets, current, "current_version_id", "dataset_id").orderBy(
        F.col("created_at").desc_nulls_first(), F.col("dataset_id").asc()
    )


def saved_query_usage(
    saved_queries: DataFrame, datasets: DataFrame, executions: DataFrame
) -> DataFrame:
    """Saved queries with their dataset's name and how often they ran, newest edited first.

    Executions are counted before the join, so a query run a billion times is one row
    by the time it meets the others.
    """
    runs = executions.groupBy("saved_query_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
    )
    names = datasets.select("dataset_id", "dataset_name")
    return (
        saved_queries.join(runs, "saved_query_id", "left")
        .join(names, "dataset_id", "inner")
        .select(
            "saved_query_id",
            "saved_query_name",
            "dataset_id",
            "dataset_name",
            "updated_at",
            F.coalesce("runs", F.lit(0)).alias("runs"),
            F.coalesce("failed_runs", F.lit(0)).alias("failed_runs"),
        )
        .orderBy(F.col("updated_at").desc_nulls_first(), F.col("saved_query_id").asc())
    )


def widget_list(
    widgets: DataFrame, saved_queries: DataFrame, datasets: DataFrame, versions: DataFrame
) -> DataFrame:
    """Widgets with query, dataset and version, in dashboard and position order."""
    queries = saved_queries.select("saved_query_id", "saved_query_name", "dataset_id")
    named = datasets.select("dataset_id", "dataset_name", "current_version_id")
    current = versions.select(F.col("version_id").alias("current_version_id"), "version_number")
    listed = (
        widgets.join(queries, "saved_query_id", "inner")
        .join(named, "dataset_id", "inner")
    )
    return (
        optional_lookup(listed, current, "current_version_id", "widget_id")
        .select(
            "dashboard_id",
            "position",
            "widget_id",
            "saved_query_id",
            "saved_query_name",
            "dataset_name",
            "version_number",
        )
        .orderBy("dashboard_id", "position", "widget_id")
    )


def latest_per_key(table: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key by ``order`` (ascending columns; add a unique one for ties).

    An aggregate, not a window: each task keeps one candidate per key, so a key that
    holds a third of the table costs no more than any other.
    """
    others = [name for name in table.columns if name not in keys]
    rank = F.struct(*[F.col(name) for name in order])
    return (
        table.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), rank).alias("_latest"))
        .select(*keys, *[F.col(f"_latest.`{name}`").alias(name) for name in others])
    )


def latest_imports(imports: DataFrame) -> DataFrame:
    """The most recent import of every dataset, whatever became of it.

    It is still open unless completed or cancelled; a failed one counts as open,
    because somebody has to look at it.
    """
    latest = latest_per_key(imports, ["dataset_id"], ["created_at", "import_id"])
    return latest.withColumn("is_open", ~F.col("status").isin(COMPLETED, CANCELLED))


def workspace_totals(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """Per tenant: rows in current versions, datasets with a version, registered versions."""
    sizes = versions.select(F.col("version_id").alias("current_version_id"), "row_count")
    current = (
        optional_lookup(datasets, sizes, "current_version_id", "dataset_id")
        .groupBy("organization_id")
        .agg(
            F.sum(F.coalesce(F.col("row_count").cast("decimal(38,0)"), F.lit(0))).alias("total_rows"),
            F.count("row_count").alias("datasets_with_version"),
        )
    )
    per_dataset = versions.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("versions"))
    registered = (
        datasets.select("organization_id", "dataset_id")
        .join(per_dataset, "dataset_id", "inner")
        .groupBy("organization_id")
        .agg(F.sum("versions").alias("registered_versions"))
    )
    return current.join(registered, "organization_id", "left").select(
        "organization_id",
        "total_rows",
        "datasets_with_version",
        F.coalesce("registered_versions", F.lit(0)).alias("registered_versions"),
    )


def next_version_numbers(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """The number each dataset's next version gets: one more than its highest, from 1."""
    highest = versions.groupBy("dataset_id").agg(F.max("version_number").alias("_highest"))
    return (
        datasets.select("dataset_id")
        .join(highest, "dataset_id", "left")
        .select(
            "dataset_id",
            (F.coalesce(F.col("_highest"), F.lit(0)) + 1).alias("next_version_number"),
        )
    )


def version_history(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """All versions, newest first within a dataset, marked current or superseded.

    Superseded means that it completed and another version took its place. One that
    is running or failed never stood, so nothing superseded it.
    """
    pointers = datasets.select(F.col("current_version_id").alias("version_id")).distinct()
    pointers = pointers.withColumn("_current", F.lit(True))
    is_current = F.coalesce(F.col("_current"), F.lit(False))
    return (
        versions.join(pointers, "version_id", "left")
        .withColumn("is_current", is_current)
        .withColumn("is_superseded", ~F.col("is_current") & (F.col("status") == COMPLETED))
        .select(
            "dataset_id",
            "version_id",
            "version_number",
            "status",
            "row_count",
            "is_current",
            "is_superseded",
        )
        .orderBy("dataset_id", F.col("version_number").desc())
    )


def idempotency_key(object_key: Column, dataset_id: Column) -> Column:
    """What makes two import requests the same: the object and the dataset it is for.

    Different requests have different keys: the mark of a request without a dataset and the sign
    between the two parts are escaped where an id or an object's own name holds them.
    """
    escaped = lambda part: F.replace(F.replace(part.cast("string"), F.lit("\x1e"), F.lit("\x1e0")), F.lit("\x1f"), F.lit("\x1e1"))
    target = (
        F.when(dataset_id.isNull(), F.lit("new"))
        .when(dataset_id.cast("string") == "new", F.lit("\x1enew"))
        .otherwise(escaped(dataset_id))
    )
    return F.sha2(F.concat_ws("\x1f", F.coalesce(escaped(object_key), F.lit("\x1e")), target), 256)


def admit_imports(requests: DataFrame, admitted: DataFrame | None = None) -> DataFrame:
    """The first request of every object and target; repeats and known ones start nothing.

    ``requests`` has ``import_id, object_key, dataset_id, requested_at``; ``admitted``
    has the ``idempotency_key`` of earlier imports. Repeats are folded by an aggregate
    before anything is joined, so an object uploaded a million times is one row.
    """
    keyed = requests.withColumn(
        "idempotency_key", idempotency_key(F.col("object_key"), F.col("dataset_id"))
    )
    first = keyed.groupBy("idempotency_key").agg(
        F.min_by("import_id", F.struct("requested_at", "import_id")).alias("import_id"),
        F.min("requested_at").alias("requested_at"),
        (F.count(F.lit(1)) - 1).alias("repeats"),
    )
    if admitted is not None:
        first = first.join(admitted.select("idempotency_key"), "idempotency_key", "left_anti")
    return first
