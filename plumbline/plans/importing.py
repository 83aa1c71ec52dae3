"""A CSV export to a new dataset version: profile, confirm, load."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import error_code
from ..model import Column, require_timezone
from ..operators.audit import FAILED, SUCCESS
from ..operators.load import typed_load
from ..operators.profile import column_profile, confirm_schema, infer_schema
from ..sources.csv import FIELD_COUNT, ROW_NUMBER, UNLIMITED, Ceilings, CsvScan, scan_csv
from ..sources.versions import VersionStore
from .rollups import Rollup, rolled_up


_PROPOSAL = (
    "position bigint, name string, type string, nullable boolean, unparseable_count bigint, "
    "datetime_offset string, decimal_scale bigint, original_header string, "
    "header_renamed boolean, header_issues array<string>"
)


IMPORT_SCHEMA = (
    "import_id string, dataset_id string, version_number bigint, path string, status string, "
    "started_at timestamp, completed_at timestamp, row_count bigint, error_code string"
)


@dataclass(frozen=True)
class ProposedImport:
    """A profiled file: what the reader may confirm or override before it is loaded."""

    scan: CsvScan
    columns: DataFrame


def profile_import(
    spark: SparkSession,
    path: str,
    ceilings: Ceilings = UNLIMITED,
    sample_rows: int | None = None,
) -> ProposedImport:
    """Propose a schema from all rows of all files.

    With ``sample_rows`` the first rows of the first file decide the types, but never how many
    decimal places are kept: these are those of all rows.
    """
    scan = scan_csv(spark, path, ceilings)
    scan.enforce_ceilings()
    proposed = infer_schema(column_profile(scan.cells(sample_rows), scan.names))
    if sample_rows is not None:
        whole = infer_schema(column_profile(scan.cells(), scan.names))
        scales = whole.select("position", F.col("decimal_scale").alias("_scale"))
        widest = F.greatest("decimal_scale", "_scale")
        proposed = proposed.join(scales, "position", "left").withColumn("decimal_scale", widest).drop("_scale")
    # One row per column, kept as it is: confirming must not read the file again.
    described = [
        (*row, header.original_header, header.renamed, list(header.issues))
        for row, header in zip(proposed.orderBy("position").collect(), scan.header)
    ]
    columns = spark.createDataFrame(described, _PROPOSAL)
    return ProposedImport(scan, columns)


def load_import(
    store: VersionStore,
    proposed: ProposedImport,
    dataset_id: str,
    timezone: str,
    overrides: Mapping[int, str] | None = None,
    version: int | None = None,
    rollups: Sequence[Rollup] = (),
) -> int:
    """Load every record under the confirmed schema. Returns the version number.

    ``rollups`` are stored with the version; questions they cover are answered from them.

    Name the ``version`` to repeat a load; it ends in the same rows, and readers see the version
    as it was until the new attempt is whole.
    """
    require_timezone(timezone)
    repeated = version is not None
    claim = None if repeated else store.claim_version(dataset_id)
    version = version if repeated else claim.version
    started = datetime.now(UTC)

    def note(status: str, rows: int | None, code: str | None) -> None:
        row = (str(uuid.uuid4()), dataset_id, version, proposed.scan.path, status, started, datetime.now(UTC), rows, code)
        store.append("imports", store.spark.createDataFrame([row], IMPORT_SCHEMA))

    try:
        cells = confirm_schema(proposed.columns, overrides)
        loaded = typed_load(
            proposed.scan.records(), cells, timezone, F.col(ROW_NUMBER), F.col(FIELD_COUNT)
        ).drop(FIELD_COUNT)
        types = [Column(c.name, c.name, c.type, True, i) for i, c in enumerate(cells, start=1)]
        made = [lambda df, r=r: rolled_up(df, r, types) for r in rollups]
        rows = store.write_version(dataset_id, version, loaded, cells, timezone, replace=repeated, claim=claim, rollups=made)
    except Exception as error:
        note(FAILED, None, error_code(error))
        raise
    note(SUCCESS, rows, None)
    return version


def stored_imports(store: VersionStore) -> DataFrame:
    """One row for each load that was tried: outcome, rows loaded, and why it failed."""
    return store.log("imports", IMPORT_SCHEMA)
