"""Immutable dataset versions as Parquet, and the catalog that describes them.

::

    <root>/claims/dataset_id=<id>/v=<n>                       who writes the version; made once, never changed
    <root>/data/dataset_id=<id>/v=<n>/attempt=<a>/            typed rows, issues and source beside them
    <root>/rollups/dataset_id=<id>/v=<n>/attempt=<a>/<i>/     totals by month and keys, where asked for
    <root>/catalog/columns/dataset_id=<id>/version_number=<n>/attempt=<a>/
    <root>/catalog/versions/dataset_id=<id>/version_number=<n>/attempt=<a>/   written last

Every attempt to write a version has directories of its own, which are never written
again. A version exists once a catalog row names its attempt; until then, and while it is
written anew, readers see what was there before. Of several rows the latest counts. A
completed version is not written again unless that is asked for.

A version number belongs to the writer that made its claim file, which the file system
makes for one of them only; the others take the next number. A writer that is lost leaves
a number without a version, and readers stay with the version before.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFoundError, ValidationError
from ..functions.casting import ISSUES, CellType
from ..model import Column
from ..operators.load import import_errors, load_summary
from ..operators.schema import column_continuity
from .csv import FILE, ROW_NUMBER
from .files import children, create_new, read_text
from .logs import GRACE_SECONDS, Log

_VERSION_SCHEMA = (
    "version_id string, status string, row_count bigint, rows_rejected bigint, "
    "column_count bigint, timezone string, created_at timestamp, "
    "dataset_id string, version_number bigint, attempt string"
)
_COLUMN_SCHEMA = (
    "column_id string, position bigint, name string, type string, nullable boolean, "
    "dataset_id string, version_number bigint, attempt string"
)
_KEY = ("dataset_id", "version_number")
#: Columns that tell where a row comes from.
SOURCE = (FILE, ROW_NUMBER)
_SAFE_ID = re.compile(r"[A-Za-z0-9_-]+")


@dataclass(frozen=True)
class Claim:
    """A version number that one writer alone may write."""

    dataset_id: str
    version: int
    owner: str


@dataclass(frozen=True)
class VersionStore:
    spark: SparkSession
    root: str

    def _dir(self, table: str, dataset_id: str, version: int) -> str:
        if not _SAFE_ID.fullmatch(dataset_id):
            raise ValidationError(f'"{dataset_id}" is not a dataset id.')
        if table == "data":
            return f"{self.root}/data/dataset_id={dataset_id}/v={version}"
        if table in ("claims", "rollups"):
            return f"{self.root}/{table}/dataset_id={dataset_id}/v={version}"
        return f"{self.root}/catalog/{table}/dataset_id={dataset_id}/version_number={version}"

    def _catalog(self, table: str, schema: str, dataset_id: str | None) -> DataFrame:
        """A catalog table, or one dataset's part of it without listing any other."""
        base = path = f"{self.root}/catalog/{table}"
        if dataset_id is not None:
            path = f"{base}/dataset_id={dataset_id}"
        try:
            return self.spark.read.schema(schema).option("basePath", base).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _attempts(self, dataset_id: str | None) -> DataFrame:
        """The catalog row of each version's latest attempt."""
        rows = self._catalog("versions", _VERSION_SCHEMA, dataset_id)
        fields = [c for c in rows.columns if c not in _KEY]
        latest = F.max_by(F.struct(*fields), F.struct("created_at", "attempt")).alias("latest")
        named = rows.groupBy(*_KEY).agg(latest).select(*_KEY, "latest.*")
        return named.select(*rows.columns)

    def versions(self, dataset_id: str | None = None) -> DataFrame:
        return self._attempts(dataset_id).drop("attempt")

    def columns(self, dataset_id: str | None = None) -> DataFrame:
        """Columns of every version, as its latest attempt left them."""
        written = self._catalog("columns", _COLUMN_SCHEMA, dataset_id)
        counted = self._attempts(dataset_id).select(*_KEY, "attempt")
        return written.join(counted, [*_KEY, "attempt"], "left_semi").drop("attempt")

    def current_versions(self) -> DataFrame:
        """The version each dataset points at: its highest completed one."""
        completed = self.versions().filter(F.col("status") == "COMPLETED")
        return completed.groupBy("dataset_id").agg(
            F.max_by("version_id", "version_number").alias("current_version_id"),
            F.max("version_number").alias("version_number"),
        )

    def current_version_number(self, dataset_id: str) -> int | None:
        completed = self.versions(dataset_id).filter(F.col("status") == "COMPLETED")
        return completed.agg(F.max("version_number").alias("n")).first().n

    def next_version_number(self, dataset_id: str) -> int:
        """One more than any written version; only a claim makes a number one's own."""
        return (self.versions(dataset_id).agg(F.max("version_number").alias("n")).first().n or 0) + 1

    def claim_version(self, dataset_id: str) -> Claim:
        """The next version number, for the caller alone."""
        claimed = [int(name[2:]) for name in children(self.spark, self._claim_dir(dataset_id)) if name.startswith("v=")]
        number = max([self.next_version_number(dataset_id), *[n + 1 for n in claimed]])
        while (claim := self.claim(dataset_id, number)) is None:
            number += 1
        return claim

    def claim(self, dataset_id: str, version: int) -> Claim | None:
        """That number for the caller alone; None if somebody else has it."""
        owner = uuid.uuid4().hex
        made = create_new(self.spark, f"{self._claim_dir(dataset_id)}/v={version}", owner)
        return Claim(dataset_id, version, owner) if made else None

    def _claim_dir(self, dataset_id: str) -> str:
        return self._dir("claims", dataset_id, 0).rpartition("/")[0]

    def _require(self, claim: Claim) -> None:
        if read_text(self.spark, f"{self._claim_dir(claim.dataset_id)}/v={claim.version}") != claim.owner:
            raise ValidationError(f"Version {claim.version} of this dataset belongs to another writer.")

    def write_version(
        self,
        dataset_id: str,
        version: int,
        loaded: DataFrame,
        cells: Sequence[CellType],
        timezone: str,
        replace: bool = False,
        claim: Claim | None = None,
        rollups: Sequence[Callable[[DataFrame], DataFrame]] = (),
    ) -> int:
        """Store typed rows with their issues, then the catalog rows. Returns the row count.

        The text is read and typed exactly once: summary and issue table are read back
        from the columns just written. Where ``loaded`` tells the file and number of a row,
        both are stored too. ``rollups`` make smaller tables of the stored rows, kept beside them. The number must be the caller's by ``claim``, or free; a completed
        version is refused, unless it is to be replaced.
        """
        if not replace:
            if self._is_completed(dataset_id, version):
                raise ValidationError(f"Version {version} of this dataset is complete.")
            claim = claim or self.claim(dataset_id, version)
            if claim is None:
                raise ValidationError(f"Version {version} of this dataset is being written.")
            self._require(claim)
        names = [cell.name for cell in cells]
        attempt = f"attempt={uuid.uuid4().hex}"
        data_dir = f"{self._dir('data', dataset_id, version)}/{attempt}"
        source = [n for n in SOURCE if n in loaded.columns and n not in names]
        kept = [F.col(f"`{n}`") for n in (*names, ISSUES, *source)]
        loaded.select(*kept).write.parquet(data_dir)

        stored = self.spark.read.parquet(data_dir)
        summary = load_summary(stored.select(*kept[: len(names) + 1])).first()
        described = self.spark.createDataFrame(
            [(dataset_id, version, i, c.name, c.type) for i, c in enumerate(cells, start=1)],
            "dataset_id string, version bigint, position bigint, name string, type string",
        )
        for i, made in enumerate(rollups):
            made(stored.select(*kept[: len(names)])).write.parquet(f"{self._dir('rollups', dataset_id, version)}/{attempt}/{i}")
        current = self.current_version_number(dataset_id)
        previous = self.columns(dataset_id).filter(
            F.col("version_number") == F.lit(-1 if current is None else current)
        )
        nullable = F.col("name").isin(*summary.nullable_columns) if summary.nullable_columns else F.lit(False)
        column_continuity(described, previous).select(
            "column_id", "position", "name", "type", nullable.alias("nullable")
        ).coalesce(1).write.parquet(f"{self._dir('columns', dataset_id, version)}/{attempt}")
        self.spark.range(1).select(
            F.lit(f"{dataset_id}-v{version}").alias("version_id"),
            F.lit("COMPLETED").alias("status"),
            F.lit(summary.rows_imported).cast("bigint").alias("row_count"),
            F.lit(summary.rows_rejected).cast("bigint").alias("rows_rejected"),
            F.lit(len(cells)).cast("bigint").alias("column_count"),
            F.lit(timezone).alias("timezone"),
            F.current_timestamp().alias("created_at"),
        ).coalesce(1).write.parquet(f"{self._dir('versions', dataset_id, version)}/{attempt}")
        return summary.rows_imported

    def append(self, log: str, rows: DataFrame) -> None:
        """Add rows to one of the store's logs; what is there is never touched."""
        Log(self.spark, self.root, log).append(rows)

    def log(self, log: str, schema: str) -> DataFrame:
        """The rows of a log, none while nothing was added; refused if it has other columns."""
        return Log(self.spark, self.root, log).read(schema)

    def fold_log(self, log: str, least: int = 64) -> int:
        """Put the many small files of a log into few, while others read and append."""
        return Log(self.spark, self.root, log).fold(least)

    def expire_log(self, log: str, grace_seconds: float = GRACE_SECONDS) -> int:
        """Remove the small files that were folded longer ago than any reader takes."""
        return Log(self.spark, self.root, log).expire(grace_seconds)

    def _is_completed(self, dataset_id: str, version: int) -> bool:
        same = (F.col("version_number") == version) & (F.col("status") == "COMPLETED")
        return not self.versions(dataset_id).filter(same).isEmpty()

    def _stored(self, dataset_id: str, version: int) -> DataFrame:
        """What the latest attempt at a version has written."""
        found = self._attempts(dataset_id).filter(F.col("version_number") == version).first()
        if found is None:
            raise NotFoundError("This dataset version has no loaded data.")
        return self.spark.read.parquet(f"{self._dir('data', dataset_id, version)}/attempt={found.attempt}")

    def rollups(self, dataset_id: str, version: int | None = None) -> list[DataFrame]:
        """The smaller tables stored with a version."""
        version = self._existing(dataset_id, version)
        found = self._attempts(dataset_id).filter(F.col("version_number") == version).first()
        base = f"{self._dir('rollups', dataset_id, version)}/attempt={found.attempt}" if found else ""
        return [self.spark.read.parquet(f"{base}/{name}") for name in sorted(children(self.spark, base))] if base else []

    def version_columns(self, dataset_id: str, version: int) -> list[Column]:
        rows = (
            self.columns(dataset_id)
            .filter(F.col("version_number") == version)
            .orderBy("position")
            .collect()  # one row per column of one version
        )
        if not rows:
            raise NotFoundError("This dataset version has no loaded data.")
        return [Column(r.column_id, r.name, r.type, r.nullable, r.position) for r in rows]

    def read_version(
        self, dataset_id: str, version: int | None = None, with_source: bool = False
    ) -> DataFrame:
        """Typed rows of a version, the current one by default; ids are in the field metadata.

        ``with_source`` adds the file and row number that a row was read from, where stored.
        """
        version = self._existing(dataset_id, version)
        columns = self.version_columns(dataset_id, version)
        stored = self._stored(dataset_id, version)
        names = {c.name for c in columns}
        source = [n for n in SOURCE if with_source and n in stored.columns and n not in names]
        return stored.select(
            *[
                F.col(f"`{c.name}`").alias(
                    c.name, metadata={"column_id": c.id, "nullable": c.nullable}
                )
                for c in columns
            ],
            *source,
        )

    def import_errors(self, dataset_id: str, version: int | None = None) -> DataFrame:
        """Issues of a version, with the file of the row where stored. No cell is read from storage."""
        version = self._existing(dataset_id, version)
        stored = self._stored(dataset_id, version)
        source = [n for n in SOURCE[:1] if n in stored.columns]
        issues = import_errors(stored.select(ISSUES, *source), source)
        return issues.withColumnsRenamed({n: n.lstrip("_") for n in source})

    def _existing(self, dataset_id: str, version: int | None) -> int:
        version = self.current_version_number(dataset_id) if version is None else version
        if version is None:
            raise NotFoundError("This dataset has no current version.")
        return version
