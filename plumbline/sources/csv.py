"""Reading CSV exports of any size, with exact row numbers and field counts.

A quoted field may hold line breaks, so where a record starts depends on every quote
before it. Spark's multi-line mode answers that by giving each file to one task. Here
the text is read in splits instead, and the two things that depend on what came before
are settled from one small row per split: how many records lie before it, and whether
it begins inside quotes. The first reading counts every split for both cases, begun inside
quotes or outside; a running sum over the splits of a file then tells which case holds. The
second reading puts records together where they lie. Only records that cross from one
split into the next are shuffled, as fragments.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..errors import LimitExceededError, NotFoundError, ValidationError
from ..functions.grammar import WHITESPACE
from ..model import MAX_FILE_BYTES, MAX_FILE_COLUMNS, MAX_FILE_ROWS, MAX_PREVIEW_ROWS
from ..session import configure, scratch_path
from .files import first_bytes

FILE = "_file"
ROW_NUMBER = "_row_number"
FIELD_COUNT = "_field_count"

BOM = "\ufeff"
# A row per split is a few numbers; up to this many are sent to every executor (some 300 MB).
# That is 500 TB in read blocks of 128 MB; larger files need larger blocks.
MOST_SPLITS = 4_000_000
# Longest record that is put together from several splits.
MAX_RECORD_BYTES = 128 << 20
# What the driver reads of a file at first; it reads on while the header goes on.
HEAD_BYTES = 1 << 20
# Rows and bytes of a sample up to which it is taken from the head of the file alone.
SAMPLE_ROWS, SAMPLE_BYTES = 10_000, 64 << 20

_PARSE_OPTIONS = {
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "emptyValue": "",
    "maxCharsPerColumn": "-1",
}


@dataclass(frozen=True)
class HeaderColumn:
    """One header cell: the name used, and what had to be done to get it."""

    position: int
    name: str
    original_header: str
    issues: tuple[str, ...]

    @property
    def renamed(self) -> bool:
        return bool(self.issues)


@dataclass(frozen=True)
class Ceilings:
    """Bounds a file must not exceed; ``None`` switches one off."""

    max_bytes: int | None = MAX_FILE_BYTES
    max_rows: int | None = MAX_FILE_ROWS
    max_columns: int | None = MAX_FILE_COLUMNS

    def check(self, size: int | None = None, rows: int | None = None, columns: int | None = None):
        """Refuse what exceeds a bound, naming it and the measured value. Equal is allowed."""
        for measured, bound, unit in (
            (columns, self.max_columns, "column"),
            (size, self.max_bytes, "byte"),
            (rows, self.max_rows, "row"),
        ):
            if measured is not None and bound is not None and measured > bound:
                raise LimitExceededError(
                    f"File exceeds the {bound}-{unit} limit (measured {measured} {unit}s)."
                )


UNLIMITED = Ceilings(None, None, None)


def resolve_headers(cells: Sequence[str]) -> list[HeaderColumn]:
    """Unique, non-blank, trimmed names for a header row, with what was changed.

    A byte order mark is taken off the first cell. A blank cell becomes
    ``column_{position}``. A later duplicate gets ``_{position}`` and, should that name
    be taken as well, ``_2``, ``_3`` and so on.
    """
    wanted = [_clean_header(cell, position) for position, cell in enumerate(cells, start=1)]
    taken: set[str] = set()
    columns = []
    for position, (name, issues) in enumerate(wanted, start=1):
        free = next(candidate for candidate in _header_names(name, position) if candidate not in taken)
        taken.add(free)
        renamed = () if free == name else ("duplicate_header",)
        columns.append(HeaderColumn(position, free, cells[position - 1], issues + renamed))
    return columns


def _clean_header(cell: str, position: int) -> tuple[str, tuple[str, ...]]:
    marked = position == 1 and cell.startswith(BOM)
    name = cell.removeprefix(BOM if marked else "").strip(WHITESPACE)
    issues = ("bom_stripped",) * marked + ("blank_header",) * (not name)
    return name or f"column_{position}", issues


def _header_names(name: str, position: int) -> Iterator[str]:
    yield name
    yield f"{name}_{position}"
    for attempt in count(2):
        yield f"{name}_{position}_{attempt}"


def scan_csv(spark: SparkSession, path: str, ceilings: Ceilings = UNLIMITED) -> CsvScan:
    """Open a CSV file, or a folder of CSV files that all start with the same header."""
    configure(spark)
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "length")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise NotFoundError("The uploaded file could not be found in storage.") from None
    found = files.agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.min("path").alias("first")
    ).first()
    if found.files == 0:  # files without any byte are not listed
        raise ValidationError("The uploaded file has no columns to import.")
    ceilings.check(size=found.bytes)
    head = _head(spark, found.first)
    separator = _line_separator(head)
    cells = _header_cells(head)
    ceilings.check(columns=len(cells))
    header = tuple(resolve_headers(cells))
    return CsvScan(
        spark, path, found.first, found.files, header, separator, found.bytes, ceilings
    )


def _head(spark: SparkSession, path: str) -> str:
    """The first part of one file, to the end of its header at least."""
    size = HEAD_BYTES
    while True:
        data = first_bytes(spark, path, size)
        head = data.decode("utf-8", errors="replace")
        if len(data) < size or _header_ends(head):
            return head
        size *= 8


def _first_records(data: bytes, complete: bool, separator: str, wanted: int) -> list[str] | None:
    """The first records of a file from its first bytes; None if these hold fewer, but are not all."""
    lines = data.decode("utf-8", errors="replace").removeprefix(BOM).split(separator)
    if not complete:
        lines.pop()  # its end is not known
    records: list[str] = []
    parts: list[str] = []
    for line in lines:
        if len(records) == wanted:
            break
        if parts or line:
            parts.append(line)
            # A first line with an even number of quotes, or a later one with an odd number, ends the record.
            if line.count('"') % 2 == (len(parts) > 1):
                records.append(separator.join(parts))
                parts = []
    return records if complete or len(records) == wanted else None


def _header_ends(head: str) -> bool:
    """Whether a line break outside quotes follows the first line with anything in it."""
    quoted = begun = False
    for char in head.removeprefix(BOM):
        if char in "\r\n":
            if begun and not quoted:
                return True
        else:
            begun = True
            quoted ^= char == '"'
    return False


def _line_separator(head: str) -> str:
    """The first line break outside quotes decides for the whole file."""
    quoted = False
    for i, char in enumerate(head):
        if char == '"':
            quoted = not quoted
        elif not quoted and char == "\n":
            return "\n"
        elif not quoted and char == "\r":
            return "\r\n" if head[i + 1 : i + 2] == "\n" else "\r"
    return "\n"


def _header_cells(head: str) -> list[str]:
    marked = head.startswith(BOM)
    for cells in csv.reader(io.StringIO(head.removeprefix(BOM), newline="")):
        if cells:
            return [BOM + cells[0], *cells[1:]] if marked else cells
    if marked:
        return [BOM]
    raise ValidationError("The uploaded file has no columns to import.")


_SPLIT_SCHEMA = (
    f"{FILE} string, _key long, _block long, _first_order long, _line_count long, _bytes long, _odd_lines long, "
    "_blank_lines long, _begun_outside long, _begun_inside long, _lead string, _lead_ends boolean"
)
_PIECE_SCHEMA = f"{FILE} string, {ROW_NUMBER} long, _block long, _whole boolean, _record string"
_QUOTED = re.compile('(?:"[^"]*")+')
_STRAY = re.compile('[^,]"|"[^,]')


def _arrow_schema(columns: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(columns))


class _Lines:
    """Lines of one split in one batch: quotes left open and blank lines, counted at once."""

    def __init__(self, batch: pa.RecordBatch, start: int, end: int):
        self.values = batch.column("value").slice(start, end - start)
        self.odd = pc.count_substring(self.values, '"').to_numpy(zero_copy_only=False) & 1
        self.size = pc.binary_length(self.values).to_numpy(zero_copy_only=False)
        self.blank = self.size == 0

    def opened(self, before: int) -> np.ndarray:
        """Whether each line begins inside quotes, if the first one does (1) or not (0)."""
        return (np.cumsum(self.odd) - self.odd + before) & 1


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """The ranges of rows of a batch that come from one split."""
    key, block = (batch.column(n).to_numpy() for n in ("_key", "_block"))
    cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
    bounds = [0, *cuts.tolist(), batch.num_rows] if batch.num_rows else [0]
    yield from zip(bounds[:-1], bounds[1:], strict=True)


class _SplitCount:
    """What the first reading learns of one split, whichever way it begins."""

    def __init__(self, file: str, key: int, block: int, order: int):
        self.place = (file, key, block, order)
        self.lines = self.bytes = self.odd = self.blank = self.outside = self.inside = 0
        self.lead: list[str] | None = []
        self.lead_bytes, self.lead_ends = 0, False
        # A file's first split leads with its header, any other with what may be the rest of a record.
        self.open = 0 if block == 0 else 1

    def add(self, lines: _Lines, separator: int) -> None:
        opened = lines.opened(self.odd & 1)
        self.outside += int(((opened == 0) & ~lines.blank).sum())
        self.inside += int(((opened == 1) & ~lines.blank).sum())
        self.lines += len(lines.size)
        self.bytes += int(lines.size.sum()) + separator * len(lines.size)
        self.blank += int(lines.blank.sum())
        if self.lead is not None and not self.lead_ends:
            self._lead(lines)
        self.odd += int(lines.odd.sum())

    def _lead(self, lines: _Lines) -> None:
        start = 0
        if not self.lead and not self.open:
            # The header begins with the first line that holds anything.
            begun = np.flatnonzero(~lines.blank)
            if not len(begun):
                return
            start = int(begun[0])
        parity = (np.cumsum(lines.odd[start:]) + self.open) & 1
        closed = np.flatnonzero(parity == 0)
        end = start + int(closed[0]) + 1 if len(closed) else len(parity) + start
        self.lead_bytes += int(lines.size[start:end].sum())
        if self.lead_bytes > HEAD_BYTES and self.place[2] != 0:
            self.lead = None
            return
        self.lead += lines.values.slice(start, end - start).to_pylist()
        self.lead_ends, self.open = bool(len(closed)), int(parity[-1])

    def row(self, separator: str) -> dict:
        lead = separator.join(self.lead) if self.lead else None
        counts = (self.lines, self.bytes, self.odd, self.blank, self.outside, self.inside)
        return dict(zip(_SPLIT_NAMES, (*self.place, *counts, lead, self.lead_ends), strict=True))


_SPLIT_NAMES = [column.split()[0] for column in _SPLIT_SCHEMA.split(", ")]


class _RecordBuilder:
    """Records of one split, from its lines in order."""

    def __init__(self, file: str, block: int, opens_quoted: int, records_before: int, separator: str):
        self.file, self.block, self.separator = file, block, separator
        self.open, self.begun, self.before = opens_quoted, 0, records_before
        self.parts: list[str] = []
        self.out: list[tuple[int, bool, str]] = []
        self.whole = False

    def add(self, lines: _Lines) -> tuple[np.ndarray, pa.Array]:
        """Numbers and texts of the records that are one line; others go to ``out``."""
        opened = lines.opened(self.open)
        begins = (opened == 0) & ~lines.blank
        # The header is record 0, so that data rows count from 1.
        number = self.before + self.begun + np.cumsum(begins) - 1
        alone = begins & (lines.odd == 0)
        several = np.flatnonzero((opened == 1) | (begins & (lines.odd == 1)))
        texts = lines.values.take(pa.array(several)).to_pylist()
        for i, text in zip(several.tolist(), texts, strict=True):
            left_open = bool(opened[i]) != bool(lines.odd[i])
            self._judge(text, bool(opened[i]), left_open)
            if begins[i]:
                self.parts, self.whole = [], True
            self.parts.append(text)
            if not left_open:
                self.finish(int(number[i]), self.whole)
        self.open = int((self.open + lines.odd.sum()) & 1)
        self.begun += int(begins.sum())
        return number[alone], lines.values.filter(pa.array(alone))

    def _judge(self, line: str, opened: bool, left_open: bool) -> None:
        bare = _QUOTED.sub('"', '"' * opened + line + '"' * left_open) if '"' in line else ""
        if _STRAY.search(bare):
            raise ValueError(
                f"The file is not valid CSV: a quote does not enclose a whole field ({self.file}, block at {self.block})."
            )

    def finish(self, number: int, whole: bool) -> None:
        if self.parts:
            self.out.append((number, whole, self.separator.join(self.parts)))
        self.parts, self.whole = [], False

    def end(self) -> None:
        """What is still open goes on in the next split."""
        self.finish(self.before + self.begun - 1, False)


@dataclass(frozen=True)
class CsvScan:
    """An opened CSV: its header, and its records as a frame of text columns."""

    spark: SparkSession
    path: str
    first_file: str
    file_count: int
    header: tuple[HeaderColumn, ...]
    line_separator: str
    size_bytes: int
    ceilings: Ceilings

    @property
    def names(self) -> list[str]:
        return [column.name for column in self.header]

    @cached_property
    def _lines(self) -> DataFrame:
        """Lines with the split they come from and their order inside it."""
        return self.spark.read.text(self.path, lineSep=self.line_separator).select(
            "value",
            F.col("_metadata.file_path").alias(FILE),
            F.xxhash64("_metadata.file_path").alias("_key"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_order"),
        )

    def _written(self, frame: DataFrame) -> DataFrame:
        """A table of splits, written down so that it is not computed anew for each reading."""
        target = scratch_path(self.spark, "csv-splits")
        frame.write.parquet(target)
        return self.spark.read.parquet(target)

    @cached_property
    def _counted(self) -> DataFrame:
        """One row per split, from the first reading of the text."""
        separator, arrow = self.line_separator, _arrow_schema(_SPLIT_SCHEMA)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = None
            for batch in batches:
                done = []
                for start, end in _segments(batch):
                    place = tuple(batch.column(n)[start].as_py() for n in ("_key", "_block"))
                    if now is None or now.place[1:3] != place:
                        if now is not None:
                            done.append(now.row(separator))
                        now = _SplitCount(batch.column(FILE)[start].as_py(), *place, batch.column("_order")[start].as_py())
                    now.add(_Lines(batch, start, end), len(separator))
                if done:
                    yield pa.RecordBatch.from_pylist(done, schema=arrow)
            if now is not None:
                yield pa.RecordBatch.from_pylist([now.row(separator)], schema=arrow)

        return self._written(self._lines.mapInArrow(run, _SPLIT_SCHEMA))

    @cached_property
    def _splits(self) -> DataFrame:
        """The splits, with how many records of the file begin before each of them.

        A split is plain when each of its lines is one record: it begins outside quotes,
        and has no line that leaves a quote open and no blank one. ``_stretch`` is what lies
        inside quotes from the last record begun before to the end of the split.
        """
        in_file = Window.partitionBy(FILE).orderBy("_block")
        opens = (F.sum("_odd_lines").over(in_file) - F.col("_odd_lines")) % 2
        begun = F.when(F.col("_opens_quoted") == 1, F.col("_begun_inside")).otherwise(F.col("_begun_outside"))
        run = Window.partitionBy(FILE, "_run").orderBy("_block")
        counts = self._counted.drop("_lead", "_lead_ends").withColumn("_opens_quoted", opens).withColumn("_records", begun)
        return self._written(
            counts.withColumn("_run", F.sum((F.col("_records") > 0).cast("long")).over(in_file)).select(
                FILE,
                "_key",
                "_block",
                "_first_order",
                "_records",
                "_opens_quoted",
                (F.col("_odd_lines") + F.col("_blank_lines") + F.col("_opens_quoted") == 0).alias("_plain"),
                (F.sum("_records").over(in_file) - F.col("_records")).alias("_records_before"),
                ((F.col("_opens_quoted") + F.col("_odd_lines")) % 2).alias("_leaves_quoted"),
                F.sum(F.when((F.col("_records") == 0) & (F.col("_opens_quoted") == 1), F.col("_bytes")).otherwise(0)).over(run).alias("_stretch"),
            )
        )

    @cached_property
    def _shape(self):
        last = F.max_by("_leaves_quoted", "_block").alias("open")
        ends = self._splits.groupBy(FILE).agg(last, F.sum("_records").alias("records"))
        longest = F.max(F.struct("_stretch", FILE, "_block")).alias("longest")
        shape = self._splits.agg(
            F.coalesce(F.bool_and("_plain"), F.lit(True)).alias("plain"),
            F.count(F.lit(1)).alias("splits"),
            F.count_distinct(FILE).alias("files"),
            F.count_distinct("_key").alias("keys"),
            F.coalesce(F.sum("_records"), F.lit(0)).alias("records"),
            longest,
        ).first()
        unclosed = ends.filter("open = 1").orderBy(FILE).first()
        if unclosed is not None:
            raise ValidationError(f"The file is not valid CSV: a quoted field is never closed ({unclosed[FILE]}).")
        if shape.longest is not None and shape.longest["_stretch"] > MAX_RECORD_BYTES:
            raise ValidationError(
                f"A quoted field is longer than {MAX_RECORD_BYTES} bytes "
                f"({shape.longest[FILE]}, block at {shape.longest['_block']})."
            )
        if shape.splits > MOST_SPLITS or shape.files != shape.keys:
            raise ValidationError("The files have too many read blocks; raise spark.sql.files.maxPartitionBytes.")
        if self.file_count > 1:
            self._require_one_header()
        return shape

    def header_records(self) -> DataFrame:
        """The header record of every file: ``file`` and its parsed ``cells``.

        A header that goes on beyond the first split of its file is put together from
        what the next splits lead with.
        """
        in_file = Window.partitionBy(FILE).orderBy("_block")
        # The first split in which the header ends, and those before it.
        ended = F.sum(F.col("_lead_ends").cast("long")).over(in_file) - F.col("_lead_ends").cast("long")
        parts = self._counted.select(FILE, "_block", "_lead", "_lead_ends").withColumn("_ended", ended).filter("_ended = 0")
        ordered = F.sort_array(F.collect_list(F.struct("_block", "_lead", "_lead_ends")))
        # Most files need one row here; a header is refused where a later part exceeds HEAD_BYTES.
        whole = parts.groupBy(FILE).agg(ordered.alias("_parts")).select(
            F.col(FILE).alias("file"), F.concat_ws(self.line_separator, "_parts._lead").alias("record"),
            F.exists("_parts", lambda p: p["_lead_ends"]).alias("ends"),
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = [next(csv.reader(io.StringIO(r, newline="")), []) if r else [] for r in batch.column("record").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(cells, pa.list_(pa.string())), batch.column("ends")], names=["file", "cells", "ends"])

        return whole.mapInArrow(run, "file string, cells array<string>, ends boolean")

    def _require_one_header(self) -> None:
        found = self.header_records().groupBy("cells", "ends").agg(F.min("file").alias("file")).orderBy("file").limit(2).collect()
        if len(found) > 1 or not all(r.ends for r in found):
            named = f" ({found[0].file} and {found[1].file} differ)" if len(found) > 1 else ""
            raise ValidationError(f"The files do not all start with the same header{named}.")

    def _plain_records(self) -> DataFrame:
        """Records where each line is one. No shuffle, no Python."""
        splits = F.broadcast(self._splits.select("_key", "_block", F.col("_first_order").alias("_first"), "_records_before"))
        number = F.col("_records_before") + F.col("_order") - F.col("_first")
        return self._lines.join(splits, ["_key", "_block"]).select(
            FILE, number.alias(ROW_NUMBER), F.col("value").alias("_record")
        )

    @cached_property
    def _pieces(self) -> DataFrame:
        """Records put together split by split, from the second reading; those that lie in several splits as one piece each.

        Written down, so that profile and load of one file do not read its text again.
        """
        separator, arrow = self.line_separator, _arrow_schema(_PIECE_SCHEMA)
        splits = F.broadcast(self._splits.select("_key", "_block", "_opens_quoted", "_records_before"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, place = None, None
            for batch in batches:
                # One batch of whole lines, then one of records of several lines.
                several: list[tuple[str, int, int, bool, str]] = []

                def take(builder: _RecordBuilder, several=several) -> None:
                    several.extend((builder.file, n, builder.block, whole, text) for n, whole, text in builder.out)
                    builder.out.clear()

                for start, end in _segments(batch):
                    key, block = (batch.column(n)[start].as_py() for n in ("_key", "_block"))
                    if place != (key, block):
                        if now is not None:
                            now.end()
                            take(now)
                        file, opens, before = (batch.column(n)[start].as_py() for n in (FILE, "_opens_quoted", "_records_before"))
                        now, place = _RecordBuilder(file, block, opens, before, separator), (key, block)
                    numbers, texts = now.add(_Lines(batch, start, end))
                    take(now)
                    if len(numbers):
                        size = len(numbers)
                        columns = [pa.repeat(now.file, size), pa.array(numbers.astype(np.int64)), pa.repeat(now.block, size), pa.repeat(True, size), texts]
                        yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                if several:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*several, strict=True), arrow, strict=True)], schema=arrow)
            if now is not None:
                now.end()
                if now.out:
                    rows = [(now.file, n, now.block, whole, text) for n, whole, text in now.out]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        pieces = (
            self._lines.join(splits, ["_key", "_block"])
            .select("value", FILE, "_key", "_block", "_opens_quoted", "_records_before")
            .mapInArrow(run, _PIECE_SCHEMA)
        )
        return self._written(pieces)

    def _framed_records(self) -> DataFrame:
        """Records from their pieces. Whole ones stay where they are."""
        whole = self._pieces.filter("_whole").select(FILE, ROW_NUMBER, "_record")
        parts = F.sort_array(F.collect_list(F.struct("_block", "_record")))
        crossing = (
            self._pieces.filter("not _whole")
            .groupBy(FILE, ROW_NUMBER)
            .agg(F.concat_ws(self.line_separator, F.transform(parts, lambda p: p["_record"])).alias("_record"))
        )
        return whole.unionByName(crossing)

    @cached_property
    def record_texts(self) -> DataFrame:
        """Unparsed data records with file and 1-based row number; the header left out."""
        records = self._plain_records() if self._shape.plain else self._framed_records()
        return records.filter(F.col(ROW_NUMBER) > 0)

    @cached_property
    def _first_scan(self) -> CsvScan:
        return self if self.file_count == 1 else replace(self, path=self.first_file, file_count=1)

    def _sampled_texts(self, rows: int) -> DataFrame:
        """The first rows of the first file, from its first bytes where they hold that many."""
        size = HEAD_BYTES
        while rows <= SAMPLE_ROWS and size <= SAMPLE_BYTES:
            data = first_bytes(self.spark, self.first_file, size)
            found = _first_records(data, len(data) < size, self.line_separator, rows + 1)
            if found is not None:
                numbered = [(self.first_file, i, text) for i, text in enumerate(found)][1:]
                return self.spark.createDataFrame(numbered, f"{FILE} string, {ROW_NUMBER} long, _record string")
            size *= 8
        return self._first_scan.record_texts.filter(F.col(ROW_NUMBER) <= rows)

    def records(self, sample_rows: int | None = None) -> DataFrame:
        """Text columns of every record, with file, row number and real field count.

        A record with too few or too many fields is kept: missing ones are null, surplus
        ones are dropped, and the count tells. ``sample_rows`` asks for the first rows of
        the first file only; no other file is read for them.
        """
        if sample_rows is None:
            texts = self.record_texts
        else:
            texts = self._sampled_texts(sample_rows)
        fields = [f"_f{i}" for i in range(len(self.header))]
        schema = ", ".join(f"{name} string" for name in fields)
        most = max(len(fields) * 4, 20_480)
        options = {**_PARSE_OPTIONS, "maxColumns": str(most)}
        parsed = texts.select(
            FILE,
            ROW_NUMBER,
            _checked_field_count(F.col("_record")).alias(FIELD_COUNT),
            F.from_csv(_cut_to(F.col("_record"), len(fields), most), schema, options).alias("_fields"),
        )
        return parsed.select(
            FILE,
            ROW_NUMBER,
            FIELD_COUNT,
            *[F.col(f"_fields.{f}").alias(h.name) for f, h in zip(fields, self.header)],
        )

    def cells(self, sample_rows: int | None = None) -> DataFrame:
        return self.records(sample_rows).select(*[F.col(f"`{name}`") for name in self.names])

    def field_count_mismatches(self) -> DataFrame:
        """Records whose field count is not the header's, with both counts."""
        expected = len(self.header)
        counted = self.record_texts.select(
            FILE, ROW_NUMBER, _checked_field_count(F.col("_record")).alias("actual")
        )
        return counted.filter(F.col("actual") != expected).select(
            F.col(FILE).alias("file"),
            F.col(ROW_NUMBER).alias("row_number"),
            F.lit(expected).cast("bigint").alias("expected"),
            "actual",
        )

    def file_profile(self) -> DataFrame:
        """One row: bytes, columns, data rows, and rows with a wrong field count."""
        actual = _checked_field_count(F.col("_record"))
        return self.record_texts.agg(
            F.lit(self.size_bytes).cast("bigint").alias("bytes"),
            F.lit(len(self.header)).cast("bigint").alias("column_count"),
            F.count(F.lit(1)).alias("rows_read"),
            F.count_if(actual != len(self.header)).alias("rows_with_bad_field_count"),
        )

    def enforce_ceilings(self) -> None:
        """Refuse the file if it exceeds a bound. Rows are counted last, from the first reading."""
        self.ceilings.check(self.size_bytes, columns=len(self.header))
        if self.ceilings.max_rows is not None:
            self.ceilings.check(rows=self.row_count)

    @property
    def row_count(self) -> int:
        """Data rows, from the first reading alone: every file has a header beside them."""
        self._shape  # noqa: B018 - refuses files that cannot be framed
        in_files = self._splits.groupBy(FILE).agg(F.greatest(F.sum("_records") - 1, F.lit(0)).alias("rows"))
        return in_files.agg(F.sum("rows").alias("rows")).first().rows or 0


def _checked_field_count(record: Column) -> Column:
    """Fields of one record: separators outside quotes, plus one.

    Quotes that do not enclose a whole field make a file unreadable; such a record
    stops the job, as no split of it into fields can be right.
    """
    bare = F.regexp_replace(record, '(?:"[^"]*+")++', '"')
    separators = F.length(bare) - F.length(F.translate(bare, ",", "")) + 1
    plain = F.length(record) - F.length(F.translate(record, ",", "")) + 1
    message = F.lit("The file is not valid CSV: a quote does not enclose a whole field.")
    quoted = F.when(bare.rlike('[^,]"|"[^,]'), F.raise_error(message).cast("int")).otherwise(separators)
    return F.when(record.contains('"'), quoted).otherwise(plain).cast("bigint")


def _cut_to(record: Column, wanted: int, most: int) -> Column:
    """A record of more than ``most`` fields without those beyond the wanted ones."""
    field = r'(?:"(?:[^"]|"")*+"|[^,"]*+)'
    quoted = F.regexp_extract(record, f"^(?:{field},){{{wanted - 1}}}{field}", 0)
    plain = F.substring_index(record, ",", wanted)
    cut = F.when(record.contains('"'), quoted).otherwise(plain)
    separators = F.length(record) - F.length(F.translate(record, ",", ""))
    return F.when(separators >= most, cut).otherwise(record)


def preview_rows(df: DataFrame, rows: int = 50) -> DataFrame:
    """The first rows of a version; a number out of range is refused, never clamped.

    Rows that tell their file and row number come in that order, without these columns.
    """
    if isinstance(rows, bool) or not isinstance(rows, int) or not 1 <= rows <= MAX_PREVIEW_ROWS:
        raise ValidationError(f"Preview limit must be between 1 and {MAX_PREVIEW_ROWS}.")
    source = [name for name in (FILE, ROW_NUMBER) if name in df.columns]
    return df.orderBy(*source).limit(rows).drop(*source) if len(source) == 2 else df.limit(rows)
