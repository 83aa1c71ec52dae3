"""What several operators of this subpackage share: tables, scratch tables, batches and hashes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import scratch_path

#: Batches for Python workers are bounded in rows and bytes, as texts can be long.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20),
}
U64 = np.uint64
FULL = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared scratch folder: computed once, and safe from lost executors."""
    spark = frame.sparkSession
    path = scratch_path(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


class Scratch:
    """Tables that are needed until a result is written, and are removed then."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def written(self, frame: DataFrame, purpose: str) -> DataFrame:
        path = scratch_path(self.spark, purpose)
        self.paths.append(path)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def remove(self) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        self.paths.clear()


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and ``text_key`` of each different row; null texts count as empty.

    Rows repeated with the same id and text are one document. Rows that share an id but
    not the text stay apart, as ``text_key`` tells them from each other.
    """
    content = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(docs[doc_id].alias("doc_id"), content.alias("text")).withColumn(
        "text_key", F.xxhash64("text")
    )


def mapped(frame: DataFrame, run, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` over batches of bounded size; column names may hold any characters."""
    for name, value in BATCHES.items():
        frame.sparkSession.conf.set(name, value)
    odd = {c: f"_odd{i}" for i, c in enumerate(frame.columns) if "." in c or "`" in c}
    if not odd:
        return frame.mapInArrow(run, schema)
    named = frame.toDF(*[odd.get(c, c) for c in frame.columns])
    if isinstance(schema, str):
        return named.mapInArrow(run, schema)
    fields = [T.StructField(odd.get(f.name, f.name), f.dataType, f.nullable) for f in schema.fields]
    return named.mapInArrow(run, T.StructType(fields)).toDF(*schema.names)


def all_but(frame: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """The frame without columns of these names; names may hold any characters."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in frame.columns if c not in names]
    return frame.select(*[frame[c] for c in quoted])


def schema_with(frame: DataFrame, **added: T.DataType) -> T.StructType:
    return T.StructType([*frame.schema.fields, *[T.StructField(name, kind) for name, kind in added.items()]])


def crc32_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def string_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and the offsets of its rows in them. Null rows are empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    rows = len(column)
    buffers = column.buffers()
    if rows == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(rows + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups_of_rows(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own."""
    first = 0
    rows = len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def inverse(odd: int) -> int:
    """The number that multiplies to 1 with an odd number modulo 2**64."""
    found = 1
    for _ in range(7):
        found = found * (2 - odd * found) & FULL
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit hashes over all others."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class RollingHash:
    """Hashes of any stretches of a byte sequence, from one running sum."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 1):
        self.symbols = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D) + U64(seed))
        self.powers = np.ones(1, U64)
        self.inverses = np.ones(1, U64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(data) + 1:
            size = len(data) + 1
            self.powers = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, U64(self.BASE))]), dtype=U64)
            self.inverses = np.cumprod(
                np.concatenate([[U64(1)], np.full(size - 1, U64(inverse(self.BASE)))]), dtype=U64
            )
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.symbols[data] * self.powers[: len(data)], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes ``start`` to ``end`` (not included), whose place does not matter."""
        return mix((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(U64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def crc(text: str) -> int:
    return zlib.crc32(text.encode())

