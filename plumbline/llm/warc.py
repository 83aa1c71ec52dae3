"""WARC archives, and their records as a table of chunks.

``write_archives`` writes one record for each page into gzip members of ``.warc.gz`` files
in a shared folder; ``read_chunks`` reads such files back as rows of a record identifier,
a chunk number and a bounded piece of the payload. Every chunk carries the number of
payload bytes up to its end and the SHA-1 of them, continued from the chunk before, so
that a record of any size is checked while it streams past and is nowhere held whole.
The digest of the last chunk is the digest of the payload.

Of records with equal payloads (SHA-1 and length) of at least ``least`` bytes, the one
with the largest page_id is written in full; the others become revisit records that refer
to it and hold the HTTP header only.

Defined results: a null html is an empty payload; an empty payload has one chunk without
data. A page without url has no target URI; characters that may not stand in a header are
percent-encoded. Rows repeated with the same page_id are written each; all rows with the
largest page_id of a group are responses. A null page_id counts as smaller than any other
and reads back as null. Other columns of the pages are not archived. Tables without rows
give no archives and no records.

A lost task writes its archive anew under another name; only names that finished tasks
have reported are read. The folder must be one that all executors reach, by a path
(``file``, ``hdfs``, ``s3``, ``gs``) that Arrow's file systems open.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import mapped, written
from plumbline.session import scratch_path

CHUNK = 256 << 10
ROTATE = 512 << 20
LEAST = 1000
ID_PREFIX = "urn:page:"
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRAWLED = "1970-01-01T00:00:00Z"

FILES = "path string, records long"
CHUNKS = (
    "record_id string, record_type string, target_uri string, refers_to string, declared_digest string, "
    "declared_bytes long, chunk_no long, data binary, bytes_so_far long, digest_so_far string, last boolean"
)


def with_record_types(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload and the page that each revisit refers to (null for responses)."""
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    copies = (
        rows.where(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and original is not null")
        .select("digest", "size", "original")
    )
    # Only digests that occur more than once are left, so the join is small unless copies abound.
    copies = written(copies, "warc-copies")
    rows = rows.join(copies, ["digest", "size"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return rows.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("original")).alias("original"))


class ArchiveWriter:
    """One archive file after another, each record a gzip member of its own."""

    def __init__(self, folder: str, level: int):
        self.system, self.place = fs.FileSystem.from_uri(folder)
        self.folder = folder.rstrip("/")
        self.level = level
        self.stream = None

    def _open(self) -> None:
        name = f"{uuid.uuid4().hex}.warc.gz"
        self.path = f"{self.folder}/{name}"
        self.stream = self.system.open_output_stream(f"{self.place}/{name}", compression=None)
        self.records = self.size = 0

    def close(self) -> list[dict]:
        if self.stream is None:
            return []
        self.stream.close()
        self.stream = None
        return [{"path": self.path, "records": self.records}]

    def add(self, page_id, url, payload, digest: str, original) -> list[dict]:
        """Writes a record; gives the file that it completed, if any."""
        if self.stream is None:
            self._open()
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        body = payload if original is None else memoryview(b"")
        head = [
            ("WARC-Type", "response" if original is None else "revisit"),
            ("WARC-Record-ID", f"<{ID_PREFIX}{'' if page_id is None else page_id}>"),
            ("WARC-Date", CRAWLED),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ]
        if url is not None:
            head.append(("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~")))
        if original is not None:
            head += [("WARC-Refers-To", f"<{ID_PREFIX}{original}>"), ("WARC-Profile", REVISIT)]
        head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(body)))]
        member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        lines = "".join(f"{name}: {value}\r\n" for name, value in head)
        self._put(member.compress(VERSION + b"\r\n" + lines.encode() + b"\r\n" + http))
        for start in range(0, len(body), CHUNK):
            self._put(member.compress(body[start : start + CHUNK]))
        self._put(member.compress(b"\r\n\r\n") + member.flush())
        self.records += 1
        return self.close() if self.size >= ROTATE else []

    def _put(self, data: bytes) -> None:
        self.size += len(data)
        self.stream.write(data)


def write_archives(pages: DataFrame, folder: str, level: int = 1, least: int = LEAST) -> DataFrame:
    """Writes the pages; returns a table of the archive files (path, records)."""
    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, schema = ArchiveWriter(folder, level), pa.schema([("path", pa.string()), ("records", pa.int64())])
        for batch in stream:
            done = []
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "digest", "original")]
            for page_id, url, payload, digest, original in zip(*columns, strict=True):
                body = memoryview(payload.as_buffer())
                done += writer.add(page_id.as_py(), url.as_py(), body, digest.as_py(), original.as_py())
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        yield pa.RecordBatch.from_pylist(writer.close(), schema=schema)

    return written(mapped(with_record_types(pages, least), run, FILES), "warc-files")


class Members:
    """The decompressed bytes of an archive, a bounded piece at a time."""

    def __init__(self, stream):
        self.stream, self.pending, self.raw = stream, bytearray(), b""
        self.member = zlib.decompressobj(31)

    def fill(self) -> bool:
        """Decompresses some more; false at the end of the file."""
        while True:
            if self.member.eof:
                self.raw, self.member = self.member.unused_data or self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    return False
            got = self.member.decompress(self.raw, CHUNK)
            self.raw = b"" if self.member.eof else self.member.unconsumed_tail
            if got:
                self.pending += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        at = self.pending.find(mark)
        while at < 0:
            searched = max(0, len(self.pending) - len(mark) + 1)
            if not self.fill():
                return None
            at = self.pending.find(mark, searched)
        return self.take(at + len(mark))

    def take(self, size: int) -> bytes:
        """Up to ``size`` bytes; fewer only at the end of the file."""
        while len(self.pending) < size and self.fill():
            pass
        got = bytes(self.pending[:size])
        del self.pending[:size]
        return got


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k.strip()}


def records(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """The chunk rows of all records of one archive."""
    data = Members(stream)
    while (head := data.until(b"\r\n\r\n")) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError("an archive holds something that is no WARC record")
        fields = _fields(head.partition(b"\r\n")[2])
        http = data.until(b"\r\n\r\n")
        left = int(fields["content-length"]) - len(http)
        digest, size, number = hashlib.sha1(usedforsecurity=False), 0, 0
        declared = fields.get("warc-payload-digest", "")
        row = {
            "record_id": fields["warc-record-id"].strip("<>"),
            "record_type": fields["warc-type"],
            "target_uri": fields.get("warc-target-uri"),
            "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
            "declared_digest": base64.b32decode(declared[5:]).hex() if declared.startswith("sha1:") else None,
            "declared_bytes": int(_fields(http.partition(b"\r\n")[2]).get("content-length", left)),
        }
        while True:
            piece = data.take(min(chunk, left))
            left -= len(piece)
            if left and not piece:
                raise ValueError(f"record {row['record_id']} is cut off")
            digest.update(piece)
            size += len(piece)
            yield row | {
                "chunk_no": number, "data": piece, "bytes_so_far": size,
                "digest_so_far": digest.hexdigest(), "last": left == 0,
            }
            number += 1
            if left == 0:
                break
        data.take(4)


def read_chunks(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The records of archives named in column ``path``, as rows of bounded chunks."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split(" ")[0] for part in CHUNKS.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[part.split(" ")[1]]) for n, part in zip(names, CHUNKS.split(", "), strict=True)])
        for batch in stream:
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with system.open_input_stream(place, compression=None) as file:
                    for row in records(file, chunk):
                        rows.append(row)
                        size += len(row["data"]) + 200
                        if size >= 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # One file at least a task: archives are of bounded size, and rows are nothing to move.
    spread = files.select("path").repartition(max(2, files.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return mapped(spread, run, CHUNKS)


def record_table(chunks: DataFrame) -> DataFrame:
    """One row for each record read back, from its last chunk, checked against what its header declares.

    Fails when a payload differs from its declared digest. A revisit's length and digest are
    those declared for the payload that it refers to.
    """
    page = lambda c: F.regexp_replace(c, f"^{ID_PREFIX}", "").try_cast("bigint")
    good = (F.col("record_type") == "revisit") | (F.col("digest_so_far") == F.col("declared_digest"))
    bad = F.raise_error(F.concat(F.lit("payload of another digest than declared: "), F.col("record_id")))
    return chunks.where("last").select(
        page(F.col("record_id")).alias("page_id"),
        F.when(F.col("record_type") == "revisit", F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(good, F.col("declared_digest")).otherwise(bad.cast("string")).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )


def archive_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
