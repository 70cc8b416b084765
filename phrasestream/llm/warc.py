"""WARC archives as a chunked record table.

`write_archives` turns payloads into rows of record and chunk number before any of them
reaches a Python worker, and writes each record from its chunks: one gzip member a record,
compressed as the chunks come by. `read_archives` gives the same table back: a task streams
a file, inflates a bounded piece at a time and hands on one row a chunk, with the digest of
the payload up to there, so neither side holds a record that is larger than a chunk.

Payloads that occur again are revisit records. Which one is the response is decided on the
digests alone, before the archives are written. Files get their name from the attempt that
writes them, and only those in the manifest (committed by Spark) are read, so a lost
executor or a task that ran twice leaves nothing behind that counts.

Files are opened through Arrow's file systems, so archives may lie wherever those reach
(file, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasestream.plans.stage import shared_folder, staged

CHUNK_BYTES = 64 << 10
#: A task begins another file when one has so many bytes.
FILE_BYTES = 256 << 20
#: Smaller payloads are never revisits.
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_FIELD, REFERS_FIELD = "X-Page-Id", "X-Refers-To-Page-Id"

CHUNK = "file string, record long, record_id string, record_type string, page_id long, target_uri string, refers_to_id string, " \
    "refers_to long, declared_digest string, declared_bytes long, chunk long, bytes_so_far long, digest_so_far string, last boolean, data binary"
_CHUNK = pa.schema([
    ("file", pa.string()), ("record", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()),
    ("target_uri", pa.string()), ("refers_to_id", pa.string()), ("refers_to", pa.int64()), ("declared_digest", pa.string()),
    ("declared_bytes", pa.int64()), ("chunk", pa.int64()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()),
    ("last", pa.bool_()), ("data", pa.binary())])


class BadArchive(ValueError):
    """A record that is cut off, or whose header cannot be read."""


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


# ---- writing ---------------------------------------------------------------------------


def record_id(page_id: Column, digest: Column) -> Column:
    """The id of a page's record: rows that repeat a page with its payload share it."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("none")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def with_types(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, bytes, digest, refers_to: the smallest page_id with an equal
    payload of `least` bytes or more, null for responses."""
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
        F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    groups = rows.filter(F.col("bytes") >= least).groupBy(F.col("digest").alias("_digest")).agg(
        F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    met = rows.join(groups, F.col("digest") == F.col("_digest"), "left")
    return met.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))).drop("_digest", "_first", "_n")


def chunked(typed: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of each record, in order and side by side. A revisit, or an
    empty payload, is one chunk without bytes."""
    whole = F.when(F.col("refers_to").isNull(), F.col("bytes")).otherwise(0)
    last = F.floor(F.greatest(whole - 1, F.lit(0)) / chunk_bytes).cast("int")
    rows = typed.withColumn("last_chunk", last).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("last_chunk"))))
    data = F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return rows.select(
        "page_id", "url", "bytes", "digest", "refers_to", record_id(F.col("page_id"), F.col("digest")).alias("record_id"),
        F.when(F.col("refers_to").isNotNull(), record_id(F.col("refers_to"), F.col("digest"))).alias("refers_to_id"),
        "chunk", (F.col("chunk") == F.col("last_chunk")).alias("last"), data.alias("data"))


def _header(fields: list[tuple[str, object]]) -> bytes:
    # A line break within a value would end the field.
    lines = ["WARC/1.1", *(f"{k}: {' '.join(str(v).split())}" for k, v in fields if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record_head(row: dict) -> bytes:
    """Everything before the payload: the WARC header and the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    revisit = row["refers_to_id"] is not None
    return _header([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", row["url"]), (PAGE_FIELD, row["page_id"]),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", f"<{row['refers_to_id']}>" if revisit else None), (REFERS_FIELD, row["refers_to"]),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(http) + (0 if revisit else row["bytes"])),
    ]) + http


class ArchiveWriter:
    """Writes records chunk by chunk into files of about `file_bytes`."""

    def __init__(self, folder: str, name: str, file_bytes: int):
        self.fs, self.folder = opened(folder)
        self.name, self.file_bytes = name, file_bytes
        self.out, self.files, self.written = None, [], 0

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _begin_file(self) -> None:
        name = f"{self.name}-{len(self.files):05d}.warc.gz"
        self.fs.create_dir(self.folder, recursive=True)
        self.out = self.fs.open_output_stream(f"{self.folder}/{name}", compression=None)
        self.files.append([name, 0, 0])
        self.written = 0
        body = b"software: phrasestream\r\nformat: WARC File Format 1.1\r\n"
        head = _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE),
                        ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(body))])
        self._write(zlib.compress(head + body + b"\r\n\r\n", wbits=31))

    def begin(self, head: bytes) -> None:
        if self.out is None or self.written >= self.file_bytes:
            self.close()
            self._begin_file()
        self.member = zlib.compressobj(wbits=31)
        self._write(self.member.compress(head))

    def put(self, data: bytes) -> None:
        self._write(self.member.compress(data))

    def end(self) -> None:
        self._write(self.member.compress(b"\r\n\r\n") + self.member.flush())
        self.files[-1][2] += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files[-1][1] = self.written
            self.out = None


def write_archives(pages: DataFrame, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES,
                   file_bytes: int = FILE_BYTES, least: int = REVISIT_BYTES) -> DataFrame:
    """Archives of `pages` (page_id, url, html) under `folder`; the manifest: path, bytes, records.

    A null html is an empty payload, a null url a record without WARC-Target-URI. Rows of a
    null page_id are never referred to while another row has the payload. Rows that share
    the smallest page_id of a payload are all responses. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    columns = ("page_id", "url", "bytes", "digest", "refers_to", "record_id", "refers_to_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer = ArchiveWriter(folder, f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}", file_bytes)
        for batch in batches:
            data = batch.column("data")
            heads = {c: batch.column(c) for c in columns}
            for i, (chunk, last) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("last").to_pylist())):
                if chunk == 0:
                    writer.begin(record_head({c: v[i].as_py() for c, v in heads.items()}))
                writer.put(data[i].as_py())
                if last:
                    writer.end()
        writer.close()
        for name, size, records in writer.files:
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": pa.array([size], pa.int64()), "records": pa.array([records], pa.int64())})

    files = chunked(with_types(pages, least), chunk_bytes).mapInArrow(write, "path string, bytes long, records long")
    manifest = f"{folder}/manifest"
    files.write.parquet(manifest)
    return spark.read.schema("path string, bytes long, records long").parquet(manifest)


# ---- reading ---------------------------------------------------------------------------


def inflated(source, piece: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The bytes of a file, at most `piece` at a time, whether it is gzip members or plain."""
    fresh = source.read(piece)
    if fresh[:2] != b"\x1f\x8b":
        while fresh:
            yield fresh
            fresh = source.read(piece)
        return
    member = None
    while fresh or (fresh := source.read(piece)) or member is not None:
        member = member or zlib.decompressobj(wbits=31)
        out = member.decompress(fresh, piece)
        if out:
            yield out
        elif not fresh and not member.eof:
            raise BadArchive("the last record is cut off")
        fresh = member.unconsumed_tail
        if member.eof:
            fresh, member = member.unused_data, None


class Stream:
    """Lines and bounded pieces of what `inflated` yields, across members."""

    def __init__(self, source, piece: int):
        self.pieces, self.held, self.done = inflated(source, piece), bytearray(), False

    def _more(self) -> bool:
        try:
            self.held += next(self.pieces)
        except StopIteration:
            self.done = True
        return not self.done

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """Bytes up to and with `mark`; None at the end of the file."""
        looked = 0
        while (at := self.held.find(mark, looked)) < 0:
            looked = max(0, len(self.held) - len(mark) + 1)
            if len(self.held) > most:
                raise BadArchive("a header without an end")
            if not self._more():
                if self.held.strip():
                    raise BadArchive("a header is cut off")
                return None
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        """Up to n bytes that follow, as many as are at hand; empty at the end of the file."""
        if not self.held and not self._more():
            return b""
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def records(source, chunk_bytes: int) -> Iterator[tuple[dict, int, int, bytes, bool]]:
    """(fields, number of the record, number of the chunk, payload of the chunk, last) of all
    records but warcinfo. A record's payload is what follows its HTTP header, if it has one."""
    stream, no = Stream(source, chunk_bytes), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        fields = fields_of(head)
        if not head.startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
            raise BadArchive("not a record: " + repr(head[:40]))
        left = int(fields["content-length"])
        if "application/http" in fields.get("content-type", ""):
            http = stream.until(b"\r\n\r\n") or b""
            left -= len(http)
            fields |= {f"http-{k}": v for k, v in fields_of(http).items()}
        chunk, payload = 0, bytearray()
        while left:
            got = stream.take(min(left, chunk_bytes - len(payload)))
            if not got:
                raise BadArchive("the last record is cut off")
            payload += got
            left -= len(got)
            if left and len(payload) == chunk_bytes:
                yield fields, no, chunk, bytes(payload), False
                chunk, payload = chunk + 1, bytearray()
        if fields.get("warc-type") != "warcinfo":
            yield fields, no, chunk, bytes(payload), True
            no += 1


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, files: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of archives, given by their `path`: a row for each chunk of
    each record, with the bytes and the SHA-256 of the payload up to its end. `with_data`
    False leaves the bytes out and gives each record's last chunk only. A file that is cut
    off fails the job."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = opened(path)
                rows, held, digest, size = [], 0, None, 0
                with fs.open_input_stream(at, compression=None) as source:
                    for fields, record, chunk, data, last in records(source, chunk_bytes):
                        if chunk == 0:
                            digest, size = hashlib.sha256(), 0
                        digest.update(data)
                        size += len(data)
                        if last or with_data:
                            strip = lambda v: v.strip("<>") if v else None
                            rows.append((
                                path, record, strip(fields.get("warc-record-id")), fields.get("warc-type"), _number(fields.get(PAGE_FIELD.lower())),
                                fields.get("warc-target-uri"), strip(fields.get("warc-refers-to")), _number(fields.get(REFERS_FIELD.lower())),
                                fields.get("warc-payload-digest"), _number(fields.get("http-content-length")), chunk, size,
                                digest.hexdigest(), last, data if with_data else None))
                            held += len(data)
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    # A file is a task's work: AQE must not fold the few rows of paths into one task.
    paths = files.select("path").repartition(max(1, files.count()))
    return paths.mapInArrow(read, CHUNK)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNK)], schema=_CHUNK)


def page_records(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record read.

    A response's figures are those of the bytes read. A revisit's are those of the response
    it refers to, found by record id; without one among the records, those it states."""
    done = staged(chunks.filter("last").select(
        "page_id", "record_id", "record_type", "refers_to_id", "refers_to", "bytes_so_far", "digest_so_far", "declared_bytes",
        F.regexp_replace("declared_digest", "^sha256:", "").alias("declared")), "warc-records")
    responses = done.filter("record_type = 'response'").groupBy(F.col("record_id").alias("_id")).agg(
        F.min("page_id").alias("_page"), F.max("bytes_so_far").alias("_bytes"), F.max("digest_so_far").alias("_digest"))
    # What a plan over paths is thought to yield says nothing about the records in the files:
    # without the hint their table would be broadcast whatever its size.
    revisits = done.filter("record_type = 'revisit'").join(responses.hint("merge"), F.col("refers_to_id") == F.col("_id"), "left")
    return done.filter("record_type = 'response'").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(revisits.select(
        "page_id", F.coalesce("_bytes", "declared_bytes").alias("payload_bytes"), F.coalesce("_digest", "declared").alias("payload_digest"),
        "record_type", F.coalesce("_page", "refers_to").alias("refers_to")))
