"""WAV files as a splittable Spark data source.

Planning reads each file's header once and cuts its samples into ranges of whole frames; a
task seeks to its range and reads it frame by frame. So a long recording is read by many
tasks, short ones share a task, and no file is ever in one cell. Paths may be a file, a
folder (searched through) or a pattern, on any file system Arrow reaches.

    spark.dataSource.register(WavDataSource)
    spark.read.format("wav_frames").option("frame_ms", 100).load("hdfs:///recordings")
"""

from __future__ import annotations

import fnmatch
import os
import re
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from phrasestream import schemas

#: Sound a task reads, and what opening another file counts for when files share a task.
SPLIT_BYTES = 64 << 20
OPEN_BYTES = 1 << 20
#: Sound handed on in one batch.
BATCH_BYTES = 4 << 20
HEADER_THREADS = 32
PCM, EXTENSIBLE = 1, 0xFFFE

FRAMES = pa.schema([
    ("session_id", pa.string()), ("seq", pa.int64()), ("pcm", pa.binary()),
    ("sample_rate", pa.int32()), ("t_audio", pa.float64()), ("t_wall", pa.float64()),
])


class NotPcm(ValueError):
    """Not 16-bit mono sound, or not a WAV file."""


class Header(NamedTuple):
    rate: int
    data_at: int
    data_bytes: int


def wav_header(name: str, stream, size: int) -> Header:
    """Rate, place and length of the sound. The length is at most what the file has: writers
    that cannot go back leave it open, and a cut-off file has less than it says."""
    def take(n: int) -> bytes:
        found = stream.read(n)
        if len(found) < n:
            raise NotPcm(f"{name}: no sound in the file")
        return bytes(found)

    form, _, kind = struct.unpack("<4sI4s", take(12))
    if form not in (b"RIFF", b"RF64") or kind != b"WAVE":
        raise NotPcm(f"{name}: not a WAV file")
    at, rate, long_bytes = 12, None, None
    while True:
        tag, length = struct.unpack("<4sI", take(8))
        at += 8
        if tag == b"data":
            if rate is None:
                raise NotPcm(f"{name}: sound before its format")
            if length == 0xFFFFFFFF:
                length = size - at if long_bytes is None else long_bytes
            return Header(rate, at, min(length, size - at) // 2 * 2)
        body = take(length + length % 2)
        at += len(body)
        if tag == b"ds64":
            long_bytes = struct.unpack("<Q", body[8:16])[0]
        elif tag == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if code == EXTENSIBLE and len(body) >= 26:
                code = struct.unpack("<H", body[24:26])[0]
            if (code, channels, bits) != (PCM, 1, 16) or not rate:
                raise NotPcm(f"{name}: expected 16-bit mono audio")


@dataclass
class Span:
    """Frames `first` up to `end` of a file; the last one may be short."""

    path: str
    session_id: str
    rate: int
    data_at: int
    data_bytes: int
    first: int
    end: int

    def frame_bytes(self, frame_ms: int) -> int:
        return 2 * frame_samples(self.rate, frame_ms)


@dataclass
class Spans(InputPartition):
    spans: list[Span]


def write_recordings(frames: DataFrame, folder: str) -> DataFrame:
    """One WAV file for each session of `frames` (session_id, seq, pcm, sample_rate) under
    `folder`, written frame by frame in order of seq; session_id, path, bytes. A file's name
    and content depend on its session alone, so a task that runs again writes it again."""
    # The window keeps a session in one task. A repartition after a join by session does not: it is
    # left out as done already, and the join gives its layout up if it becomes a broadcast one.
    whole = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = frames.select("session_id", "seq", "pcm", "sample_rate").filter("session_id is not null and pcm is not null").withColumn(
        "_bytes", F.sum(F.octet_length("pcm")).over(whole)).sortWithinPartitions("session_id", "seq")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, {"session_id": [], "path": [], "bytes": []}
        fs, inner = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(inner, recursive=True)
        for batch in batches:
            for session, pcm, rate, size in zip(*(batch.column(c).to_pylist() for c in ("session_id", "pcm", "sample_rate", "_bytes"))):
                if not done["session_id"] or done["session_id"][-1] != session:
                    if out:
                        out.close()
                    name = f"{session}.wav"
                    out = fs.open_output_stream(f"{inner}/{name}", compression=None)
                    out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", min(36 + size, 0xFFFFFFFF), b"WAVE", b"fmt ", 16, PCM, 1, rate, 2 * rate, 2, 16, b"data", min(size, 0xFFFFFFFF)))
                    for column, value in (("session_id", session), ("path", f"{folder}/{name}"), ("bytes", size)):
                        done[column].append(value)
                out.write(pcm)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({**done, "bytes": pa.array(done["bytes"], pa.int64()), "session_id": pa.array(done["session_id"], batch.schema.field("session_id").type)})

    kind = frames.schema["session_id"].dataType.simpleString()
    return ordered.mapInArrow(write, f"session_id {kind}, path string, bytes long")


def frame_samples(rate: int, frame_ms: int) -> int:
    return max(1, rate * frame_ms // 1000)


def listed(path: str) -> list[tuple[str, pyarrow.fs.FileSystem, pyarrow.fs.FileInfo]]:
    """The WAV files of a path: their URIs, where to open them, and what is known of them."""
    if not re.match(r"\w+:", path):
        path = "file://" + os.path.abspath(path)
    if path.startswith("file:"):
        path = re.sub("^file:/*", "file:///", path)
    fixed = re.match(r"[^*?\[]*", path).group()
    top = path if fixed == path else fixed[: fixed.rfind("/")]
    fs, inner = pyarrow.fs.FileSystem.from_uri(top)
    lead = top[: len(top.rstrip("/")) - len(inner.rstrip("/"))]
    info = fs.get_file_info(inner)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True))
    files = [(lead + f.path, fs, f) for f in found if f.is_file and f.path.lower().endswith(".wav")]
    return sorted((f for f in files if fixed == path or fnmatch.fnmatchcase(f[0], path)), key=lambda f: f[0])


class WavReader(DataSourceReader):
    def __init__(self, path: str, frame_ms: int, split_bytes: int):
        self.path, self.frame_ms, self.split_bytes = path, frame_ms, split_bytes

    def partitions(self) -> list[InputPartition]:
        def head(found: tuple) -> tuple[str, Header]:
            uri, fs, info = found
            with fs.open_input_file(info.path) as f:
                return uri, wav_header(uri, f, info.size)

        parts, open_part, filled = [], [], 0
        with ThreadPoolExecutor(HEADER_THREADS) as pool:
            for uri, header in pool.map(head, listed(self.path)):
                name = re.sub(r"\.[^./]*$", "", uri)
                size = 2 * frame_samples(header.rate, self.frame_ms)
                frames = -(-header.data_bytes // size)
                step = max(1, self.split_bytes // size)
                for first in range(0, frames, step):
                    end = min(first + step, frames)
                    cost = (end - first) * size + OPEN_BYTES
                    if open_part and filled + cost > self.split_bytes + OPEN_BYTES:
                        parts.append(Spans(open_part))
                        open_part, filled = [], 0
                    open_part.append(Span(uri, name, *header, first, end))
                    filled += cost
        return [*parts, Spans(open_part)] if open_part else [Spans([])]

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        for span in partition.spans:
            fs, path = pyarrow.fs.FileSystem.from_uri(span.path)
            size = span.frame_bytes(self.frame_ms)
            per_batch = max(1, BATCH_BYTES // size)
            with fs.open_input_file(path) as f:
                f.seek(span.data_at + span.first * size)
                for first in range(span.first, span.end, per_batch):
                    stop = min(min(first + per_batch, span.end) * size, span.data_bytes)
                    sound = f.read(stop - first * size)
                    yield self._batch(span, first, bytes(sound), size)

    @staticmethod
    def _batch(span: Span, first: int, sound: bytes, size: int) -> pa.RecordBatch:
        pieces = [sound[at : at + size] for at in range(0, len(sound), size)]
        numbers = range(first, first + len(pieces))
        starts = [seq * (size // 2) / span.rate for seq in numbers]
        return pa.RecordBatch.from_arrays([
            pa.array([span.session_id] * len(pieces), pa.string()), pa.array(numbers, pa.int64()), pa.array(pieces, pa.binary()),
            pa.array([span.rate] * len(pieces), pa.int32()), pa.array(starts, pa.float64()), pa.array(starts, pa.float64()),
        ], schema=FRAMES)


class WavDataSource(DataSource):
    """S4. Options: frame_ms (100) and split_bytes (64 MB of sound)."""

    @classmethod
    def name(cls) -> str:
        return "wav_frames"

    def schema(self) -> str:
        return schemas.FRAMES

    def reader(self, schema) -> WavReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("wav_frames needs a path")
        frame_ms, split = int(self.options.get("frame_ms", 100)), int(self.options.get("split_bytes", SPLIT_BYTES))
        if frame_ms <= 0 or split <= 0:
            raise ValueError("frame_ms and split_bytes must be above 0")
        return WavReader(path, frame_ms, split)
