"""Words of Arrow text columns as numpy arrays, and stable 64-bit hashes of them.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Texts are worked on in
slices of a few MB, so memory does not follow the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _seed(k: int) -> np.uint64:
    return np.uint64(k * int(_ODD) & int(_ALL))


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """The fold of a row: crc32 of the id as text. A null id has fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` has about `most` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, with 8 more behind, and the n + 1 offsets. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.zeros(hi - lo + 8, np.uint8)
    if hi > lo:
        data[: hi - lo] = np.frombuffer(column.buffers()[2], np.uint8)[lo:hi]
    return data, offsets - lo


def runs(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of one kind other than 0 (`kinds`: kind of each byte
    value): starts, lengths, and the n + 1 places where each text's runs begin."""
    n = int(offsets[-1])
    kind = kinds[data[:n]].astype(np.uint8)
    edge = np.ones(n + 1, bool)
    if n:
        edge[1:n] = kind[1:] != kind[:-1]
        edge[offsets[:-1][offsets[:-1] < n]] = True
    at = np.flatnonzero(edge)
    starts, lengths = at[:-1], np.diff(at)
    keep = kind[starts] != 0
    starts, lengths = starts[keep], lengths[keep]
    return starts, lengths, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(data, offsets, ~SPACES)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, read eight bytes at a time."""
    loads = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = mix(lengths.astype(np.uint64) + _seed(seed + 1))
    left, at, which = lengths.astype(np.int64), starts, None
    while len(at):
        short = np.minimum(left, 8).astype(np.uint64)
        mask = np.where(short == 8, _ALL, (np.uint64(1) << ((short % 8) * np.uint64(8))) - np.uint64(1))
        step = loads[at] & mask
        if which is None:
            h = mix(h ^ (step * _ODD))
            which = np.flatnonzero(left > 8)
        else:
            h[which] = mix(h[which] ^ (step * _ODD))
            which = which[left > 8]
        more = left > 8
        at, left = at[more] + 8, left[more] - 8
    return h


def windows(h: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of each `length` hashes in a row; the last length - 1 places have none."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, _seed(seed + 3), np.uint64)
    for j in range(length):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(acc)


def window_places(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows lie within one text: their places, and the text of each."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(first[:-1], counts) + inside, text


def word_count(text: Column) -> Column:
    """Words of a text column, by Spark's own functions; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_frame(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator works on: other columns of the input, whatever
    their names, never reach it."""
    return docs.select(*(docs[c] for c in columns))
