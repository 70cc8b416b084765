"""Substring dedup by level-wise doubling.

Level 1 looks at half windows (7 of 13 words). Of each full window only the half with the
smallest hash is looked at, so about one half window in four stands for all, and equal
windows pick equal halves. Halves that stand in one document alone end there. Level 2
extends only what is left to the full length (a 13-word window is two overlapping
halves), and finds the smallest document of each full window. `repeated_runs` goes on to
26, 52, ... words in the same way until no window of a length is repeated.

Tasks exchange packed lists (hashes and ids as byte planes) instead of a row for each
window, dealt out by ranges of the hash, so one range holds the windows of no document or
passage in particular. A batch sends a window once, however many of its rows have it, so a
passage in a third of all documents is one entry for each batch. Texts are moved once: the
same exchange by id serves level 2 and the removal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasestream.llm import words as W
from phrasestream.plans.stage import staged

WINDOW = 13
#: Bytes of packed entries a hash range should get.
RANGE_BYTES = 8 << 20
#: Entries a task gathers before it sends them on by document.
GATHERED = 2_000_000


FULL = pa.schema([("range", pa.int64()), ("hash", pa.binary()), ("more", pa.binary()), ("doc", pa.binary()), ("at", pa.binary())])


def pack(a: np.ndarray) -> bytes:
    """An array's bytes plane by plane: equal high bytes stand together and compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes()


def unpack(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def picked_halves(h: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window (given by its place among the word hashes `h`): the smallest hash of
    a half window in it, and nothing else of the text."""
    half = (length + 1) // 2
    halves = W.windows(h, half, seed=1)
    if not len(places):
        return np.zeros(0, np.uint64), halves
    least = halves[places]
    for j in range(1, length - half + 1):
        least = np.minimum(least, halves[places + j])
    return least, halves


def _hashes(part: pa.RecordBatch, length: int):
    data, offsets = W.flat(part.column("text"))
    starts, lengths, first = W.words(data, offsets)
    h = W.hash_spans(data, starts, lengths)
    places, text = W.window_places(first, length)
    return data, starts, lengths, first, h, places, text


def _by_range(hashes: np.ndarray, ranges: int, **columns: np.ndarray) -> Iterator[dict]:
    """Rows of packed columns, one for each range of the hash that has entries."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    where = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(where, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(hashes)]):
        yield {"range": int(where[a]), "hash": pack(hashes[a:b]),
               **{k: pack(v[order[a:b]]) for k, v in columns.items()}}


def _halves(length: int, ranges: int):
    def run(batches):
        for part in W.slices(batches):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            *_, h, places, text = _hashes(part, length)
            least, _ = picked_halves(h, places, length)
            if not len(least):
                continue
            # Each half once for each text: neighbours mostly pick the same one.
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
            least, text = least[new], text[new]
            order = np.lexsort((text, least))
            least, text = least[order], text[order]
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
            rows = list(_by_range(least[new], ranges, doc=ids[text[new]].astype(np.int64)))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("range", pa.int64()), ("hash", pa.binary()), ("doc", pa.binary())]))

    return run


def _ranges_together(batches, columns: dict[str, type]) -> Iterator[dict[str, np.ndarray]]:
    """The unpacked entries of each range; rows come sorted by range."""
    have: dict[str, list] = {}
    now = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["range"] != now and now is not None:
                yield {k: np.concatenate(v) for k, v in have.items()}
                have = {}
            now = row["range"]
            for k, kind in columns.items():
                have.setdefault(k, []).append(unpack(row[k], kind))
    if now is not None:
        yield {k: np.concatenate(v) for k, v in have.items()}


def _by_document(found: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """(documents, values) pairs packed by buckets of documents: a task sends a row for
    each bucket, not for each document."""
    have: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def rows():
        d, v = (np.concatenate(x) for x in zip(*have))
        where = (W.mix(d.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((d, where))
        d, v, where = d[order], v[order], where[order]
        cuts = np.flatnonzero(np.diff(where, prepend=-1))
        out = [{"range": int(where[a]), "doc": pack(d[a:b]), "value": pack(v[a:b])} for a, b in zip(cuts, [*cuts[1:], len(d)])]
        return pa.RecordBatch.from_pylist(out, pa.schema([("range", pa.int64()), ("doc", pa.binary()), ("value", pa.binary())]))

    for d, v in found:
        if len(d):
            have.append((d, v))
            size += len(d)
        if size > GATHERED:
            yield rows()
            have, size = [], 0
    if have:
        yield rows()


PACKED = "range long, doc binary, value binary"


def _lists(name: str, kind: type):
    """(doc_id, values): one row for each document of a bucket."""

    def run(batches):
        for got in _ranges_together(batches, {"doc": np.int64, "value": kind}):
            order = np.argsort(got["doc"], kind="stable")
            d, v = got["doc"][order], got["value"][order]
            ids, at = np.unique(d, return_index=True)
            cuts = np.append(at, len(d)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([v[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", name])

    return run


def _regrouped(packed: DataFrame, name: str, kind: type) -> DataFrame:
    return packed.repartition("range").sortWithinPartitions("range").mapInArrow(
        _lists(name, kind), f"doc_id long, {name} binary")


def _shared_halves(buckets: int):
    """Documents and halves, of halves that stand in more than one document."""

    def run(batches):
        def found():
            for got in _ranges_together(batches, {"hash": np.uint64, "doc": np.int64}):
                order = np.argsort(got["hash"], kind="stable")
                h, d = got["hash"][order], got["doc"][order]
                first = np.flatnonzero(np.diff(h, prepend=h[0] ^ np.uint64(1)))
                low, high = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
                keep = np.repeat(low < high, np.diff(np.append(first, len(h))))
                yield d[keep], h[keep]

        return _by_document(found(), buckets)

    return run


def _full_windows(length: int, ranges: int):
    """Level 2: full windows whose picked half is shared."""

    def run(batches):
        for part in W.slices(batches):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            *_, first, h, places, text = _hashes(part, length)
            least, _ = picked_halves(h, places, length)
            keep = np.zeros(len(places), bool)
            cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
            for i, listed in enumerate(part.column("halves")):
                got = np.frombuffer(listed.as_py(), np.uint64)
                keep[cuts[i] : cuts[i + 1]] = np.isin(least[cuts[i] : cuts[i + 1]], got)
            if keep.any():
                yield _emit_windows(h, first, places[keep], text[keep], ids, length, ranges)

    return run


def _later_windows(firsts: bool, buckets: int):
    """Documents and places of windows that also start in a smaller document. With `firsts`
    also, as ~place, those of the smallest document if another has them."""

    def run(batches):
        def found():
            for got in _ranges_together(batches, {"hash": np.uint64, "more": np.uint32, "doc": np.int64, "at": np.int32}):
                order = np.lexsort((got["more"], got["hash"]))
                h, m, d, at = (got[k][order] for k in ("hash", "more", "doc", "at"))
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (m[1:] != m[:-1])
                first = np.flatnonzero(new)
                sizes = np.diff(np.append(first, len(h)))
                low, high = (np.repeat(f.reduceat(d, first), sizes) for f in (np.minimum, np.maximum))
                keep = (low < high) if firsts else (d > low)
                yield d[keep], np.where(d > low, at, ~at)[keep].astype(np.int32)

        return _by_document(found(), buckets)

    return run


def _emit_windows(h, first, places, text, ids, length, ranges):
    full = W.windows(h, length, seed=2)[places]
    more = (W.windows(h, length, seed=3)[places] >> np.uint64(32)).astype(np.uint32)
    rows = list(_by_range(full, ranges, more=more, doc=ids[text], at=(places - first[text]).astype(np.int32)))
    return pa.RecordBatch.from_pylist(rows, FULL)


def _doubled(length: int, ranges: int):
    """Windows of twice the length whose two halves are both repeated."""

    def run(batches):
        for part in W.slices(batches):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            *_, first, h, places, text = _hashes(part, length)
            keep = np.zeros(len(places), bool)
            cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
            for i, listed in enumerate(part.column("places")):
                at = np.frombuffer(listed.as_py(), np.int32)
                at = np.where(at < 0, ~at, at)
                mine = places[cuts[i] : cuts[i + 1]] - first[i]
                keep[cuts[i] : cuts[i + 1]] = np.isin(mine, at) & np.isin(mine + length // 2, at)
            if keep.any():
                yield _emit_windows(h, first, places[keep], text[keep], ids, length, ranges)

    return run


def _unfolded(batches):
    for batch in batches:
        for row in batch.to_pylist():
            at = np.frombuffer(row["places"], np.int32)
            at = at[at >= 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), row["doc_id"])), pa.array(at), pa.array(np.full(len(at), row["words"], np.int32))],
                ["doc_id", "at", "words"])


def _removed(length: int, with_text: bool):
    def run(batches):
        for part in W.slices(batches):
            data, offsets = W.flat(part.column("text"))
            starts, lengths, first = W.words(data, offsets)
            counts = np.diff(first)
            kept, removed = [], []
            for i, listed in enumerate(part.column("places")):
                n = int(counts[i])
                cover = np.zeros(n + 1, np.int32)
                at = np.frombuffer(listed.as_py() or b"", np.int32)
                np.add.at(cover, at, 1)
                np.add.at(cover, np.minimum(at + length, n), -1)
                stay = np.flatnonzero(np.cumsum(cover[:n]) == 0) + first[i]
                removed.append(n - len(stay))
                kept.append(b" ".join(data[s : s + k].tobytes() for s, k in zip(starts[stay].tolist(), lengths[stay].tolist())))
            columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                       pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array([k.decode("utf-8", "replace") for k in kept]))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _later_places(known: DataFrame, by_id: DataFrame, length: int, ranges: int, firsts: bool = False) -> DataFrame:
    """doc_id and packed places of the windows of `length` words that stand in a smaller
    document too."""
    halves = known.mapInArrow(_halves(length, ranges), "range long, hash binary, doc binary")
    shared = halves.repartition("range").sortWithinPartitions("range").mapInArrow(_shared_halves(ranges), PACKED)
    lists = staged(_regrouped(shared, "halves", np.uint64), "substring-halves")
    full = by_id.join(lists, "doc_id").mapInArrow(
        _full_windows(length, ranges), "range long, hash binary, more binary, doc binary, at binary")
    return _found(full, ranges, firsts)


def _found(full: DataFrame, ranges: int, firsts: bool) -> DataFrame:
    later = full.repartition("range").sortWithinPartitions("range").mapInArrow(_later_windows(firsts, ranges), PACKED)
    return _regrouped(later, "places", np.int32)


def _ready(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rows with an id, the same dealt out by id, rows without one, and how many hash
    ranges their size asks for."""
    docs = W.text_frame(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    known = docs.filter("doc_id is not null")
    return known, known.repartition("doc_id"), docs.filter("doc_id is null"), int(max(16, size * 2 // RANGE_BYTES))


def remove_repeats(docs: DataFrame, length: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (`with_text`: also kept) of each row.

    A word goes if a window of `length` words that covers it also starts in a document
    with a smaller id. Windows are judged on the input. Rows of null id neither lose words
    nor take any from others; rows of equal id take none from each other; a null text has no
    words. Only doc_id and text of `docs` are read.
    """
    known, by_id, others, ranges = _ready(docs)
    places = _later_places(known, by_id, length, ranges)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    whole = others.withColumn("places", F.lit(None).cast("binary"))
    return by_id.join(places, "doc_id", "left").mapInArrow(_removed(length, with_text), out).unionByName(
        whole.mapInArrow(_removed(length, with_text), out))


def repeated_runs(docs: DataFrame, length: int = WINDOW, levels: int = 20) -> DataFrame:
    """doc_id, at, words: windows that also start in a smaller document, at each of the
    lengths length, 2 length, 4 length, ... A window is only looked at if both its halves
    were found repeated, and the levels end when none survives."""
    known, by_id, _, ranges = _ready(docs)
    found, now = [], length
    places = staged(_later_places(known, by_id, now, ranges, firsts=True), "substring-level")
    while levels and places.limit(1).count():
        found.append(places.withColumn("words", F.lit(now)))
        now, levels = now * 2, levels - 1
        longer = by_id.join(places.select("doc_id", "places"), "doc_id").mapInArrow(_doubled(now, ranges), "range long, hash binary, more binary, doc binary, at binary")
        first = staged(longer, "substring-doubled")
        places = staged(_found(first, ranges, firsts=True), "substring-level")
    if not found:
        return places.select("doc_id", F.lit(0).alias("at"), F.lit(now).alias("words")).limit(0)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.mapInArrow(_unfolded, "doc_id long, at int, words int")
