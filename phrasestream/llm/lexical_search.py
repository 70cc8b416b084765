"""Ranked lexical search over hashed max-sketches of documents.

`index` reads every text once. Of each document it keeps its terms (64-bit hashes with how
often each occurs) and a sketch: two coordinates for each term, each holding the largest
count folded into it, in a width of 8 to 16 coordinates for each distinct term. A term's
impact grows with its count, so coordinatewise maxima of counts are maxima of impacts, and
they stay right when documents are added and the corpus' statistics change.

`search` takes the queries in blocks of bounded size. A task looks all terms of a block up
in the sketches of a batch of documents at once; the smaller of a term's two coordinates,
times its weight, bounds its impact from above, and a product of matrices sums the bounds
for each query. Then each query's documents are rescored exactly from their terms, highest
bound first, until no bound reaches the task's tenth score so far. Tasks hand on ten rows a
query, which are ranked in two levels. So no term's list of documents exists anywhere: a
word in every document is one coordinate in each, and no key is hot.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasestream.llm import words as W
from phrasestream.plans.stage import shared_folder, staged

TOP = 10
#: Text of the queries that are looked up together; each block reads the index twice.
BLOCK_BYTES = 1 << 20
#: Coordinates for each distinct term, at least; widths are powers of two.
ROOM = 8
LEAST_WIDTH = 64
#: Sketches hold counts in a byte: this one stands for itself and all larger ones.
MOST = 255
#: What 1e9 tf div (1000 tf + 8 m) never exceeds.
CEILING = 1_000_000
#: Documents times terms looked up in one step.
CELLS = 2_000_000

TERM_BYTES = np.ones(256, bool)
for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    TERM_BYTES[low : high + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

INDEX = "doc_id long, n long, sketch binary, terms binary, counts binary"
_INDEX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary())])


def hashed_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms in a column of texts, and the n + 1 places where each text's begin."""
    data, offsets = W.flat(column)
    data = LOWER[data]
    starts, lengths, first = W.runs(data, offsets, TERM_BYTES)
    return W.hash_spans(data, starts, lengths, seed=11), first


def _second(h: np.ndarray) -> np.ndarray:
    return W.mix(h ^ np.uint64(0xA5A5A5A5C3C3C3C3))


def _cells(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A cell of bytes for each run of `values` between two places of `first`."""
    offsets = (first * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _indexed(batch: pa.RecordBatch) -> pa.RecordBatch:
    h, first = hashed_terms(batch.column("text"))
    n = np.diff(first)
    rows = np.arange(len(n))
    row = np.repeat(rows, n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[new, len(h)]).astype(np.uint32)
    h, row = h[new], row[new]
    distinct = np.bincount(row, minlength=len(n))
    width = np.maximum(LEAST_WIDTH, 1 << np.ceil(np.log2(np.maximum(distinct, 1) * ROOM)).astype(np.int64))
    base = np.r_[0, np.cumsum(width)]
    sketch = np.zeros(base[-1], np.uint8)
    code = np.minimum(counts, MOST).astype(np.uint8)
    mask = (width - 1).astype(np.uint64)[row]
    for at in (h, _second(h)):
        np.maximum.at(sketch, base[row] + (at & mask).astype(np.int64), code)
    found = np.r_[0, np.cumsum(distinct)]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n, pa.int64()), _cells(sketch, base), _cells(h, found), _cells(counts, found)], schema=_INDEX)


def index(docs: DataFrame) -> DataFrame:
    """doc_id, n (terms with repeats), sketch, terms, counts of each row, written to the
    shared folder. A null text has no terms; null ids, repeated rows and empty tables stay
    as they are; other columns of `docs` are not read."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            yield _indexed(part)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(build, INDEX)
    path = f"{shared_folder(docs.sparkSession)}/search-index-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def _array(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all cells of bytes in a row, and where each cell's begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(column.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data.tobytes(), kind), (offsets - lo) // size


def document_counts(indexed: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How many rows hold each of `terms` (sorted hashes): its place to the number."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(terms), np.int64)
        for batch in filter(lambda b: b.num_rows, batches):
            h, _ = _array(batch.column("terms"), np.uint64)
            at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            found += np.bincount(at[terms[at] == h], minlength=len(terms))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"place": pa.array(at, pa.int32()), "rows": pa.array(found[at], pa.int64())})

    if not len(terms):
        return {}
    counted = indexed.select("terms").mapInArrow(count, "place int, rows long").groupBy("place").agg(F.sum("rows").alias("rows"))
    return {r["place"]: r["rows"] for r in counted.collect()}


def norms(n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """m of documents with n terms, exact whatever the size of the corpus."""
    if len(n) and int(n.max()) * 75 * total_docs >= 1 << 62:
        return np.array([25 + 75 * int(x) * total_docs // total_terms for x in n], np.int64)
    return 25 + 75 * n * total_docs // max(total_terms, 1)


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


class Best:
    """The `top` highest (score, then smallest id) of one query so far."""

    def __init__(self, top: int):
        self.top, self.kept = top, []

    def may_enter(self, bound: float, doc_id: int | None) -> bool:
        if len(self.kept) < self.top:
            return bound > 0
        return (-bound, doc_id is None, doc_id or 0) < self.kept[-1]

    def put(self, score: int, doc_id: int | None) -> None:
        if score > 0 and self.may_enter(score, doc_id):
            self.kept = sorted([*self.kept, (-score, doc_id is None, doc_id or 0)])[: self.top]


def allowed(sketches: pa.Array, terms: np.ndarray) -> np.ndarray:
    """The largest count the sketches allow each term: rows x terms, `MOST` for no bound."""
    sketch, base = _array(sketches, np.uint8)
    mask = np.diff(base).astype(np.uint64) - np.uint64(1)
    code = None
    for h in (terms, _second(terms)):
        at = (h[None, :] & mask[:, None]).view(np.int64)
        at += base[:-1, None]
        code = sketch[at] if code is None else np.minimum(code, sketch[at])
    return code


def _bounds(batch: pa.RecordBatch, low: int, high: int, terms: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of rows `low` to `high` for all queries: rows x queries."""
    code = allowed(batch.column("sketch").slice(low, high - low), terms)
    row, term = np.nonzero(code)
    most = code[row, term].astype(np.int64)
    upper = np.zeros(code.shape)
    upper[row, term] = np.where(most == MOST, CEILING, impacts(most, m[low:high][row]))
    # Whole numbers below 2^53 throughout: the sums are exact.
    return upper @ weights


def _rescored(batch: pa.RecordBatch, terms: np.ndarray, m: np.ndarray):
    """A function from a row to the places of its query terms and their impacts."""
    h, first = _array(batch.column("terms"), np.uint64)
    counts, _ = _array(batch.column("counts"), np.uint32)

    @functools.cache
    def of(row: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(first[row], first[row + 1])
        at = np.minimum(np.searchsorted(terms, h[own]), len(terms) - 1)
        met = terms[at] == h[own]
        return at[met], impacts(counts[own][met].astype(np.int64), m[row])

    return of


def _block(indexed: DataFrame, queries: list, total_docs: int, total_terms: int, top: int) -> DataFrame:
    """item (place in the block), item_id, doc_id, score: each task's best rows."""
    h, first = hashed_terms(pa.array([q["text"] for q in queries], pa.string()))
    terms = np.unique(h)
    found = document_counts(indexed, terms)
    weight = np.zeros(len(terms), np.int64)
    for place, df in found.items():
        weight[place] = math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df + 1)))
    held = np.array(sorted(p for p in found if weight[p]), np.int64)
    place = np.searchsorted(terms, h)
    item = np.repeat(np.arange(len(queries)), np.diff(first))
    kept = np.isin(place, held)
    item, place = item[kept], np.searchsorted(held, place[kept])
    terms, weight = terms[held], weight[held]
    ids = [q["item_id"] for q in queries]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.zeros((len(ids), len(terms)), np.int64)
        np.add.at(exact, (item, place), weight[place])
        weights = exact.T.astype(np.float64)
        best = [Best(top) for _ in ids]
        step = max(1, CELLS // max(1, len(terms)))
        for batch in filter(lambda b: b.num_rows and len(terms), batches):
            m = norms(batch.column("n").to_numpy(), total_docs, total_terms)
            doc_ids = batch.column("doc_id").to_pylist()
            rescored = _rescored(batch, terms, m)
            for low in range(0, batch.num_rows, step):
                bounds = _bounds(batch, low, min(low + step, batch.num_rows), terms, m, weights)
                for q, mine in enumerate(best):
                    least = -mine.kept[-1][0] if len(mine.kept) == top else 1
                    rows = np.flatnonzero(bounds[:, q] >= least)
                    order = sorted(rows.tolist(), key=lambda r: (-bounds[r, q], doc_ids[low + r] is None, doc_ids[low + r] or 0))  # noqa: B023
                    for r in order:
                        if not mine.may_enter(bounds[r, q], doc_ids[low + r]):
                            break
                        at, impact = rescored(low + r)
                        mine.put(int(exact[q, at] @ impact), doc_ids[low + r])
        rows = [(q, ids[q], None if null else doc_id, -score) for q, mine in enumerate(best) for score, null, doc_id in mine.kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
            (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["item", "item_id", "doc_id", "score"])

    return indexed.mapInArrow(rank, "item int, item_id long, doc_id long, score long")


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each query: first within some tasks each, then among those."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("item", "_some").orderBy(*best)
    part = rows.withColumn("_some", F.spark_partition_id() % 64).withColumn("_no", F.row_number().over(some)).filter(F.col("_no") <= top)
    whole = Window.partitionBy("item").orderBy(*best)
    return part.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(indexed: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the `top` documents of each query with a score above 0.

    Equal scores are ranked by doc_id, null last; repeated rows of documents rank one by
    one. Queries of the same item_id and text are one; a query of null text, or without
    terms of the documents, has no rows. Terms are told apart by 64-bit hashes.
    """
    spark = indexed.sparkSession
    rows = queries.select(queries["item_id"].cast("long").alias("item_id"), F.coalesce(queries["text"], F.lit("")).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    sums = indexed.agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("docs"), F.sum("n").alias("terms")).first()
    blocks = -(-size // BLOCK_BYTES)
    done = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for no in range(blocks):
        mine = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == no).collect()
        if mine:
            found = _ranked(_block(indexed, mine, int(sums["docs"] or 0), int(sums["terms"] or 0), top), top)
            done = done.unionByName(found if blocks == 1 else staged(found, "search-block"))
    return done
