"""Quality: logistic regression over hashed word n-grams, trained online with
follow-the-regularised-leader updates (FTRL-proximal) and scored as a sparse dot product.

Tokens are runs of letters and digits, and runs of other signs, so that decoration
round a word is a word of its own; a token that repeats the one before it becomes one
fixed token, so that repetition is seen whatever is repeated. The n-grams are single
tokens and pairs, with marks for the start and end of the text. A feature's value is its
share of the text's n-grams times `SCALE`.

The model is fitted on a bounded sample of labelled rows (`sample`); all rows are scored
on their whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from phrasestream.llm import words as W
from phrasestream.llm.toxicity import LETTERS, labelled_sample

BUCKETS = 1 << 20
SAMPLE = 10_000
SCALE = 8.0
KINDS = np.where(W.SPACES, 0, np.where(LETTERS == 1, 1, 2)).astype(np.uint8)
_SAME, _EDGE = np.uint64(1), np.uint64(2)


def hashed_ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every n-gram, repeats included."""
    data, offsets = W.flat(column)
    starts, lengths, first = W.runs(data, offsets, KINDS)
    h = W.hash_spans(data, starts, lengths)
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    h = np.where(same, _SAME, h)
    # One edge mark before each text and one after the last.
    at = np.arange(len(h)) + text + 1
    marked = np.full(len(h) + n + 1, _EDGE, np.uint64)
    marked[at] = h
    owner = np.repeat(np.arange(n), np.diff(first) + 1)
    pairs = W.windows(marked, 2)
    texts = np.concatenate([text, owner])
    grams = np.concatenate([W.mix(h), pairs])
    return texts, (grams % np.uint64(BUCKETS)).astype(np.int64)


def _rows(batches):
    for part in W.slices(batches):
        text, bucket = hashed_ngrams(part.column("text"))
        pairs, counts = np.unique(text * BUCKETS + bucket, return_counts=True)
        total = np.bincount(text, minlength=part.num_rows)
        values = SCALE * counts / total[pairs // BUCKETS]
        cuts = pa.array(np.searchsorted(pairs // BUCKETS, np.arange(part.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [part.column("label"),
             pa.ListArray.from_arrays(cuts, pa.array((pairs % BUCKETS).astype(np.int32))),
             pa.ListArray.from_arrays(cuts, pa.array(values.astype(np.float32)))],
            ["label", "at", "value"])


def ftrl(rows, passes: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.2, l2: float = 0.5):
    """Weights after `passes` over (label, buckets, values) rows, bias last."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at):
        zs = z[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(zs) <= l1] = 0
        return w

    for _ in range(passes):
        for y, at, x in rows:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(BUCKETS + 1))


def _fit_rows(sample: int):
    def fit(batches):
        rows = []
        for batch in batches:
            for y, at, x in zip(batch.column("label").to_pylist(), batch.column("at"), batch.column("value")):
                if len(rows) < sample:
                    rows.append((y, at.values.to_numpy(zero_copy_only=False), x.values.to_numpy(zero_copy_only=False)))
        if rows:
            w = ftrl(rows)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_pydict({"at": at, "w": w[at]})

    return fit


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights by bucket, bias last (BUCKETS + 1 numbers). Null ids and labels are not
    used; of repeated labels the larger counts. Without labelled rows every score is 0.5."""
    rows = labelled_sample(docs, labels, label, train, sample).mapInArrow(
        _rows, "label int, at array<int>, value array<float>")
    found = rows.repartition(1).mapInArrow(_fit_rows(sample), "at long, w double").toArrow()
    w = np.zeros(BUCKETS + 1)
    w[found.column("at").to_numpy()] = found.column("w").to_numpy()
    return w


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """`docs` with _score and _predicted; null texts are empty. All other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # BUCKETS + 1 numbers

    def run(batches):
        w = shared.value
        for part in W.slices(batches):
            text, bucket = hashed_ngrams(part.column("text"))
            total = np.bincount(text, minlength=part.num_rows)
            dot = np.bincount(text, w[bucket], part.num_rows) * SCALE / total
            s = 1 / (1 + np.exp(-np.clip(dot + w[BUCKETS], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                [*part.schema.names, "_score", "_predicted"])

    source = docs.drop("_score", "_predicted")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(run, f"{fields}, _score double, _predicted int")
