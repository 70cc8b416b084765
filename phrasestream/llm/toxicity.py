"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where x_i says
whether hashed term i stands in the text. The pair term learns what single weights
miss, e.g. an insult beside the mention of a group. A term is a lower-cased run of
letters and digits, or the first four or five bytes of one, so that an inflected
form meets its stem.

Terms enter the machine in two ways: those that change the odds of the label alone, and
those that, beside another term, explain what an additive model of the former leaves. A
pair of neutral terms has no weight of its own and is found the second way.

The model is fitted on a bounded sample of labelled rows (`sample`, the rows with
the smallest hash of their id); everything else is done for all rows and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasestream.llm import words as W

BUCKETS = 1 << 18
SAMPLE = 8_000
TERMS = 1_024
FACTORS = 8
#: Texts a term or a pair must stand in, in the sample.
SEEN = 5
#: Terms held against each other for pairs, beside those that are strong alone, and the
#: z-value from which a pair counts: by chance one of 200 samples has one.
PAIRED = 2_048
PAIR_Z = 6.0
PREFIXES = (4, 5)


@dataclass(frozen=True)
class Model:
    """Buckets of the chosen terms, their weights and factors."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray


def _letters() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[128:] = 1
    for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
        kinds[ord(a) : ord(b) + 1] = 1
    return kinds


LETTERS = _letters()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def hashed_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each term, repeats included."""
    data, offsets = W.flat(column)
    data = LOWER[data]
    starts, lengths, first = W.runs(data, offsets, LETTERS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    found = [(text, W.hash_spans(data, starts, lengths))]
    for k in PREFIXES:
        long = lengths > k
        found.append((text[long], W.hash_spans(data, starts[long], np.full(long.sum(), k), seed=k)))
    texts, hashes = (np.concatenate(x) for x in zip(*found))
    return texts, (hashes % np.uint64(BUCKETS)).astype(np.int64)


def _terms_of_rows(batches):
    for part in W.slices(batches):
        text, bucket = hashed_terms(part.column("text"))
        pairs = np.unique(text * BUCKETS + bucket)
        cuts = np.searchsorted(pairs // BUCKETS, np.arange(part.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array((pairs % BUCKETS).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([part.column("label"), lists], ["label", "terms"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, sample: int) -> DataFrame:
    """At most `sample` labelled rows for training. Ids are chosen on the thin label
    table, so only chosen texts move; the id table has at most `sample` rows."""
    chosen = (
        labels.select(labels["doc_id"].alias("_id"), labels[label].cast("int").alias("label"))
        .filter(F.col("_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("_id").agg(F.max("label").alias("label"))
        .filter(train)
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    texts = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("text"))
    return texts.join(F.broadcast(chosen), "_id").select("label", "text")


def _indicators(rows: list[np.ndarray], buckets: np.ndarray) -> np.ndarray:
    """One row a text, one column a bucket: 1 where the text has the term."""
    place = np.full(BUCKETS, -1)
    place[buckets] = np.arange(len(buckets))
    x = np.zeros((len(rows), len(buckets)), np.float32)
    for i, row in enumerate(rows):
        at = place[row]
        x[i, at[at >= 0]] = 1
    return x


def _train(x: np.ndarray, y: np.ndarray, start: float, factors: int, rounds: int, rate: float) -> list[np.ndarray]:
    """Bias, weights and factors by Adam on the log loss; without factors an additive model."""
    n = len(y)
    rng = np.random.default_rng(7)
    parts = [np.float32(start), np.zeros(x.shape[1], np.float32),
             rng.normal(0, 0.01, (x.shape[1], factors)).astype(np.float32)]
    firsts, seconds = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, rounds + 1):
        b, w, v = parts
        sums = x @ v
        z = b + x @ w + 0.5 * ((sums**2).sum(1) - x @ (v**2).sum(1))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grads = [err.sum(), x.T @ err + 1e-5 * w,
                 x.T @ (err[:, None] * sums) - (x.T @ err)[:, None] * v + 1e-4 * v]
        for k, g in enumerate(grads):
            firsts[k] = 0.9 * firsts[k] + 0.1 * g
            seconds[k] = 0.99 * seconds[k] + 0.01 * g * g
            parts[k] = parts[k] - rate * (firsts[k] / (1 - 0.9**step)) / (np.sqrt(seconds[k] / (1 - 0.99**step)) + 1e-9)
    return parts


def _paired(x: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each column the largest z-value of a product of it and another column against
    what an additive model leaves of the labels. Pairs seen together, or one without the
    other, in fewer than SEEN texts say nothing."""
    n = len(left)
    share = x.mean(0)
    spread = np.sqrt(n * share * (1 - share))
    centred = x - share
    z = np.abs((centred * left[:, None]).T @ centred) * np.sqrt(n)
    z /= np.maximum(left.std(), 1e-6) * np.maximum(spread[:, None] * spread, 1e-9)
    both, seen = x.T @ x, x.sum(0)
    z[(both < SEEN) | (np.minimum(seen[:, None], seen) - both < SEEN)] = 0
    return z.max(1, initial=0.0)


def _fit(labels: np.ndarray, rows: list[np.ndarray], rounds: int = 150, rate: float = 0.05) -> Model:
    """The machine over terms that say something alone, and terms that say something
    beside another one; over the bounded sample, in one task."""
    n = len(labels)
    positive = labels > 0
    counts = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for y, row in zip(positive, rows):
        counts[int(y)][row] += 1
    n1, n0 = max(positive.sum(), 1), max(n - positive.sum(), 1)
    p1, p0 = (counts[1] + 0.5) / (n1 + 1), (counts[0] + 0.5) / (n0 + 1)
    seen = counts[0] + counts[1]
    # Terms by how much their presence says about the label, in bits per row.
    gain = seen * np.abs(np.log(p1 / p0)) * (seen >= SEEN)
    strong = np.abs(np.log(p1 / p0)) > 0.7
    order = np.lexsort((np.arange(BUCKETS), -gain * strong))[:TERMS]
    alone = order[(gain * strong)[order] > 0]
    # Terms as common as uncommon, and the strong ones, are held against each other.
    odds = np.minimum(seen, n - seen)
    order = np.lexsort((np.arange(BUCKETS), -odds))[:PAIRED]
    tried = np.union1d(alone, order[odds[order] >= SEEN])
    start, y = np.log(n1 / n0), positive.astype(np.float32)
    b, w, _ = _train(_indicators(rows, np.sort(alone)), y, start, 0, rounds, rate)
    x = _indicators(rows, tried)
    left = y - 1 / (1 + np.exp(-np.clip(b + x[:, np.isin(tried, alone)] @ w, -30, 30)))
    z = _paired(x, left)
    order = np.lexsort((tried, -z))[:TERMS]
    buckets = np.union1d(alone, tried[order[z[order] > PAIR_Z]]).astype(np.int64)
    b, w, v = _train(_indicators(rows, buckets), y, start, FACTORS, rounds, rate)
    return Model(float(b), buckets, np.asarray(w, np.float64), np.asarray(v, np.float64))


def _fit_rows(sample: int):
    def fit(batches):
        labels, rows = [], []
        for batch in batches:
            for y, terms in zip(batch.column("label").to_pylist(), batch.column("terms")):
                if len(labels) < sample:
                    labels.append(y)
                    rows.append(terms.values.to_numpy(zero_copy_only=False))
        if not labels:
            return
        m = _fit(np.array(labels), rows)
        yield pa.RecordBatch.from_pydict(
            {"bias": [m.bias], "buckets": [m.buckets.tolist()], "weights": [m.weights.tolist()],
             "factors": [m.factors.ravel().tolist()]})

    return fit


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of the rows where `train` (a condition on `_id`) holds.

    Labels of null ids and null labels are not used; of repeated labels the larger
    counts. Without any labelled row the model says 0 for every text.
    """
    rows = labelled_sample(docs, labels, label, train, sample).mapInArrow(
        _terms_of_rows, "label int, terms array<int>")
    found = rows.repartition(1).mapInArrow(
        _fit_rows(sample), "bias double, buckets array<long>, weights array<double>, factors array<double>"
    ).collect()
    if not found:
        return Model(-30.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    row = found[0]
    return Model(row["bias"], np.array(row["buckets"], np.int64), np.array(row["weights"], np.float64),
                 np.array(row["factors"], np.float64).reshape(-1, FACTORS))


def score_texts(column: pa.Array, model: Model, place: np.ndarray) -> np.ndarray:
    text, bucket = hashed_terms(column)
    at = place[bucket]
    hit = at >= 0
    k = max(len(model.buckets), 1)
    pairs = np.unique(text[hit] * k + at[hit])
    who, term = pairs // k, pairs % k
    n = len(column)
    linear = np.bincount(who, model.weights[term], n)
    both = np.zeros(n)
    for f in range(FACTORS):
        v = model.factors[term, f]
        both += np.bincount(who, v, n) ** 2 - np.bincount(who, v * v, n)
    return 1 / (1 + np.exp(-np.clip(model.bias + linear + 0.5 * both, -30, 30)))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """`docs` with score and predicted. A null text is empty; an empty text has the
    score of the bias. All other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most TERMS terms
    source = docs.drop("_score", "_predicted")

    def run(batches):
        m = shared.value
        place = np.full(BUCKETS, -1)
        place[m.buckets] = np.arange(len(m.buckets))
        for part in W.slices(batches):
            s = score_texts(part.column("text"), m, place)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                [*part.schema.names, "_score", "_predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(run, f"{fields}, _score double, _predicted int")
